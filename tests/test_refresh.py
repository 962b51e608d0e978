"""The refresh stream against a full refresh, replays, and the newest rows against a sort."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import newest
from shelfmark.streaming import refresh

CHANGES = "source_id long, work_key string, blocked boolean, score double, version long, gone boolean"


def plain(rows):
    last: dict[int, tuple] = {}
    for r in rows:
        if r[0] is not None and (r[0] not in last or r[4] > last[r[0]][4]):
            last[r[0]] = r
    works: dict[str, list] = {}
    for i, work, blocked, score, _, gone in last.values():
        if not gone:
            works.setdefault(work if work is not None else f"unkeyed:{i}", []).append((not blocked, score or 0.0, i))
    return {(w, x[2], x[1]) for w, books in works.items() if (x := max(books))[0]}


def changes(seed, n=400):
    rng = random.Random(seed)
    rows = [(rng.randrange(60), rng.choice([None, "hot", "hot", "a", "b", "c"]), rng.random() < 0.2, float(rng.randrange(5)), k, rng.random() < 0.15) for k in range(n)]
    rng.shuffle(rows)
    return [*rows, (None, "a", False, 9.0, 1, False)]


def test_batches_in_any_order_equal_the_full_refresh_and_replays_change_nothing(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/state", changes(5)
    assert refresh.best(spark, folder).count() == 0
    size, told = 101, []
    for k in range(5):
        batch = spark.createDataFrame(rows[k * size : (k + 1) * size], CHANGES)
        told.append(refresh.apply(batch, k, folder, buckets=8, every=3))
        if k in (1, 3):
            seen = {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*")}
            assert refresh.apply(batch, k, folder, buckets=8, every=3) is None
            assert seen == {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*")}
        got = {tuple(r) for r in refresh.best(spark, folder).select("work", "source_id", "score").collect()}
        assert got == plain(rows[: (k + 1) * size])
    assert told[0]["changed"] <= 60 and told[0]["moved"] == 0 and sum(t["moved"] for t in told[1:]) > 0
    assert refresh.batches(spark, folder) == {0: False, 1: False, 2: True, 3: False, 4: False}
    empty = refresh.apply(spark.createDataFrame([], CHANGES), 5, folder, buckets=8, every=3)
    assert not any((empty or {}).values()) and {tuple(r) for r in refresh.best(spark, folder).select("work", "source_id", "score").collect()} == plain(rows)


def test_a_lost_batch_is_written_anew(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/state", changes(6)
    refresh.apply(spark.createDataFrame(rows[:200], CHANGES), 0, folder, buckets=4)
    wrong = spark.createDataFrame(rows[100:300], CHANGES)
    refresh.apply(wrong, 1, folder, buckets=4)
    (tmp_path / "state/best/whole=0/batch=1/_SUCCESS").unlink()  # as if the driver was lost before the marker
    got = lambda: {tuple(r) for r in refresh.best(spark, folder).select("work", "source_id", "score").collect()}
    assert got() == plain(rows[:200])
    refresh.apply(spark.createDataFrame(rows[200:], CHANGES), 1, folder, buckets=4)
    assert got() == plain(rows)


def test_only_touched_works_and_buckets_are_read(spark, tmp_path):
    folder = f"file://{tmp_path}/state"
    refresh.apply(spark.range(500).select(F.col("id").alias("source_id"), F.concat(F.lit("w"), F.col("id") % 200).alias("work_key"), F.lit(False).alias("blocked"), F.rand(3).alias("score"), F.lit(1).alias("version"), F.lit(False).alias("gone")), 0, folder, buckets=32)
    refresh.apply(spark.createDataFrame([(7, "w7", False, 99.0, 2, False)], CHANGES), 1, folder, buckets=32)
    assert [tuple(r) for r in spark.read.parquet(f"{folder}/best/whole=0/batch=1").select("work", "source_id").collect()] == [("w7", 7)]
    plan = refresh._read(spark, folder, "books", {0: False, 1: False}, [3])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


@pytest.mark.parametrize("kind", ["long", "timestamp", "timestamp_ntz", "date"])
def test_newest_equals_a_sort(spark, kind):
    rng = random.Random(8)
    ends = [-(1 << 62), 1 << 62] if kind == "long" else []
    rows = [(None if rng.random() < 0.1 else rng.choice([*ends, rng.randrange(-40, 40), rng.randrange(10**6)]), None if rng.random() < 0.1 else rng.randrange(6), k) for k in range(300)]
    df = spark.createDataFrame(rows, "a long, b int, c long")
    if kind != "long":
        df = df.withColumn("a", (F.date_add(F.lit("1970-01-01").cast("date"), F.col("a").cast("int")) if kind == "date" else F.timestamp_seconds("a").cast(kind)))
    least = float("-inf")
    order = sorted(rows, key=lambda r: tuple(least if x is None else x for x in r), reverse=True)
    for n in (-1, 0, 1, 29, 150, 285, 299, 300, 1000):
        assert sorted(r["c"] for r in newest.newest(df, n, ["a", "b", "c"]).collect()) == sorted(r[2] for r in order[: max(n, 0)])
    few = newest.newest(df, 100, ["b"])
    assert few.count() == 100 and sorted((r["b"] for r in few.collect()), reverse=True) == sorted((r[1] if r[1] is not None else -1 for r in rows), reverse=True)[:100]
    assert newest.newest(df.limit(0), 5, ["a"]).count() == 0


def test_newest_needs_no_single_task(spark):
    plan = newest.newest(spark.range(10_000), 1000, ["id"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Sort" not in plan
