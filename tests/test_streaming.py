from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import telemetry
from shelfmark.plans.testviews import Views
from shelfmark.streaming import limiter


def _plain(rows):
    """The limiter event by event."""
    out = {}
    for origin, at_ms, _, kind in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out[origin] = telemetry.limiter_step(out.get(origin, telemetry.START), kind, at_ms)
    return out


def _folded(df):
    return {r["origin"]: tuple(r)[1:] for r in telemetry.limiter_fold(df, "origin").collect()}


@pytest.mark.parametrize("seed", range(4))
def test_fold_over_chunks_equals_the_plain_fold(spark, seed):
    """One origin with most of the events, cut into chunks by ranges; runs of failures, of challenges, and gaps longer than a cool-down."""
    rng, rows, at = random.Random(seed), [], 0
    for k in range(3000):
        at += rng.choice([0, 1, 1000, 60_000, 60_000, 700_000 if seed % 2 else 5000])
        kind = rng.choices(["success", "challenge", "failure"], [(30, 3, 3), (1, 30, 10), (2, 20, 2), (0, 5, 5)][seed])[0]
        rows.append((rng.choice([1, 1, 1, 1, 2, 3]), at, k, kind))
    rows += [(100 + k, k, 10_000 + k, rng.choice(["challenge", "failure", "success"])) for k in range(50)]
    df = spark.createDataFrame(rows, "origin long, at_ms long, id long, kind string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert _folded(df) == _plain(rows)
        chunks = telemetry.limiter_chunks(df, "origin").groupBy("origin").count().filter("origin = 1").first()["count"]
        assert chunks > 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert _folded(df.limit(0)) == {}


def test_a_chunk_goes_from_every_start():
    import numpy as np

    rng = random.Random(11)
    for _ in range(200):
        events, at = [], 10**6
        for _ in range(rng.randrange(1, 12)):
            at += rng.choice([0, 1000, 250_000, 650_000])
            events.append((rng.choice(telemetry.KINDS), at))
        chunk = telemetry.Chunk(np.arange(telemetry.MIN_MS, telemetry.MAX_MS + 1), False)
        for kind, t in events:
            chunk.run(telemetry.KINDS.index(kind), np.array([t]))
        for _ in range(30):
            in_row = rng.choice([0, 1, 2, 3, 4, 9])
            state = (rng.randrange(telemetry.MIN_MS, telemetry.MAX_MS + 1), in_row, rng.randrange(10**6 - 5000, 10**6 + 900_000) if in_row >= 3 else None, 5, 2)
            want = state
            for kind, t in events:
                want = telemetry.limiter_step(want, kind, t)
            assert telemetry.after_chunk(state, chunk.told()) == want


def _streamed(spark, log, batches, tmp_path, name):
    """Final rows of the stream over these batches of files, then one event of another origin that lies far ahead."""
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, limiter.STATE_STORE)
    try:
        for part in [*batches, spark.createDataFrame([(-1, 10**9, "success", 4 * 10**12)], log.schema)]:
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        files = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        seen = []
        query = limiter.limiter_stream(files, "30 days").writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend((n, k, r.asDict()) for k, r in enumerate(df.collect()))).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        return [r for _, _, r in sorted(seen, key=lambda x: x[:2]) if r["origin"] != -1]
    finally:
        spark.conf.unset(store)


def test_stream_in_any_order_ends_where_the_fold_does(spark, sf, tmp_path):
    log = Views(spark, sf).fetch_log.filter("origin % 4 = 0").select(F.col("origin").cast("long").alias("origin"), F.col("id").cast("long").alias("id"), "kind", "at_ms")
    want = {r["origin"]: r.asDict() for r in telemetry.limiter_fold(log, "origin").collect()}
    dealt = log.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(3)))
    rows = _streamed(spark, log, [dealt.filter(F.col("batch") == k).drop("batch") for k in range(3)], tmp_path, "shuffled")
    last = {r["origin"]: {k: r[k] for k in want[r["origin"]]} for r in rows if r["reason"] == "events"}
    assert last == want
    over = {(r["origin"], r["at_ms"]) for r in rows if r["reason"] == "cool-down over"}
    assert {(o, w["cooldown_until"]) for o, w in want.items() if w["cooldown_until"] is not None} <= over
    challenges = {r["origin"]: r["at"] for r in log.filter("kind = 'challenge'").groupBy("origin").agg(F.max("at_ms").alias("at")).collect()}
    assert {(r["origin"], r["at_ms"]) for r in rows if r["reason"] == "probe again"} >= {(o, t + limiter.PROBE_MS) for o, t in challenges.items()}


def test_windowed_stats(spark, sf, tmp_path):
    log = Views(spark, sf).fetch_log.select(F.col("at").cast("timestamp").alias("at"), "event_type", "challenge")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    query = limiter.windowed_stats(files).writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("stats").agg(F.sum("requests")).first()[0] == log.count()
