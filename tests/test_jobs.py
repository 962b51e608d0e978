"""Jobs, files and versions: what queries can't show."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators import matching, playlist, telemetry
from shelfmark.sources import library, schema
from shelfmark.streaming import scheduler


def test_a_job_runs_once_at_a_time_and_keeps_its_outcome():
    jobs, gate, inside = scheduler.Jobs(), threading.Event(), threading.Event()

    def slow():
        inside.set()
        gate.wait(10)
        return {"n": 1}

    t = threading.Thread(target=lambda: jobs.run("a", slow))
    t.start()
    inside.wait(10)
    assert jobs.status["a"]["running"] and jobs.run("a", lambda: 1 / 0) is None
    gate.set()
    t.join()
    assert jobs.status["a"]["result"] == '{"n": 1}' and not jobs.status["a"]["running"] and jobs.status["a"]["finished"]
    with pytest.raises(ZeroDivisionError):
        jobs.run("a", lambda: 1 / 0)
    assert "division" in jobs.status["a"]["error"]


def test_ticks_run_what_is_due(spark):
    jobs, ran = scheduler.Jobs(), []

    def due(now):
        return [("bad", lambda: 1 / 0), ("good", lambda: ran.append(now) or "done")]

    query = scheduler.start(spark, jobs, due, "1 second")
    try:
        end = time.time() + 60
        while len(ran) < 2 and time.time() < end:
            time.sleep(0.2)
    finally:
        query.stop()
    assert len(ran) >= 2 and jobs.status["good"]["result"] == "done" and jobs.status["bad"]["error"]


def test_files_are_written_whole_and_again(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/a{k % 3}/f{k}.json", f"text {k}") for k in range(9)], "path string, content string")
    for _ in range(2):
        library.write_files(rows)
    found = {str(p): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {r["path"]: r["content"] for r in rows.collect()}


def test_versions_are_seen_whole(spark, tmp_path):
    folder = str(tmp_path / "catalogue")
    assert schema.checkout(spark, folder)["books"].count() == 0
    books = spark.createDataFrame([(1, "a")], "source_id long, title string")
    assert schema.commit({"books": books}, folder) == 1
    schema.save_table(books, f"{folder}/v2-lost", "books")  # a commit that stopped before its marker
    assert schema.commit({"meta": spark.createDataFrame([("k", "v")], "key string, value string")}, folder) == 2
    seen = schema.checkout(spark, folder)
    assert seen["books"].count() == 1 and schema.get_meta(seen["meta"], "k") == "v" and schema.checkout(spark, folder, 1)["meta"].count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        spark.createDataFrame([(2, "x", "y")], "version int, name string, folder string").write.mode("error").parquet(f"{folder}/_versions/2")


def test_containing_equals_a_plain_loop(spark):
    needles = ["supplier#000001", "supplier#000002", "ab", "c", "same start one", "zzzz", "上海", ""]
    texts = [f"supplier#{k:06d}" for k in range(40)] + ["xaby", "c", "the same start one here", "same start two", "在上海市", ""]
    frame = lambda rows, name: spark.createDataFrame([(r,) for r in rows], f"{name} string")
    got = {(r["needle"], r["text"]) for r in matching.containing(frame(needles, "needle"), frame(texts, "text")).collect()}
    assert got == {(n, t) for n in needles for t in texts if n and n in t}


def test_limiter_fold_streams_a_hot_key(spark):
    events = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, F.lit(1)).otherwise(F.col("id") % 7).cast("long").alias("origin"), "id", F.when(F.col("id") % 13 == 0, "challenge").when(F.col("id") % 5 == 0, "failure").otherwise("success").alias("kind"), (F.col("id") * 977 % 1_000_003).alias("at_ms"))
    want: dict[int, tuple] = {}
    for r in sorted(events.collect(), key=lambda r: (r["at_ms"], r["id"])):
        want[r["origin"]] = telemetry.limiter_step(want.get(r["origin"], telemetry.START), r["kind"], r["at_ms"])
    got = {r[0]: tuple(r)[1:] for r in telemetry.limiter_fold(events, "origin").collect()}
    assert got == want
    assert telemetry.limiter_fold(events.limit(0), "origin").count() == 0
    nulls = telemetry.limiter_fold(events.withColumn("origin", F.lit(None).cast("long")), "origin").collect()
    assert len(nulls) == 1 and nulls[0]["requests"] == 20_000


def test_volume_numbers_have_three_digits_at_most(spark):
    rows = spark.createDataFrame([("vol. 0007",), ("книга 0012",), ("том 012",), ("vol 000",), ("кн 100",)], "t string")
    assert [r[0] for r in rows.select(text.normalise_title(F.col("t"))).collect()] == ["vol 0007", "книга 0012", "#12", "#0", "#100"]


def test_playlist_keys_and_manifests(spark):
    rows = spark.createDataFrame([(5, "a b", None), (5, "ok", "https://catalogue.example.org/6-x.html"), (None, "7-whole", None), (5, "<html>", None)], "i long, s string, u string")
    assert [r[0] for r in rows.select(playlist.playlist_key(F.col("i"), F.col("s"), F.col("u"))).collect()] == [None, "6-x", "7-whole", None]
    made = spark.createDataFrame([(1, '{"playlistUrl":"u","tracks":[{"file":"a.mp3","name":""},{"file":"b.mp3","name":"n"}]}'), (2, "{}"), (3, "no"), (4, None)], "playlist_id long, manifest string")
    assert [tuple(r) for r in playlist.read_manifest(made).orderBy("pos").collect()] == [(1, "u", 0, "a.mp3", "a.mp3"), (1, "u", 1, "b.mp3", "n")]
