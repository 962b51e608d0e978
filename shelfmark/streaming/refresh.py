"""The refresh as a stream over changed books: only works that a change touches are ranked again.

Three tables in one folder hold the state, each as batches of changes: ``homes`` (which work a book is of, by
source_id), ``books`` (a work's books, by work) and ``best`` (a work's best edition). A batch's rows stand in
``<table>/whole=0/batch=<number>/bucket=<hash>``; a whole batch (``whole=1``, every ``every`` batches) holds the full state, so that
readers never open more than ``every`` batches. ``best`` is written last, and the _SUCCESS file that Spark puts beside its rows marks
the batch as done. A batch that comes again is left alone if it is done, and else written anew from the state before
it; files of a lost attempt are in no done batch, thus nobody reads them.

Only the buckets that hold changed books and touched works are read: partition pruning, by at most ``buckets`` numbers.
"""

from __future__ import annotations

from contextlib import ExitStack
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import selection

#: Partitions of a table, and how many batches a reader opens at most.
BUCKETS, EVERY = 256, 32
#: Places that the books of a bucket are dealt over when they are written: a work may hold a third of all books.
DEAL = 64
_PLACE = "whole int, batch long, bucket int"
_VERSION = "version long, digest long, gone boolean"
_TABLES = {
    "homes": f"source_id long, work string, {_VERSION}, {_PLACE}",
    "books": f"work string, source_id long, blocked boolean, score double, {_VERSION}, {_PLACE}",
    "best": f"work string, source_id long, score double, {_PLACE}",
}
_KEYS = {"homes": ["source_id"], "books": ["work", "source_id"], "best": ["work"]}
#: What is newer: the version, and of one version the greater digest; a work's best edition is of the last batch.
_NEWER = {"homes": ["version", "digest"], "books": ["version", "digest"], "best": ["batch"]}


def batches(spark: SparkSession, folder: str) -> dict[int, bool]:
    """The batches that are done, and whether each holds all state."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/best/whole=*/batch=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    out: dict[int, bool] = {}
    for status in found or []:
        batch = status.getPath().getParent()
        out[int(batch.getName().split("=")[1])] = batch.getParent().getName() == "whole=1"
    return out


def _latest(rows: DataFrame, keys: list[str], newer: list[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*newer)).alias("x")).select(*keys, "x.*")


def _read(spark: SparkSession, folder: str, table: str, done: dict[int, bool], only: list[int] | None = None) -> DataFrame:
    """The newest row of each key in the given batches; of some buckets only, if ``only`` says so."""
    start = max((k for k, whole in done.items() if whole), default=-1)
    paths = [f"{folder}/{table}/whole={int(whole)}/batch={k}" for k, whole in sorted(done.items()) if k >= start]
    if not paths:
        return spark.createDataFrame([], _TABLES[table]).drop("whole", "batch", "bucket")
    rows = spark.read.schema(_TABLES[table]).option("basePath", f"{folder}/{table}").parquet(*paths)
    if only is not None:
        rows = rows.filter(F.col("bucket").isin(only))
    return _latest(rows.drop("whole", "bucket"), _KEYS[table], _NEWER[table]).drop("batch")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _buckets_of(rows: DataFrame, key: str, buckets: int) -> list[int]:
    return [r[0] for r in rows.select(_bucket(F.col(key), buckets)).distinct().collect()]


def apply(changes: DataFrame, number: int, folder: str, buckets: int = BUCKETS, every: int = EVERY) -> dict[str, Any] | None:
    """Take one batch of changes in; the counters of what it did, None if it was done before.

    ``changes`` are (source_id, work_key, blocked, score, version, gone). A book's change with the greatest version counts,
    whatever order changes come in; of changes with one version, the one with the greater digest. Rows without an id are left out; a book without a work is a work of its own. A null version counts
    as the least one, a null ``gone`` or ``blocked`` as false, a null score as 0. More columns play no part.
    """
    spark = changes.sparkSession
    done = batches(spark, folder)
    if number in done:
        return None
    done = {k: whole for k, whole in done.items() if k < number}
    whole = number % every == every - 1
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    told = changes.filter("source_id is not null").select(
        F.col("source_id").cast("long").alias("source_id"), selection.group_key().alias("work"), no("blocked"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce(F.col("version").cast("long"), F.lit(-(1 << 63))).alias("version"), no("gone"),
    )
    told = _latest(told.withColumn("digest", F.xxhash64("work", "blocked", "score", "gone")), ["source_id"], _NEWER["homes"])
    moved = F.col("old_work").isNotNull() & (F.col("old_work") != F.col("work"))

    def put(rows: DataFrame, table: str) -> None:
        if whole:  # gone books keep their home, whose version says which changes are old
            old = _read(spark, folder, table, done).withColumn("batch", F.lit(-1))
            rows = _latest(old.unionByName(rows.withColumn("batch", F.lit(number))), _KEYS[table], _NEWER[table]).drop("batch")
        deal = F.pmod(F.xxhash64("source_id"), F.lit(DEAL)) if table == "books" else F.lit(0)
        at = f"{folder}/{table}/whole={int(whole)}/batch={number}"
        rows.withColumn("bucket", _bucket(F.col(_KEYS[table][0]), buckets)).repartition("bucket", deal).write.partitionBy("bucket").mode("overwrite").parquet(at)

    with ExitStack() as held:
        held.callback(told.persist().unpersist)
        homes = _read(spark, folder, "homes", done, _buckets_of(told, "source_id", buckets)).select("source_id", F.col("work").alias("old_work"), F.struct("version", "digest").alias("known"))
        fresh = told.join(homes, "source_id", "left").filter("known is null or struct(version, digest) > known")
        held.callback(fresh.persist().unpersist)
        counts = Observation(f"refresh-{number}")
        seen = fresh.observe(counts, F.count(F.lit(1)).alias("changed"), F.count_if(moved).alias("moved"), F.count_if("gone").alias("gone"))
        put(seen.select("source_id", "work", "version", "digest", "gone"), "homes")
        left = fresh.filter(moved).select(F.col("old_work").alias("work"), "source_id", "blocked", "score", "version", "digest", F.lit(True).alias("gone"))
        put(fresh.select(*left.columns).unionByName(left), "books")
        touched = fresh.select("work").unionByName(left.select("work")).distinct()
        books = _read(spark, folder, "books", done | {number: whole}, _buckets_of(touched, "work", buckets)).filter("not gone")
        winners = selection.best_editions(books.join(touched, "work", "left_semi"), ["work"]).filter("not blocked")
        put(touched.join(winners.select("work", "source_id", "score"), "work", "left"), "best")
        return counts.get


def best(spark: SparkSession, folder: str) -> DataFrame:
    """(work, source_id, score): the best edition of each work after the batches that are done; blocked ones stand for no work."""
    return _read(spark, folder, "best", batches(spark, folder)).filter("source_id is not null")


def start(changes: DataFrame, folder: str, buckets: int = BUCKETS, every: int = EVERY, **trigger: Any) -> StreamingQuery:
    """Run ``apply`` over a stream of changes; the stream's own checkpoint is kept beside the tables."""

    def take(rows: DataFrame, number: int) -> None:
        apply(rows, number, folder, buckets, every)

    return changes.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/_stream").trigger(**(trigger or {"availableNow": True})).start()
