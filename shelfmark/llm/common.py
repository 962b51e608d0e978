"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import ROW_GROUP, shared_folder

#: What a word is in the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A salt gets this many rows at least, and no less than 1/SALTS of all rows; twice that makes a key heavy.
SALT_ROWS, SALTS = 256, 1 << 16
#: Rows of a bucket from which ``numbered`` looks for rows that are all alike in it.
BUCKET_ROWS = 1 << 18
#: Bytes that an Arrow function gets at a time.
SLICE = 4 << 20
#: Prefix of the columns that operators add for themselves and drop again.
OWN = "__sm_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition of a checkpoint whose size is known beforehand.
PART_ROWS = 50_000


def checkpoint(df: DataFrame, most: int | None = None) -> DataFrame:
    """Cut the lineage with files in the shared folder; Spark removes them with the last reference.

    ``most`` is a known bound on the rows: few rows then go to few files, however many partitions they come from.
    """
    shared_folder(df.sparkSession)
    return (df if most is None else df.coalesce(1 + most // PART_ROWS)).checkpoint(eager=True)


#: Tables that ``written`` made and ``forget`` hasn't removed.
_TABLES: set[str] = set()


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: for rows that carry texts.

    ``forget`` removes it; what is left goes when the driver's Python ends.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _TABLES.add(path)
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _TABLES.discard(path)


def forget(table: DataFrame) -> None:
    """Remove what ``written`` gave, once nothing reads it any more; other tables stay."""
    names = {m for f in table.inputFiles() for m in re.findall(r"table-[0-9a-f]{32}", f)}
    for path in [p for p in _TABLES if p.rsplit("/", 1)[1] in names]:
        _remove(table.sparkSession, path)


@atexit.register
def _forget_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in [*_TABLES] if spark is not None else []:
        with contextlib.suppress(Exception):  # the session may be gone
            _remove(spark, path)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def heavy_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Keys with many of ``total`` rows and how many salts each gets.

    ``counts`` has a row per key. A key is heavy from 2/SALTS of all rows on (and from 2 * SALT_ROWS
    rows), so the result has at most SALTS / 2 rows whatever the input is, a few MB to broadcast, and
    no salt of a heavy key gets more than 1/SALTS of all rows.
    """
    unit = max(SALT_ROWS, total // SALTS + 1)
    return counts.filter(F.col(n) >= 2 * unit).select(F.col(key).alias(f"{OWN}heavy"), F.ceil(F.col(n) / F.lit(unit)).cast("int").alias(f"{OWN}salts"))


def salted_join(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame, spread: Column, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right`` (a row per key at most) with the heavy keys' rows dealt out.

    A heavy key's left rows go to as many places as it has salts, by a hash of ``spread``, and
    its single right row is repeated for each.
    """
    salt, salts, hot = f"{OWN}salt", f"{OWN}salts", f"{OWN}heavy"
    small = F.broadcast(heavy)
    dealt = left.join(small, F.col(key) == F.col(hot), "left").withColumn(salt, F.when(F.col(salts).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col(salts)).cast("int"))).drop(hot, salts)
    copies = right.join(small, F.col(key) == F.col(hot), "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))).drop(hot, salts)
    return dealt.join(copies, [key, salt], how).drop(salt)


def bucketed(rows: DataFrame) -> DataFrame:
    """Rows with the column {OWN}sub, the leading digits of {OWN}hash."""
    return rows.withColumn(f"{OWN}sub", F.substring(f"{OWN}hash", 1, 2))


def numbered(rows: DataFrame, groups: list[str], out: str, *, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` with a running number from 0 in each group, without a gap.

    Needs the columns {OWN}order (its value counts first), {OWN}hash (a hex text; rows that share it must be
    alike in all that matters, so that it is the same which gets which number). The numbers are dealt out
    in buckets of (group, order, leading digits of the hash): running numbers in a bucket, and offsets from one row a bucket. Where a
    bucket has very many rows, it is cut at the hashes that many of them share: those below, those of the hash, those above, and
    so on, so the order stays that of the hashes. The rows of such a hash are alike and are dealt further by
    their places in a table that is written for it, so no task numbers a whole group, whatever
    repeats. ``counts`` are the rows of each bucket (column n), where they are known already.
    """
    order, digest, sub, own, part = (OWN + x for x in ("order", "hash", "sub", "own", "part"))
    bucket = [*groups, order, sub]
    rows = bucketed(rows)
    thin = rows.select(*bucket, digest)
    if counts is None:
        counts = checkpoint(thin.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")))
    large = counts.filter(F.col("n") > BUCKET_ROWS)
    heavy = None
    if not large.isEmpty():
        same = thin.join(large.drop("n"), bucket, "left_semi").groupBy(digest).agg(F.count(F.lit(1)).alias("n"))
        heavy = checkpoint(heavy_keys(same, digest, "n", counts.agg(F.sum("n")).first()[0]))
    if heavy is not None and not heavy.isEmpty():
        cuts = heavy.groupBy(F.substring(f"{OWN}heavy", 1, 2).alias(sub)).agg(F.collect_list(f"{OWN}heavy").alias(f"{OWN}cuts"))
        rows = written(rows.withColumn(f"{OWN}row", F.monotonically_increasing_id())).join(F.broadcast(heavy), F.col(digest) == F.col(f"{OWN}heavy"), "left").join(F.broadcast(cuts), sub, "left")
        below = F.size(F.filter(F.coalesce(f"{OWN}cuts", F.array().cast("array<string>")), lambda x: x < F.col(digest)))
        rows = rows.withColumn(own, 2 * below + F.col(f"{OWN}heavy").isNotNull().cast("int")).withColumn(part, F.coalesce(F.pmod(F.xxhash64(f"{OWN}row"), F.col(f"{OWN}salts")).cast("int"), F.lit(0))).drop(f"{OWN}heavy", f"{OWN}salts", f"{OWN}row", f"{OWN}cuts")
        counts = checkpoint(rows.groupBy(*bucket, own, part).agg(F.count(F.lit(1)).alias("n")))
        bucket = [*bucket, own, part]
    before = Window.partitionBy(*groups).orderBy(*bucket[len(groups) :]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{OWN}offset"))
    inside = Window.partitionBy(*bucket).orderBy(digest)
    return rows.join(offsets, bucket).withColumn(out, F.col(f"{OWN}offset") + F.row_number().over(inside) - 1).drop(sub, own, part, f"{OWN}offset")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about SLICE bytes, so that a worker holds few texts as Python objects at a time."""
    rows = max(1, batch.num_rows * SLICE // max(SLICE, batch.nbytes))
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def add_columns(df: DataFrame, fields: list[T.StructField], compute: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], drop: tuple[str, ...] = ()) -> DataFrame:
    """Append columns that an Arrow function computes; every input column but those in ``drop`` passes through.

    ``compute`` is called once a task and returns the function for a slice of a batch. A field whose name the
    input has already replaces that column.
    """
    new = {f.name for f in fields}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new])
    kept = [k for k, c in enumerate(df.columns) if c not in drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = compute()
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *work(batch)], names=[*(batch.schema.names[k] for k in kept), *[f.name for f in fields]])

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[k] for k in kept), *fields]))


def texts_of(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def bytes_of(batch: pa.RecordBatch, column: str) -> list:
    values = batch.column(batch.schema.get_field_index(column))
    return values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()
