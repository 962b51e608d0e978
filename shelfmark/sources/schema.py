"""Tables of the catalogue, their keys, and additive schema evolution."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, I, D, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TABLES: dict[str, tuple[T.StructType, tuple[str, ...]]] = {
    "meta": (_struct(key=S, value=S), ("key",)),
    "books": (
        _struct(
            source_id=L, url=S, slug=S, title=S, subtitle=S, description=S, cover_url=S, duration_sec=I, rating=D, votes=I, series_key=S, series_name=S, series_seq=S,
            published_year=S, lastmod=S, first_seen_at=TS, fetched_at=TS, content_hash=S, work_key=S, work_label=S, isbn=S, asin=S, hardcover_book_id=S, hardcover_slug=S,
            hardcover_cover_url=S, hardcover_series_id=S, hardcover_match_kind=S, detail_state=S, detail_error=S,
        ),
        ("source_id",),
    ),
    "authors": (_struct(key=S, name=S, book_count=I, hardcover_author_id=S, hardcover_slug=S), ("key",)),
    "narrators": (_struct(key=S, name=S, book_count=I), ("key",)),
    "series": (_struct(key=S, name=S, book_count=I), ("key",)),
    "genres": (_struct(key=S, name=S), ("key",)),
    "book_authors": (_struct(source_id=L, author_key=S), ("source_id", "author_key")),
    "book_narrators": (_struct(source_id=L, narrator_key=S), ("source_id", "narrator_key")),
    "book_genres": (_struct(source_id=L, genre_key=S), ("source_id", "genre_key")),
    "book_tags": (_struct(source_id=L, tag=S), ("source_id", "tag")),
    "queue": (_struct(id=L, source_id=L, reason=S, state=S, note=S, created_at=TS, updated_at=TS), ("source_id",)),
    "abs_links": (_struct(source_id=L, abs_item_id=S, abs_library_id=S, abs_path=S, written_hash=S, written_payload=S, written_at=TS, pinned=B, confidence=D), ("source_id", "abs_item_id")),
    "hardcover_cache": (_struct(query_key=S, response=S, fetched_at=TS), ("query_key",)),
    "ai_cache": (_struct(query_key=S, response=S, fetched_at=TS), ("query_key",)),
    "fetch_log": (_struct(id=L, at=TS, url=S, strategy=S, status=I, ok=B, challenge=B, ms=I, error=S), ("id",)),
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name][0])


def ensure_column(df: DataFrame, name: str, kind: T.DataType | str) -> DataFrame:
    """Add a null column unless there is one of that name."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def conform(df: DataFrame, name: str) -> DataFrame:
    """A table's columns in order and type; those that an older file lacks are null."""
    schema = TABLES[name][0]
    for field in schema:
        df = ensure_column(df, field.name, field.dataType)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def open_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a catalogue folder, empty if it hasn't been written yet.

    Files of several generations are read with their schemas merged.
    """
    try:
        return conform(spark.read.option("mergeSchema", "true").parquet(f"{folder}/{name}"), name)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return empty(spark, name)


def save_table(df: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    conform(df, name).write.mode(mode).parquet(f"{folder}/{name}")


def commit(tables: dict[str, DataFrame], folder: str) -> int:
    """Write several tables as one new version: readers see all of it or nothing, as a version counts once its marker is there.

    Tables that aren't given are those of the version before. Versions are numbered from 1; the number is returned.
    """
    spark = next(iter(tables.values())).sparkSession
    before = versions(spark, folder)
    number = max(before, default=0) + 1
    old = before.get(number - 1, {})
    where = {}
    for name, df in tables.items():
        where[name] = f"v{number}-{uuid.uuid4().hex[:8]}"
        save_table(df, f"{folder}/{where[name]}", name)
    rows = [(number, name, at) for name, at in (old | where).items()]
    # the marker is one file that appears at once; of two writers of one number the second fails here
    spark.createDataFrame(rows, "version int, name string, folder string").coalesce(1).write.mode("error").parquet(f"{folder}/_versions/{number}")
    return number


def versions(spark: SparkSession, folder: str) -> dict[int, dict[str, str]]:
    """The committed versions: table to folder."""
    out: dict[int, dict[str, str]] = {}
    try:
        found = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/_versions").collect()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return out
    for r in found:
        out.setdefault(r["version"], {})[r["name"]] = r["folder"]
    return out


def checkout(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of a committed version (the last one), those that were never written empty."""
    found = versions(spark, folder)
    where = found.get(max(found, default=0) if version is None else version, {})
    return {name: open_table(spark, f"{folder}/{where[name]}", name) if name in where else empty(spark, name) for name in TABLES}


def get_meta(meta: DataFrame, key: str) -> str | None:
    row = meta.filter(F.col("key") == key).select("value").first()
    return row["value"] if row else None
