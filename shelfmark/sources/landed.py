"""Landed pages by kind and day, so that a crawl or a backfill opens the files of the days it asks for and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import once

#: Places that a day's pages of a kind are dealt over when they are written: a day may hold a third of all pages.
DEAL = 16


def land(pages: DataFrame, folder: str, kind: Column, at: Column, deal: int = DEAL) -> None:
    """Write pages by kind and day; days that were landed before are replaced as a whole, so that a landing may come twice.

    Pages without a kind or a time stand under the null of that column. Columns named kind and day are replaced.
    """
    rows = pages.withColumns({"kind": kind.cast("string"), "day": F.to_date(at)})
    dealt = rows.repartition("kind", "day", F.pmod(F.xxhash64(*[c for c in pages.columns if c not in ("kind", "day")]), F.lit(deal)))
    dealt.write.partitionBy("kind", "day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder)


def landed(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """All landed pages: the columns of ``schema``, kind and day. Filters on these two choose folders."""
    columns = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    own = [f for f in columns if f.name not in ("kind", "day")]
    return spark.read.schema(T.StructType([*own, T.StructField("kind", T.StringType()), T.StructField("day", T.DateType())])).parquet(folder)


def of_days(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pages of the (kind, day) pairs in ``wanted``, each once, whatever is repeated there; nulls are wanted by nobody.

    The pairs are written first, so that Spark knows their size: below its threshold for broadcasts they prune the folders
    while the query runs, above it the join is one like others.
    """
    pairs = once(wanted.groupBy("kind", "day").agg(F.count(F.lit(1)).alias("asked")))
    # Spark prunes by a side that a comparison has narrowed
    return pages.join(pairs.filter("asked > 0").select("kind", "day"), ["kind", "day"], "left_semi")


def open_days(pages: DataFrame, log: DataFrame) -> DataFrame:
    """The pages of the days that the log (kind, day, n_done, n_pages) doesn't tell as done to the end."""
    return of_days(pages, log.filter("n_done < n_pages"))
