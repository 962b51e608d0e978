"""Catalogue tables stored by hash buckets of their key, so that a merge shuffles its batch and never the table.

A stored table is a Spark table with ``bucketBy`` on its key. Its scan is partitioned by the key already: the join of a merge
moves the batch to the table's buckets and leaves the table where it is, and as a task holds a bucket, its result is
written as the next table without another exchange. Which table holds the rows now says a view, replaced once the next table is whole;
a merge that dies leaves a table that nobody reads, and the next one writes over it. One writer at a time; a key that is
null matches nothing, as in ``merge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge as m

_VERSION, _BUCKETS, _KEYS = "shelfmark_version", "shelfmark_buckets", "shelfmark_keys"


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def _at(name: str, version: int) -> str:
    return f"{name}_v{version}"


def _known(spark: SparkSession, name: str) -> tuple[int, int, list[str]]:
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {_quoted(name)}").collect()}
    return int(found[_VERSION]), int(found[_BUCKETS]), found[_KEYS].split(",")


def _put(df: DataFrame, name: str, version: int, buckets: int, keys: list[str]) -> DataFrame:
    spark, table = df.sparkSession, _at(name, version)
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(table)}")
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(table)
    told = f"'{_VERSION}' = '{version}', '{_BUCKETS}' = '{buckets}', '{_KEYS}' = '{','.join(keys)}'"
    spark.sql(f"CREATE OR REPLACE VIEW {_quoted(name)} TBLPROPERTIES ({told}) AS SELECT * FROM {_quoted(table)}")
    return spark.table(name)


def _next(df: DataFrame, name: str) -> DataFrame:
    """``df`` is the stored table from now on. The table before is kept for readers that began with it, older ones go."""
    version, buckets, keys = _known(df.sparkSession, name)
    out = _put(df, name, version + 1, buckets, keys)
    if version:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {_quoted(_at(name, version - 1))}")
    return out


def create(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Store ``df`` by ``buckets`` hash buckets of ``keys``, one file a bucket: rows are moved there once and stay.

    Merges join on ``keys``. Take buckets of a few hundred MB; a bucket is a task, and their number can't be changed by a merge.
    """
    return _put(df.repartition(buckets, *[F.col(k) for k in keys]), name, 0, buckets, keys)


def version_of(spark: SparkSession, name: str) -> int:
    """How often a stored table was written since it was created."""
    return _known(spark, name)[0]


def merged(spark: SparkSession, name: str, batch: DataFrame, rules: dict[str, str], order: str | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """The rows of a stored table with a batch merged in by the rules of ``merge.merge``; only the batch is shuffled."""
    return m.merge(spark.table(name), batch, _known(spark, name)[2], rules, order, defaults)


def merge_into(spark: SparkSession, name: str, batch: DataFrame, rules: dict[str, str], order: str | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Merge a batch into a stored table; readers see the old rows until the new ones are whole, then those."""
    return _next(merged(spark, name, batch, rules, order, defaults), name)


def children_replaced(spark: SparkSession, name: str, parents: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a table stored by its parent's key after ``merge.replace_children``; kept rows stay in their buckets."""
    _, buckets, parent = _known(spark, name)
    return m.replace_children(spark.table(name), parents, new.repartition(buckets, *[F.col(k) for k in parent]), parent[0], keys)


def replace_children_into(spark: SparkSession, name: str, parents: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the children of ``parents`` by those in ``new``, once a key each."""
    return _next(children_replaced(spark, name, parents, new, keys), name)


def drop(spark: SparkSession, name: str) -> None:
    """Remove a stored table: its view and the tables behind it."""
    version = version_of(spark, name)
    spark.sql(f"DROP VIEW IF EXISTS {_quoted(name)}")
    for k in (version - 1, version, version + 1):  # the last one may be what a lost merge left
        if k >= 0:
            spark.sql(f"DROP TABLE IF EXISTS {_quoted(_at(name, k))}")
