"""Intermediate tables in the session's shared folder, for results that a plan reads more than once."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group: a writer holds one in memory.
ROW_GROUP = 32 << 20
_TABLES: set[str] = set()
_DATABASES: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    It comes from ``spark.checkpoint.dir``. Where a session has none, a local master gets a temporary
    one; on a cluster that is an error, as executors can't read a folder of the driver's machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return context.getCheckpointDir()


def once(df: DataFrame) -> DataFrame:
    """``df`` computed once: a Parquet table in the shared folder, which survives lost executors.

    It goes when the driver's Python ends.
    """
    path = f"{shared_folder(df.sparkSession)}/once-{uuid.uuid4().hex}"
    _TABLES.add(path)
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def landing(spark: SparkSession) -> str:
    """A folder in the shared folder that isn't there yet; it goes when the driver's Python ends."""
    path = f"{shared_folder(spark)}/once-{uuid.uuid4().hex}"
    _TABLES.add(path)
    return path


def database(spark: SparkSession) -> str:
    """A database of its own in the shared folder; it goes when the driver's Python ends."""
    name = f"shelfmark_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE `{name}` LOCATION '{landing(spark)}'")
    _DATABASES.add(name)
    return name


@atexit.register
def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    for name in [*_DATABASES] if spark is not None else []:
        with contextlib.suppress(Exception):  # the session may be gone
            spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
    for path in [*_TABLES] if spark is not None else []:
        with contextlib.suppress(Exception):  # the session may be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
