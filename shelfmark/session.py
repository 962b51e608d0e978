"""A session with the settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "shelfmark", **settings: str) -> SparkSession:
    """ANSI mode, UTC and adaptive execution; partition counts are left to the cluster's settings."""
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
