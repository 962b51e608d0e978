"""Landed pages by kind and day."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from shelfmark.sources import landed
from shelfmark.staging import landing

SCHEMA = "page_id long, html string"


def _land(spark, folder, rows):
    df = spark.createDataFrame(rows, "page_id long, html string, of string, at timestamp_ntz")
    landed.land(df, folder, F.col("of"), F.col("at"))
    return landed.landed(spark, folder, SCHEMA)


def _rows(spark):
    return [(r["id"], f"<p>{r['id']}</p>", r["of"], r["at"]) for r in spark.sql("SELECT id, IF(id % 3 = 0, 'listing', 'book') AS of, CAST(timestampadd(DAY, CAST(id % 5 AS INT), TIMESTAMP_NTZ '2024-01-01 23:30:00') AS TIMESTAMP_NTZ) AS at FROM range(60)").collect()]


def test_only_wanted_days_are_opened(spark):
    folder = landing(spark)
    pages = _land(spark, folder, _rows(spark))
    log = spark.createDataFrame([("book", k, 1 if k == 2 else 9, 9) for k in range(1, 6)] * 2, "kind string, d int, n_done int, n_pages int")
    log = log.withColumn("day", F.make_date(F.lit(2024), F.lit(1), F.col("d")))
    got = landed.open_days(pages, log)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    for f in glob.glob(f"{folder.removeprefix('file:')}/kind=*/day=*/*.parquet"):  # files that may not be opened
        if "kind=book/day=2024-01-02" not in f:
            with open(f, "wb") as out:
                out.write(b"no parquet")
    assert sorted(r["page_id"] for r in got.collect()) == [k for k in range(60) if k % 3 and k % 5 == 1]
    assert pages.filter("kind = 'book' AND day = DATE'2024-01-02'").count() == 8


def test_a_landing_may_come_twice(spark):
    folder, rows = landing(spark), _rows(spark)
    _land(spark, folder, rows)
    again = [r for r in rows if r[2] == "book"][:10]
    days = {(r[2], r[3].date()) for r in again}
    pages = _land(spark, folder, again)
    kept = [r for r in rows if (r[2], r[3].date()) not in days]
    assert sorted(r["page_id"] for r in pages.collect()) == sorted(r[0] for r in kept + again)


def test_nulls_and_clashing_names(spark):
    folder = landing(spark)
    df = spark.createDataFrame([(1, None, None, None, "x", 3), (2, "", "book", None, "x", 3)], "page_id long, html string, of string, at timestamp_ntz, kind string, day int")
    landed.land(df, folder, F.col("of"), F.col("at"))
    got = landed.landed(spark, folder, SCHEMA)
    assert sorted((r["page_id"], r["kind"], r["day"]) for r in got.collect()) == [(1, None, None), (2, "book", None)]
    assert landed.of_days(got, got).count() == 0
