"""Tables stored by buckets of their key: the same rows as plain merges, and plans that leave the table where it is."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import merge
from shelfmark.sources import stored
from shelfmark.staging import database

BOOKS = "source_id long, url string, title string, rating double, detail_state string"
RULES = {"url": merge.OVERWRITE, "title": merge.KEEP_TEXT, "rating": merge.TAKE}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges_above_scan(plan: str, table: str) -> list[str]:
    """The exchanges between the plan's root and the scan of ``table``: lines on the way up that are indented less."""
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if "FileScan" in line and table in line)
    deep, found = re.search(r"[A-Za-z*]", lines[at]).start(), []
    for line in reversed(lines[:at]):
        here = re.search(r"[A-Za-z*]", line).start()
        if here < deep:
            deep = here
            if "Exchange" in line:
                found.append(line)
    return found


@pytest.fixture
def books(spark):
    name = f"{database(spark)}.books"
    old = spark.range(1000).select(F.col("id").alias("source_id"), F.concat(F.lit("u"), "id").alias("url"), F.when(F.col("id") % 2 == 0, "").otherwise("old").alias("title"), F.lit(1.0).alias("rating"), F.lit("ok").alias("detail_state"))
    stored.create(old, name, ["source_id"], 8)
    return name, old


def batch_of(spark, start, end):
    return spark.range(start, end).select(F.col("id").alias("source_id"), F.concat(F.lit("v"), "id").alias("url"), F.lit("new").alias("title"), F.when(F.col("id") % 3 == 0, 2.0).alias("rating"))


def test_merges_equal_plain_ones(spark, books):
    name, want = books
    for k, (start, end) in enumerate(((900, 1100), (0, 5), (2000, 2000), (1050, 1200))):
        batch = batch_of(spark, start, end)
        want = merge.merge(want, batch, ["source_id"], RULES, None, {"detail_state": F.lit("pending")})
        got = stored.merge_into(spark, name, batch, RULES, None, {"detail_state": F.lit("pending")})
        assert stored.version_of(spark, name) == k + 1
        assert sorted(got.collect()) == sorted(want.collect())
    assert spark.table(name).count() == 1200


def test_merge_shuffles_the_batch_only(spark, books):
    name, _ = books
    for _ in range(2):  # the table that a merge wrote is as good as the one that was created
        plan = plan_of(stored.merged(spark, name, batch_of(spark, 0, 10), RULES))
        assert "Bucketed: true" in plan and plan.count("Exchange") == 1
        assert exchanges_above_scan(plan, "books_v") == []
        stored.merge_into(spark, name, batch_of(spark, 0, 10), RULES)
    files = spark.table(name).inputFiles()
    assert len(files) == 8 and len({re.search(r"_(\d{5})\.c", f)[1] for f in files}) == 8


def test_result_is_written_as_it_is(spark, books):
    """The plan that writes has the batch's exchange and no other."""
    name, _ = books
    spark.range(1).count()
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("merge", "merge")
    stored.merge_into(spark, name, batch_of(spark, 0, 10), RULES)
    stages = {s for j in jobs.getJobIdsForGroup("merge") for s in jobs.getJobInfo(j).stageIds}
    spark.sparkContext._jsc.clearJobGroup()
    assert len(stages) - len([s for s in stages if jobs.getStageInfo(s) is None]) <= 3


def test_readers_keep_the_rows_they_began_with(spark, books):
    name, old = books
    before = spark.table(name)
    stored.merge_into(spark, name, batch_of(spark, 0, 10), RULES)
    assert sorted(before.collect()) == sorted(old.collect())


def test_a_lost_merge_changes_nothing(spark, books):
    name, old = books
    fail = F.udf(lambda x: 1 / 0, "string")
    with pytest.raises(Exception):
        stored.merge_into(spark, name, batch_of(spark, 0, 10).withColumn("url", fail("url")), RULES)
    assert stored.version_of(spark, name) == 0 and sorted(spark.table(name).collect()) == sorted(old.collect())
    assert stored.merge_into(spark, name, batch_of(spark, 0, 10), RULES).filter("url like 'v%'").count() == 10


def test_null_keys_and_repeated_rows(spark, books):
    name, _ = books
    batch = spark.createDataFrame([(1, "a", "x", 3.0, 1), (1, "b", None, None, 2), (None, "n", None, None, 3)], "source_id long, url string, title string, rating double, seq long")
    got = stored.merge_into(spark, name, batch, RULES, "seq")
    assert got.filter("source_id = 1").select("url", "title", "rating").first() == ("b", "old", 3.0)
    assert got.count() == 1001 and got.filter("source_id is null").count() == 1


def test_children(spark):
    name = f"{database(spark)}.book_tags"
    old = spark.range(100).select((F.col("id") % 20).alias("source_id"), F.concat(F.lit("t"), "id").alias("tag"))
    stored.create(old, name, ["source_id"], 4)
    parents = spark.createDataFrame([(3,), (3,), (4,), (None,)], "source_id long")
    new = spark.createDataFrame([(3, "x"), (3, "x"), (3, "y")], "source_id long, tag string")
    want = merge.replace_children(old, parents, new, "source_id", ["source_id", "tag"])
    plan = plan_of(stored.children_replaced(spark, name, parents, new, ["source_id", "tag"]))
    assert exchanges_above_scan(plan, "book_tags_v") == []
    got = stored.replace_children_into(spark, name, parents, new, ["source_id", "tag"])
    assert sorted(got.collect()) == sorted(want.collect())
    stored.drop(spark, name)
    assert spark.sql(f"SHOW TABLES IN `{name.split('.')[0]}`").count() == 0
