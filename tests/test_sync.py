"""A sync writes once: the second run over its own results skips."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import urls
from shelfmark.operators import matching, sync
from shelfmark.sources import schema


def test_second_sync_writes_nothing(spark):
    books = spark.createDataFrame([(7, "Dune", ["Frank Herbert"], "ok"), (8, "Solaris", ["Lem"], "ok")], "source_id long, title string, authors array<string>, detail_state string")
    for c in ("subtitle", "description", "published_year", "isbn", "asin", "series_name", "series_seq"):
        books = books.withColumn(c, F.lit(None).cast("string"))
    for c in ("narrators", "genres", "tags"):
        books = books.withColumn(c, F.array().cast("array<string>"))
    items = books.select(F.concat(F.lit("i"), F.col("source_id").cast("string")).alias("item_id"), F.lit("l").alias("library_id"), F.concat(F.lit("/books/"), "title").alias("path"), F.lower("title").alias("title"), "authors", "tags", "subtitle", "description", "isbn", "asin", "narrators", "genres", F.lit(None).cast("string").alias("language"), "published_year", F.array().cast("array<string>").alias("series"))
    items = items.unionByName(items.limit(1).withColumn("item_id", F.lit("lost")).withColumn("path", F.lit("")).withColumn("title", F.lit("solaris")).withColumn("authors", F.array(F.lit("lem"))))
    maps = spark.createDataFrame([(0, "/books", "/mnt")], "pos int, from string, to string")
    folders = spark.createDataFrame([("/mnt/Dune",), ("/mnt/Solaris",)], "dir string")
    links = schema.empty(spark, "abs_links")

    def once(links):
        known = links.select(F.col("abs_item_id").alias("item_id"), "source_id", "confidence")
        matched = matching.cascade(items, known, books, "shelfmark")
        rows = sync.reconciled(items, books, matched, links, "overwrite-ours", "shelfmark")
        todo = sync.actions(rows, maps, folders).cache()
        after = sync.recorded(sync.remembered(links, matched, items), todo, F.lit("2026-01-01 00:00:00").cast("timestamp"))
        return todo, spark.createDataFrame(after.collect(), after.schema)

    todo, links = once(links)
    assert {r["item_id"]: r["action"] for r in todo.collect()} == {"i7": "write", "i8": "write", "lost": "error"}
    assert todo.filter("item_id = 'i7'").first()["folder"] == "/mnt/Dune"
    # the library now holds what was written
    written = {r["item_id"]: r["payload"] for r in todo.collect()}
    assert '"tags":["shelfmark:7"]' in written["i7"]
    items = items.withColumn("title", F.when(F.col("item_id") == "i7", "Dune").when(F.col("item_id") == "i8", "Solaris").otherwise(F.col("title"))).withColumn("tags", F.when(F.col("item_id") != "lost", F.array(F.concat(F.lit("shelfmark:"), F.substring("item_id", 2, 9)))).otherwise(F.col("tags"))).withColumn("language", F.when(F.col("item_id") != "lost", "ukr"))
    again, links = once(links)
    assert {r["item_id"]: r["action"] for r in again.collect()} == {"i7": "skip", "i8": "skip", "lost": "error"}


def test_prepared_folders_and_covers(spark):
    books = spark.createDataFrame([(1, "T", ["A/B"], "S", "2")], "source_id long, title string, authors array<string>, series_name string, series_seq string")
    assert sync.prepared(spark.createDataFrame([(1,)], "source_id long"), books).first()["folder"] == "A B/S/2 - T"
    df = spark.createDataFrame([("image/PNG; q=1", None), (None, "https://x/y/c.WEBP?a=1.png"), ("text/html", "https://x/c"), ("image/jpeg", "https://x/c.png")], "t string, u string")
    assert [r[0] for r in df.select(urls.cover_extension(F.col("t"), F.col("u"))).collect()] == [".png", ".webp", ".jpg", ".jpg"]
    assert df.select(urls.playlist_url(F.lit("5-a b"))).first()[0] == f"{urls.BASE}/m33u2/5-a%20b.m3u"
