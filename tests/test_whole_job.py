"""Registered queries over all of their rows, against their SQL."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from shelfmark.plans.registry import ORACLE_SQL, QUERIES


def _compare(spark, sf, name, sql):
    c = duckdb.connect()
    for t in ("supplier", "nation", "part", "lineitem", "orders", "documents"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    plain = lambda rows: sorted(repr([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)
    rel = c.execute(sql)
    names = [d[0] for d in rel.description]
    got = QUERIES[name](spark, sf).select(*names).collect()
    assert plain(got) == plain(rel.fetchall())
    return got


def test_every_part_is_a_library_item(spark, sf):
    parts = {f"item{r[0]}" for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()}
    got = _compare(spark, sf, "match_cascade", ORACLE_SQL["match_cascade"])
    assert {r["item_id"] for r in got} == parts
    found = {r["item_id"] for r in _compare(spark, sf, "fuzzy_top5", ORACLE_SQL["fuzzy_top5"])}
    assert len(found) > len(parts) / 2


def test_no_registered_sql_takes_a_part_of_a_table():
    import re

    for name in ("tokenise_title", "mostly_latin", "fuzzy_top5", "match_cascade", "formatted", "listing_cards", "listing_last_page", "page_parse_books"):
        assert not re.search(r"substr\(text|% 20 = 0|< 3600\b(?! )|source_id < 400|size % 5 <> 0", ORACLE_SQL[name]), name


def test_texts_are_read_to_their_end(spark, sf):
    # sf0.01: on the smallest tables the first 80 characters hold the same words
    sf = sf.replace("sf0.001", "sf0.01")
    assert _compare(spark, sf, "tokenise_title", ORACLE_SQL["tokenise_title"])
    assert _compare(spark, sf, "mostly_latin", ORACLE_SQL["mostly_latin"])


def test_a_late_word_and_a_late_script_count(spark, tmp_path):
    rows = [(k, "a b c " * 20 + "Latecomer") for k in range(3)] + [(k, "latin words " * 5 + "кириллица " * 20) for k in range(3, 6)] + [(k, "кириллица " * 5 + "latin words " * 30) for k in range(6, 9)]
    spark.createDataFrame([*rows, (9, ""), (10, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokens = {r["doc_id"]: r["tokens"] for r in QUERIES["tokenise_title"](spark, str(tmp_path)).collect()}
    latin = {r["doc_id"]: r["latin"] for r in QUERIES["mostly_latin"](spark, str(tmp_path)).collect()}
    assert all(tokens[k] == "latecomer" for k in range(3)) and len(tokens) == len(latin) == 11
    assert all(latin[k] == (k < 3 or 6 <= k < 9) for k in latin)


def test_result_pages_past_the_five_hundredth(spark):
    """A library of more than 501 full pages is read whole; only a given last page ends it sooner."""
    from shelfmark.sources import library

    pages = spark.range(701).select(F.lit("a").alias("library"), F.col("id").alias("page"), F.concat(F.lit('{"results":[{"id":"'), F.col("id").cast("string"), F.lit('"}]}')).alias("json"))
    assert library.result_pages(pages, 1).count() == 701
    assert library.result_pages(pages, 1, last=500).count() == 501


def _over(tmp_path, name, sql, **tables):
    """A query over tables of a folder, and what its SQL gives over them."""
    c = duckdb.connect()
    for t, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        spark = rows.sparkSession
    rel = c.execute(sql)
    names = [d[0] for d in rel.description]
    return sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*names).collect())), sorted(rel.fetchall())


def test_limiter_fold_counts_by_microseconds_at_the_nearest_millisecond(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:00:0{k}.0006", 1, "error") for k in range(3)] + [(8, "2024-01-01 00:00:00.0001", 2, "error"), (7, "2024-01-01 00:00:00.0003", 2, "click")]
    events = spark.createDataFrame([(*r, 1.0, "") for r in rows], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got, want = _over(tmp_path, "limiter_fold", ORACLE_SQL["limiter_fold"], events=events)
    assert got == want and [r[3] for r in got] == [1704067202001 + 600_000, None]


def test_page_text_keeps_references_that_were_cut_off(spark, tmp_path):
    pages = spark.createDataFrame([(1, "", "<p>a &amp; b&amp</p><p>&lt;c&gt &notit; &ampx; &#39;&</p>"), (2, "", None)], "page_id long, url string, html string")
    got, want = _over(tmp_path, "page_text", ORACLE_SQL["page_text"], pages=pages.filter("page_id = 1"))
    assert got == want
    from shelfmark.operators.pages import html_to_text

    assert [r[0] for r in pages.orderBy("page_id").select(html_to_text("html")).collect()] == ["a & b&amp\n\n<c&gt &notit; &ampx; '&", ""]


def test_a_name_that_many_authors_bear_is_listed_once_a_book(spark, sf, tmp_path):
    """Joined with every bearer of a name, the lists of books grow with the square of the copies."""
    from shelfmark.plans.content_queries import _matched_tables
    from shelfmark.plans.testviews import Views

    for name, key in (("part", "p_partkey"), ("supplier", "s_suppkey"), ("lineitem", "l_suppkey")):
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        if name == "part":
            rows.write.parquet(str(tmp_path / "part.parquet"))
            continue
        copies = rows.crossJoin(spark.range(3).withColumnRenamed("id", "copy")).withColumn(key, F.col(key) + F.col("copy") * 1_000_000)
        copies.drop("copy").write.parquet(str(tmp_path / f"{name}.parquet"))
    _, books = _matched_tables(Views(spark, str(tmp_path)))
    _, plain = _matched_tables(Views(spark, sf))
    lists = lambda df: {r["source_id"]: r["authors"] for r in df.collect()}
    assert lists(books) == lists(plain) and any(len(a) > 1 for a in lists(books).values())
    rows = lambda at: sorted(QUERIES["nearest_books"](spark, at).collect())
    assert rows(str(tmp_path)) == rows(sf)


def test_narrators_are_normalised_once_a_book_and_lineitem_is_dealt_by_book(spark, sf):
    from shelfmark.operators import selection
    from shelfmark.plans.catalogue_queries import _scored
    from shelfmark.plans.testviews import Views

    v = Views(spark, sf)
    plan = _scored(v, v.titles.select("source_id")).select("source_id", "blocked", "score")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(narrators") == 1
    # no aggregate by (book, narrator) comes before that by book
    assert "Aggregate [source_id" in plan and "narrator_key" not in plan
    books = [(1, ["X. One", "Two"]), (2, ["two"]), (3, ["Zed", "ONE"]), (4, []), (5, None), (6, ["..."])]
    rows = spark.createDataFrame(books, "source_id long, narrators array<string>").selectExpr("*", "1 duration_sec", "'' description", "'' series_key", "'' detail_state", "cast(null as double) rating", "0L votes")
    got = selection.with_score(rows, ["two", "one", "!"], ["zed"]).select("source_id", "blocked", "preferred_index").collect()
    assert {tuple(r) for r in got} == {(1, False, 0), (2, False, 0), (3, True, 1), (4, False, None), (5, False, None), (6, False, None)}
