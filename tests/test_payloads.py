"""Base64 payloads and signatures."""

from __future__ import annotations

import base64
import json

from pyspark.sql import functions as F

from shelfmark.functions import payloads
from shelfmark.operators import downloads
from shelfmark.sources import library


def test_base64_is_lenient(spark):
    raw = bytes(range(256))
    cases = {
        base64.b64encode(raw).decode(): raw,
        base64.urlsafe_b64encode(raw).decode().rstrip("="): raw,
        "data:image/png;base64," + base64.b64encode(b"ab").decode(): b"ab",
        "YW\nJj ZA==": b"abcd",
        "YQ==YQ==": b"a",
        "YWJjZ": b"abc",  # six bits are no byte
        "!?": b"",
        "": b"",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", payloads.base64_bytes(F.col("t")).alias("b"))
    got = {r["t"]: None if r["b"] is None else bytes(r["b"]) for r in df.collect()}
    assert got == {**cases, None: None}


def test_signatures(spark):
    cases = [
        (b"\xff\xd8\xff", "image/jpeg", "jpeg"), (b"\xff\xd8", None, None), (b"\x89PNG\r\n\x1a\n", "image/png", "png"), (b"\x89PNG", None, None), (b"\x89PNGabcd", "image/png", "png"),
        (b"RIFF\0\0\0\0WEBP", "image/webp", "webp"), (b"RIFF\0\0\0\0WEB", None, None), (b"RIFF\0\0\0\0WAVE", None, None), (b"", None, None), (None, None, None),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, c binary")
    got = df.select("k", payloads.content_type(F.col("c")), library.image_kind(F.col("c"))).orderBy("k").collect()
    assert [(r[1], r[2]) for r in got] == [c[1:] for c in cases]


def test_pages_in_a_files_place(spark):
    cases = {b"<!DOCTYPE html>": True, b"\xef\xbb\xbf\n <HTML lang=x>": True, b"x" * 50 + b"_cf_chl_opt": True, b"x" * 60 + b"_cf_chl": False, b"<p>": False, b"\xff\xd8<html": False, b"": False}
    df = spark.createDataFrame([(k,) for k in cases], "c binary").select("c", payloads.looks_like_html(F.col("c")).alias("h"))
    assert {bytes(r["c"]): r["h"] for r in df.collect()} == cases


def test_downloads(spark):
    big, page = base64.b64encode(b"\xff\xd8\xff" + b"x" * 80).decode(), base64.b64encode(b"<html>" + b"x" * 80).decode()
    bodies = [
        {"solution": {"download": {"data": big}}}, {"solution": {"download": [{"encoded_data": page}]}}, {"solution": {"responseEncoding": "base64", "response": big}}, {"solution": {"response": big}},
        {"solution": {"download": {"data": ""}, "responseEncoding": "base64", "response": big}}, {"solution": {"download": {"data": "YQ=="}}}, {"solution": None}, {"solution": {"download": []}},
    ]
    rows = [(k, json.dumps(b), "own") for k, b in enumerate(bodies)] + [(8, None, "own"), (9, "no json", "own")]
    got = downloads.downloads(spark.createDataFrame(rows, "id int, body string, outcome string")).orderBy("id").collect()
    assert [r["outcome"] for r in got] == ["ok", "html", "ok", "missing", "ok", "short", "missing", "missing", "missing", "missing"]
    assert all((r["content_type"] == "image/jpeg" and len(r["content"]) == 83) == (r["outcome"] == "ok") for r in got)
    assert all(r["content"] is None for r in got if r["outcome"] != "ok")


def test_a_body_and_a_link_are_computed_once_however_often_they_are_named(spark):
    from shelfmark.functions import payloads, urls
    from shelfmark.operators import downloads

    rows = spark.createDataFrame([("x",)], "zz string")
    for c in (downloads.encoded_payload(F.col("zz")), payloads.base64_bytes(F.col("zz")), urls.book_ref(urls.absolute(F.col("zz"))), urls.facet_key(F.col("zz"), "author"), urls.category_key(F.col("zz"))):
        plan = rows.select(c.alias("out"))._jdf.queryExecution().analyzed().toString().split("\n")[0]
        assert plan.count("zz#") == 1


def test_a_page_is_parsed_once(spark):
    from shelfmark.operators import pages

    rows = spark.createDataFrame([("https://catalogue.example.org/1-x.html", "<p>no book</p>")], "url string, html string")
    plan = pages.parse_books(rows, "https://catalogue.example.org").select("source_id", "title")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_raw_book_udf(") == 1
