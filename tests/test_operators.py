"""Merges, the queue, editions, matching, sidecars, playlists, pages and telemetry on small tables."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import catalog, matching, merge, pages, playlist, queue, selection, sidecar, telemetry
from shelfmark.sources import config, library, schema



def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_merge_rules(spark):
    s = "k int, o string, t string, p string, e string, g int, i string"
    old = spark.createDataFrame([(1, "a", "a", "a", "", 3, "a"), (2, "b", "b", None, "x", 1, "b")], s)
    new = spark.createDataFrame([(1, None, None, "n", "n", 2, "n"), (2, "n", "n", "n", "n", 5, "n"), (3, "n", None, None, None, None, "n")], s)
    rules = {"o": merge.OVERWRITE, "t": merge.TAKE, "p": merge.KEEP, "e": merge.KEEP_TEXT, "g": merge.GREATEST, "i": merge.INSERT_ONLY}
    got = rows(merge.merge(old, new, ["k"], rules), "k")
    assert got == [(1, None, "a", "a", "n", 3, "a"), (2, "n", "n", "n", "x", 5, "b"), (3, "n", None, None, None, None, "n")]
    again = merge.merge(merge.merge(old, new, ["k"], rules), new, ["k"], rules)
    assert rows(again, "k") == got


def test_merge_applies_a_batch_in_order(spark):
    s = "k int, t string, p string, e string, o string"
    old = spark.createDataFrame([(1, "old", None, "", "old")], s)
    batch = [(1, 1, "x", None, "", "1"), (1, 2, None, "first", "e", None), (1, 3, "y", "later", "f", None), (2, 1, None, None, None, "z")]
    new = spark.createDataFrame(batch, "k int, n int, t string, p string, e string, o string")
    rules = {"t": merge.TAKE, "p": merge.KEEP, "e": merge.KEEP_TEXT, "o": merge.OVERWRITE}
    once = rows(merge.merge(old, new, ["k"], rules, "n"), "k")
    step = old
    for n in (1, 2, 3):
        step = merge.merge(step, new.filter(F.col("n") == n).drop("n"), ["k"], rules)
    assert once == rows(step, "k") == [(1, "y", "first", "e", None), (2, None, None, None, "z")]


def test_children_and_deletes(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "source_id long, tag string")
    new = spark.createDataFrame([(1, "c"), (1, "c")], "source_id long, tag string")
    assert rows(merge.replace_children(old, new, new, "source_id", ["source_id", "tag"]), "source_id", "tag") == [(1, "c"), (2, "a")]
    assert rows(merge.insert_or_ignore(old, spark.createDataFrame([(1, "a"), (3, "z"), (3, "z")], old.schema), ["source_id", "tag"]), "source_id", "tag") == [(1, "a"), (1, "b"), (2, "a"), (3, "z")]
    assert rows(merge.delete_keys(old, new, ["source_id"])) == [(2, "a")]
    assert rows(merge.keep_newest(spark.range(10), 3), "id") == [(7,), (8,), (9,)]


def test_schema_evolution(spark, tmp_path):
    old = spark.createDataFrame([("k", "Name")], "key string, name string")
    assert schema.conform(old, "authors").columns == ["key", "name", "book_count", "hardcover_author_id", "hardcover_slug"]
    schema.save_table(old, str(tmp_path), "authors")
    assert schema.open_table(spark, str(tmp_path), "authors").count() == 1
    assert schema.open_table(spark, str(tmp_path), "queue").count() == 0
    meta = spark.createDataFrame([("a", "1")], "key string, value string")
    assert schema.get_meta(meta, "a") == "1" and schema.get_meta(meta, "b") is None


def _queue(spark, data):
    return spark.createDataFrame([(i, s, r, st, n, datetime(2025, 1, 1), datetime(2025, 1, 1)) for i, s, r, st, n in data], schema.TABLES["queue"][0])


def test_queue_lifecycle(spark):
    q = _queue(spark, [(1, 10, "r", "new", None), (2, 11, "r", "ignored", "why"), (3, 12, "r", "accepted", None)])
    wanted = spark.createDataFrame([(10, "x"), (11, "y"), (12, "z"), (13, "w")], "source_id long, reason string")
    links = spark.createDataFrame([(10,), (12,)], "source_id long")
    after = queue.transition(q, wanted, links, now())
    got = rows(after.select("id", "source_id", "reason", "state"), "id")
    assert got == [(1, 10, "x", "synced"), (2, 11, "y", "ignored"), (3, 12, "r", "accepted"), (4, 13, "w", "new")]
    assert rows(queue.counters(wanted, q, links)) == [(1, 1, 2)]
    second = queue.transition(after, wanted, links, now())
    assert rows(second.select("id", "source_id", "reason", "state"), "id") == got
    done = queue.set_state(after, spark.createDataFrame([(2, "new", None), (4, "accepted", "ok")], "id long, state string, note string"), now())
    assert rows(done.filter("id in (2, 4)").select("state", "note"), "id") == [("new", "why"), ("accepted", "ok")]
    left, kept = queue.delete_entries(after, links, spark.createDataFrame([(1,)], "id long"))
    assert left.count() == 3 and rows(kept) == [(12,)]


def _editions(spark, data):
    return spark.createDataFrame(data, "source_id long, work_key string, narrators array<string>, rating double, votes int, series_key string, duration_sec int, description string, detail_state string")


def test_editions(spark):
    e = _editions(
        spark,
        [
            (1, "w", ["Preferred One"], 2.0, 1, None, None, None, "ok"),
            (2, "w", ["Other"], 5.0, 100, None, None, None, "ok"),
            (3, "w", ["Blocked"], 5.0, 100, None, None, None, "ok"),
            (4, "alone", ["Blocked"], 5.0, 100, None, None, None, "ok"),
            (5, "votes", [], 5.0, 1, None, None, None, "ok"),
            (6, "votes", [], 4.4, 300, None, None, None, "ok"),
            (7, None, [], None, None, None, None, None, "ok"),
        ],
    )
    scored = selection.with_score(e, ["preferred one", ""], ["blocked"]).withColumn("work_key", selection.group_key())
    best = {r["work_key"]: r["source_id"] for r in selection.best_editions(scored, ["work_key"]).collect()}
    assert best == {"w": 1, "alone": 4, "votes": 6, "unkeyed:7": 7}
    ranked = selection.rank_editions(scored, ["work_key"])
    assert rows(ranked.filter("place = 1").select("work_key", "source_id")) == rows(selection.best_editions(scored, ["work_key"]).select("work_key", "source_id"), "work_key") or {r[1] for r in rows(ranked.filter("place = 1").select("work_key", "source_id"))} == set(best.values())
    assert rows(selection.alternatives(ranked, ["work_key"]).filter("work_key = 'w'").select("source_id"), "rank") == [(2,), (3,)]
    assert rows(scored.filter("source_id = 1").select("reasons"))[0][0][0].startswith("preferred narrator #1")


def test_listing_detail_and_siblings(spark):
    books = schema.empty(spark, "books")
    cards = spark.createDataFrame([(1, "u", "s", "T", None, 60, 4.0, 3, 1), (1, "u2", "s", "", "c", None, None, None, 2)], "source_id long, url string, slug string, title string, cover_url string, duration_sec int, rating double, votes int, n int")
    one = catalog.record_listing(books, cards, now(), "n")
    assert rows(one.select("url", "title", "cover_url", "duration_sec", "rating", "detail_state")) == [("u2", "T", "c", 60, 4.0, "pending")]
    facet = spark.createDataFrame([(1, "k", "K")], "source_id long, series_key string, series_name string")
    assert rows(catalog.attach_facet_series(one, facet).select("series_key")) == [("k",)]
    parsed = spark.createDataFrame([(1, "u", "s", "Title", None, [("a", "A B")])], "source_id long, url string, slug string, title string, description string, authors array<struct<key:string,name:string>>")
    for c, t in (("cover_url", "string"), ("duration_sec", "int"), ("rating", "double"), ("votes", "int"), ("narrators", "array<string>"), ("genres", "array<string>"), ("tags", "array<string>"), ("series_key", "string"), ("series_name", "string"), ("series_seq", "string")):
        parsed = parsed.withColumn(c, F.lit(None).cast(t))
    done = catalog.record_detail(one, parsed, now())
    assert rows(done.select("title", "rating", "detail_state", "work_label")) == [("Title", None, "ok", "a b|title")]
    assert rows(catalog.mark_state(done, spark.createDataFrame([(1, "pending", "boom")], "source_id long, detail_state string, detail_error string"), now()).select("detail_state", "detail_error")) == [("pending", "boom")]
    fresh = catalog.new_siblings(spark.createDataFrame([(1,), (2,), (2,), (None,)], "related_id long"), done)
    assert rows(fresh.select("source_id", "detail_state")) == [(2, "pending")]


def test_dice_pairs_equal_brute_force(spark):
    import random

    from tests.test_text import _dice

    random.seed(3)
    texts = ["".join(random.choice("abcd") for _ in range(random.randint(0, 9))) for _ in range(80)] + ["aaaa", "aaaaa", "aa"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for t in (0.3, 0.86):
        got = {(a, b): d for a, b, d in rows(matching.dice_pairs(df, "id", "t", t))}
        want = {(a, b): _dice(texts[a], texts[b]) for a in range(len(texts)) for b in range(a + 1, len(texts)) if min(len(texts[a]), len(texts[b])) >= 2 and _dice(texts[a], texts[b]) >= t}
        assert got == pytest.approx(want)


def test_containing_equals_brute_force(spark):
    needles, texts = ["", "a", "ab", "abc", "abcd", "bcda", "zz", "dab", "abcdabcd"], ["", "a", "abc", "abcdabcd", "dabc", "xbcdax", "é"]
    one = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = rows(matching.containing(one, spark.createDataFrame([(t,) for t in texts], "text string")))
    assert sorted(got) == sorted((n, t) for n in needles for t in texts if n and n in t)


def test_cascade(spark):
    books = spark.createDataFrame([(1, "Dune Messiah", ["Frank Herbert"], "ok"), (2, "Solaris", ["Lem"], "ok"), (3, "Hidden Thing", [], "pending")], "source_id long, title string, authors array<string>, detail_state string")
    items = spark.createDataFrame([("a", "anything", [], []), ("b", "x", [], ["other", " SHELF:2 "]), ("c", "dune messiah", ["frank herbert"], ["shelf:9"]), ("d", "Hidden Thing", [], []), ("e", "", [], [])], "item_id string, title string, authors array<string>, tags array<string>")
    links = spark.createDataFrame([("a", 1, None), ("e", 77, 0.5)], "item_id string, source_id long, confidence double")
    got = rows(matching.cascade(items, links, books, "shelf"), "item_id")
    assert got == [("a", 1, 1.0, "existing-link"), ("b", 2, 1.0, "tag"), ("c", 1, 1.0, "fuzzy"), ("d", None, 0.0, "none"), ("e", None, 0.0, "none")]


def test_paths(spark):
    maps = spark.createDataFrame([(0, "/books", "/mnt/a"), (1, "/books/fantasy/", "D:\\f\\"), (2, "", "/no")], "pos int, from string, to string")
    paths = spark.createDataFrame([(1, "/books/x"), (2, "/books/fantasy/y"), (3, "/booksy/z"), (4, "/books"), (5, ""), (6, None)], "id long, path string")
    got = {r["id"]: r["mapped"] for r in matching.map_paths(paths, maps).collect()}
    assert got == {1: "/mnt/a/x", 2: "D:/f/y", 3: "/booksy/z", 4: "/mnt/a", 5: "", 6: None}
    assert {r["id"]: r["mapped"] for r in matching.map_paths(spark.createDataFrame([(1, "/mnt/a/q")], "id long, path string"), maps, inverse=True).collect()} == {1: "/books/q"}


def _cards(spark, desired, current, previous):
    import json

    card = lambda c: None if c is None else json.dumps(c)
    df = spark.createDataFrame([(card(desired), card(current), card(previous))], "d string, c string, p string")
    return df.select(F.from_json("d", sidecar.SCHEMA).alias("desired"), F.from_json("c", sidecar.SCHEMA).alias("current"), sidecar.previous(F.col("p")).alias("previous"))


@pytest.mark.parametrize(
    ("policy", "current", "previous", "title", "changed"),
    [
        ("fill-empty", {"title": "Theirs"}, None, "Theirs", []),
        ("fill-empty", {"title": " "}, None, "Ours", ["title"]),
        ("overwrite-ours", {"title": "Theirs"}, None, "Ours", ["title"]),
        ("overwrite-ours", {"title": "Theirs"}, {"title": "Old"}, "Theirs", []),
        ("overwrite-ours", {"title": "Old"}, {"title": "Old"}, "Ours", ["title"]),
        ("overwrite-all", {"title": "Theirs"}, {"title": "Old"}, "Ours", ["title"]),
        ("overwrite-all", {"title": " Ours "}, None, "Ours", []),
    ],
)
def test_write_policies(spark, policy, current, previous, title, changed):
    got = sidecar.reconcile(_cards(spark, {"title": "Ours", "tags": ["shelf:1"]}, {**current, "tags": ["mine"]}, previous and {**previous, "tags": ["else"]}), policy).first()
    assert got["payload"]["title"] == title
    assert [c for c in got["changed_fields"] if c != "tags"] == changed
    assert "shelf:1" in got["payload"]["tags"]
    if policy != "overwrite-all" and previous:
        assert "mine" in got["payload"]["tags"]


def test_sidecar_hash_and_text(spark):
    one, two = _cards(spark, {"title": "T", "tags": ["a", "b"]}, None, None), _cards(spark, {"title": "T", "tags": ["b", "a"]}, None, None)
    assert one.select(sidecar.digest(F.col("desired"))).first() == two.select(sidecar.digest(F.col("desired"))).first()
    assert one.select(sidecar.serialised(F.col("desired"))).first()[0].endswith("}\n")
    assert _cards(spark, {}, None, None).select(sidecar.previous(F.lit("{bad")).alias("p")).first()["p"] is None


def test_playlists(spark):
    body = "#EXTM3U\r\n#EXTINF:10,Chapter One\r\nhttps://c.org/a/One%20x.mp3?e=1\r\n#EXTINF:1,\r\nfiles/2.ogg\r\n# comment\r\n<html>\r\nnot a track\r\n#EXTINF:1,lost\r\n#EXTINF:2,kept\r\n../z\r\n"
    df = spark.createDataFrame([(1, body, "https://l.org/a/b.m3u"), (2, "", None), (3, None, None)], "playlist_id int, body string, base string")
    got = rows(playlist.tracks(df, base_col="base"), "playlist_id", "pos")
    assert got == [(1, 0, "https://c.org/a/One%20x.mp3?e=1", "Chapter One"), (1, 1, "https://l.org/a/files/2.ogg", None), (1, 2, "https://l.org/z", "kept")]
    names = spark.createDataFrame([(0, "https://c.org/a/Chapter%20One.mp3?x=1", None), (9, "https://c.org/z.ogg", "t"), (0, "https://c.org/noext", None), (0, "https://c.org/", None), (12344, "https://c.org/a.mp3", None)], "pos int, url string, title string")
    assert [r[0] for r in names.select(playlist.track_file(F.col("pos"), F.col("url"), F.col("title"))).collect()] == ["0001-Chapter One.mp3", "0010-z.ogg", "0001-noext.mp3", "0001-track-0001.mp3", "12345-a.mp3"]
    status = playlist.audio_status(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "playlist_id int, file string"), spark.createDataFrame([(1, "a", 2000), (1, "b", 3), (2, "c", 5000)], "playlist_id int, file string, length long"))
    assert rows(status, "playlist_id") == [(1, 1, 2, False), (2, 1, 1, True)]


def test_har_and_links(spark):
    import base64
    import json

    entry = lambda url, text, enc=None: {"request": {"url": url}, "response": {"status": 200, "content": {"mimeType": "x", "text": text, "encoding": enc}}}
    har = json.dumps({"log": {"entries": [entry("https://a/x.html", "no"), entry("https://a/l.m3u", base64.b64encode(b"#EXTM3U\nq").decode(), "base64")]}})
    assert spark.createDataFrame([(har,)], "h string").select(playlist.playlist_from_har(F.col("h"))).first()[0] == "#EXTM3U\nq"
    html = "<script>Playerjs({file:'/m33u2/5-other.m3u'})</script> \"https://cdn.org/m33u2/5-x.m3u\""
    at = lambda key: spark.createDataFrame([(html, key)], "h string, k string").select(playlist.playlist_url(F.col("h"), "https://s.org/", F.col("k"))).first()[0]
    assert at(None) == at("5-mine") == "https://s.org/m33u2/5-other.m3u"
    assert at("6-mine") is None


PAGE = """<!doctype html><html><head><title>x</title><meta property="og:site_name" content="Site"><meta property="og:title" content="The Book 2 - Site">
<meta itemprop="duration" content="05:28:52"><meta name="news_keywords" content="one, two,,one"><link rel="canonical" href="/77-the-book.html"></head><body>
<ul class="pmovie__list x"><li><span>Автор:</span> <span itemprop="author"><a href="/xfsearch/avtor/a%20b/">A B</a>, <a href="/xfsearch/avtor/a%20b/">again</a></span>
<li><span>Читає:</span> <span itemprop="readBy"><a href="/xfsearch/chitaet/n/">N</a></span></li><li><span>Жанр:</span> <a href="/fantasy/">Fantasy</a> <a href="/blog/">no</a></li>
<li itemscope itemtype="http://schema.org/PublicationVolume"><span itemprop="name"><a href="/xfsearch/cikl/cycle/">Cycle</a></span> <span itemprop="volumeNumber">2</span></li></ul>
<div class="pmovie__rating-score"> 4,5 </div><span data-vote-num-id="1">76 голосів</span><div itemprop="description">First&nbsp; line<br>Second<script>bad()</script><p>Підтримати: patreon</p>
<h2>All parts</h2><a href="/78-next.html">next</a><a href="/77-the-book.html">self</a></div><a href="/tags/t%20g/">Tag</a></body></html>"""


def test_book_page(spark):
    df = spark.createDataFrame([("https://catalogue.example.org/77-x.html", PAGE), ("https://catalogue.example.org/1-blog.html", "<p>blog</p>"), ("u", None)], "url string, html string")
    got = pages.parse_books(df, "https://catalogue.example.org").collect()
    assert len(got) == 1
    r = got[0].asDict(recursive=True)
    assert (r["source_id"], r["slug"], r["title"], r["duration_sec"], r["rating"], r["votes"]) == (77, "the-book", "The Book 2", 19732, 4.5, 76)
    assert r["authors"] == [{"key": "a b", "name": "A B"}] and r["narrators"] == [{"key": "n", "name": "N"}] and r["genres"] == [{"key": "fantasy", "name": "Fantasy"}]
    assert r["series"] == {"key": "cycle", "name": "Cycle", "sequence": "2"}
    assert r["tags"] == ["one", "two", "Tag"] and r["related_ids"] == [78]
    assert r["description"] == "First line\n\nSecond"


def test_noise_and_index(spark):
    one = lambda t, f: spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]
    assert one("Story\nПідтримати нас\n\n\n\nEnd\n$ 5", pages.strip_noise) == "Story\n\nEnd"
    assert one("a  b\n\n \n c", pages.collapse_blank_lines) == "a b\n\nc"
    html = '<a href="/xfsearch/avtor/k/">Агата Крісті</a><a href="/xfsearch/avtor/k/">Агата  Крісті - 27 книг</a><a href="/x">no</a><a href="/xfsearch/avtor/k/">Late - 3 книги</a>'
    got = pages.parse_index(spark.createDataFrame([(1, html)], "page_id long, html string"), "author", "https://c.org")
    assert rows(got) == [(1, "k", "Агата Крісті", 27)]


def test_crawl_bounds(spark):
    landed = spark.createDataFrame([("f", p, 4, n) for p, n in ((1, 9), (2, 9), (3, 0), (4, 9))] + [("g", p, 2, 9) for p in (1, 2, 3)], "facet string, page int, last_page int, n_cards int")
    assert rows(pages.crawl_pages(landed, "facet", "page", 5).select("facet", "page"), "facet", "page") == [("f", 1), ("f", 2), ("g", 1), ("g", 2)]


def test_limiter(spark):
    def fold(kinds, step=1000):
        df = spark.createDataFrame([("o", k, kind, k * step) for k, kind in enumerate(kinds)], "origin string, id long, kind string, at_ms long")
        return telemetry.limiter_fold(df, "origin").first().asDict()

    assert fold(["challenge"])["interval_ms"] == 10_000
    assert fold(["challenge"] + ["success"] * 9)["interval_ms"] == 5000
    three = fold(["challenge"] * 3)
    assert three["in_row"] == 3 and three["cooldown_until"] == 2000 + 600_000
    assert fold(["challenge"] * 3 + ["success"])["cooldown_until"] is None
    assert fold(["challenge"] * 4, step=700_000)["in_row"] == 1
    assert fold(["failure"])["interval_ms"] == 7500
    assert fold(["challenge"] * 20)["interval_ms"] == 120_000


def test_early_stop(spark):
    df = spark.createDataFrame([("a", k, False) for k in range(5)] + [("b", 0, True)] + [("b", k, False) for k in range(1, 6)], "origin string, id long, ok boolean")
    assert rows(telemetry.early_stop(df, "origin", "id"), "origin") == [("a", 3, 0, 3, True), ("b", 6, 1, 5, False)]


def test_library_json(spark):
    import json

    raw = [
        {"id": "1", "media": {"tags": ["t", ""], "audioFiles": [{}, {}], "metadata": {"title": "T", "authors": [{"name": "A"}, {"name": ""}, "B"], "seriesName": "S, U", "narrators": ["N"]}}},
        {"id": "2"},
    ]
    got = library.items(spark.createDataFrame([(json.dumps(r),) for r in raw], "json string")).orderBy("item_id").collect()
    assert got[0]["authors"] == ["A", "B"] and got[0]["series"] == ["S", "U"] and got[0]["narrators"] == ["N"] and got[0]["num_audio_files"] == 2 and got[0]["tags"] == ["t"]
    assert got[1]["title"] == "" and got[1]["authors"] == [] and got[1]["num_audio_files"] is None
    page = lambda n: json.dumps({"results": [{"id": str(k)} for k in range(n)]})
    landed = spark.createDataFrame([("l", 0, page(2)), ("l", 1, page(1)), ("l", 2, page(2))], "library string, page int, json string")
    assert library.result_pages(landed, 2).count() == 3


def test_covers_and_files(spark, tmp_path):
    for name, data in (("b/cover.png", b"\x89PNG\r\n\x1a\n" + bytes(99)), ("b/cover.jpg", b"\xff\xd8\xff"), ("b/1.mp3", b"x"), ("c/readme.txt", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = library.files(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in library.best_cover(found).collect()] == ["cover.png"]
    assert library.folders_with_media(found).count() == 1
    assert rows(spark.createDataFrame([(b"\xff\xd8\xff\xe0",), (b"RIFF0000WEBP",), (b"no",)], "c binary").select(library.image_kind(F.col("c")))) == [("jpeg",), ("webp",), (None,)]
    staged = spark.createDataFrame([("a.mp3", 1, "h"), ("b.mp3", 1, "h"), (".x", 1, "h"), ("metadata.json", 2, "h")], "file string, length long, hash string")
    present = spark.createDataFrame([("a.mp3", 1, "h"), ("metadata.json", 2, "old")], "file string, length long, hash string")
    assert dict(rows(library.placement_plan(staged, present))) == {"a.mp3": "skipped", "b.mp3": "linked", ".x": "skipped", "metadata.json": "copied"}


def test_config(tmp_path):
    got = config.parse("subscriptions:\n  - {type: author, value: X}\nsync: {writePolicy: fill-empty}\n")
    assert got["sync"]["writePolicy"] == "fill-empty" and got["sync"]["matchThreshold"] == 0.86 and got["subscriptions"][0]["enabled"]
    assert config.overlay(got, {"PORT": "9000", "AUDIO_TRACK_CONCURRENCY": "x", "WRITE_POLICY": "overwrite-all"})["server"]["port"] == 9000
    for bad in ("sync: {writePolicy: x}", "server: {port: 0}", "subscriptions: [{type: x, value: y}]", "audio: {trackConcurrency: 99}", "server: 5"):
        with pytest.raises(ValueError):
            config.parse(bad)
    path = tmp_path / "c.yaml"
    config.save(got, str(path))
    assert config.compact(config.load(str(path), {})) == {"subscriptions": [{"type": "author", "value": "X"}], "sync": {"writePolicy": "fill-empty"}}
    assert config.load(str(tmp_path / "none.yaml"), {}) == config.validated(None)
