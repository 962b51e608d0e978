"""Golden vectors of the text functions."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import text, urls


def values(spark, rows, expression, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(k, *r) if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)], f"k int, {schema}").select("k", expression.alias("out")).orderBy("k").select("out").collect()]


def test_volume_markers_converge(spark):
    got = values(spark, ["Відьмак. Книга 2", "Відьмак (Т. 2)", "Відьмак, частина II", "Аудіокнига «Кайдашева сім'я»", "Vol. 007 vol 7", "#1234"], text.normalise_title(F.col("v")))
    assert got[:3] == ["відьмак #2"] * 3
    assert got[3] == "кайдашева сімя"
    assert got[4] == "#7"
    assert got[5] == "#123 4"


def test_invalid_roman_goes(spark):
    assert values(spark, ["Том mmmm x", "Том XIX", "том xcix"], text.normalise_title(F.col("v"))) == ["x", "#19", "#99"]


def test_transliteration(spark):
    assert values(spark, ["Характерник", "Щастя", "Їжак"], text.transliterate(F.col("v"))) == ["kharakternyk", "shchastia", "izhak"]


def test_names(spark):
    assert values(spark, ["Юдковскі, Елізер", "  O'Neil  "], text.normalise_name(F.col("v"))) == ["юдковскі елізер", "oneil"]


def test_similarity(spark):
    rows = [("abc", "abc"), ("", ""), ("abc", "xyz"), ("", "a"), ("a", "b"), ("night", "nacht"), ("aaaa", "aa")]
    got = values(spark, rows, text.similarity(F.col("a"), F.col("b")), "a string, b string")
    assert got[:5] == [1.0, 1.0, 0.0, 0.0, 0.0]
    assert got[5] == pytest.approx(0.25)
    assert got[6] == pytest.approx(0.5)


def _dice(a: str, b: str) -> float:
    from collections import Counter

    a, b = "".join(a.split()), "".join(b.split())
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    return 2 * sum((x & y).values()) / (len(a) - 1 + len(b) - 1)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab c", max_size=8), st.text("ab c", max_size=8)), min_size=20, max_size=40))
def test_similarity_equals_plain_python(spark, rows):
    got = values(spark, rows, text.similarity(F.col("a"), F.col("b")), "a string, b string")
    back = values(spark, [(b, a) for a, b in rows], text.similarity(F.col("a"), F.col("b")), "a string, b string")
    assert got == pytest.approx([_dice(a, b) for a, b in rows])
    assert got == pytest.approx(back)
    assert all(0 <= x <= 1 for x in got)


def test_match_score(spark):
    rows = [("Пані Боварі", ["Гюстав Флобер"], "Pani Bovari", ["Hiustav Flober"]), ("Пані Боварі", ["Гюстав Флобер"], "Дюна", ["Френк Герберт"]), ("Дюна", [], "Дюна", ["X"])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, a array<string>, u string, b array<string>")
    sides = df.select("k", text.title_side(F.col("t")).alias("t"), text.title_side(F.col("u")).alias("u"), text.authors_side(F.col("a")).alias("a"), text.authors_side(F.col("b")).alias("b"))
    people = F.when((F.size("a") > 0) & (F.size("b") > 0), text.names_closeness(F.col("a"), F.col("b")))
    got = [r[0] for r in sides.orderBy("k").select(text.match_score(text.closeness(F.col("t"), F.col("u")), people)).collect()]
    assert got[0] > 0.8
    assert got[1] < 0.3
    assert got[2] == 1.0


def test_safe_file_names(spark):
    got = values(spark, ['Bad/Name: "with" *chars*', "   ", "a" * 200, "..x.."], text.safe_file_name(F.col("v")))
    assert got == ["Bad Name with chars", "untitled", "a" * 120, "x"]


def test_target_folder(spark):
    rows = [("Author", "Series", "2", "Title"), (None, None, " ", "A/B"), ("A", "", None, "T1")]
    got = values(spark, rows, text.target_folder(F.col("a"), F.col("s"), F.col("n"), F.col("t")), "a string, s string, n string, t string")
    assert got == ["Author/Series/2 - Title", "Unknown Author/A B", "A/T1"]


def test_durations(spark):
    assert values(spark, ["05:28:52", "28:25", "nonsense", "0:00", "", "1:x", None], text.duration_seconds(F.col("v"))) == [19732, 1705, None, None, None, None, None]


def test_hints(spark):
    assert values(spark, ["Перший рік", "Year Three", "Volume 4", "nothing", "П'ята книга", "year 0"], text.volume_hint(F.col("v"))) == [1, 3, 4, None, 5, None]
    got = values(spark, ["Volume Two: Years 5 - 7", "Year Two", "none", "years 7 - 5"], text.year_range(F.col("v")))
    assert [None if g is None else tuple(g) for g in got] == [(5, 7), (2, 2), None, None]


def test_sequences_and_scripts(spark):
    assert values(spark, ["1", " 01 ", "1.5", "0", "x", None], text.sequence_number(F.col("v"))) == [1, 1, 1, None, None, None]
    assert values(spark, ["Harry Potter", "Гаррі Поттер", "12 34", "abc д"], text.mostly_latin(F.col("v"))) == [True, False, False, True]
    assert values(spark, ["12abc", " -7", "x1", ""], text.leading_int(F.col("v"))) == [12, -7, None, None]


def test_split_and_tokens(spark):
    assert values(spark, ["A, B & C;D", "", None], text.split_names(F.col("v"))) == [["A", "B", "C", "D"], [], []]
    assert values(spark, ["The old Cyrillic-Книга of some other words"], text.title_tokens(F.col("v"))) == [["cyrillic", "книга", "some", "other"]]


def test_formats(spark):
    df = spark.sql("select 512 a, 1536 b, 3 * 1024 * 1024 c")
    assert list(df.select(text.format_bytes(F.col("a")), text.format_bytes(F.col("b")), text.format_bytes(F.col("c")), text.format_rate(F.lit(0))).first()) == ["512 B", "1.5 KiB", "3.0 MiB", "0 B/s"]
    assert list(spark.sql("select 0.2d a, 75d b, 3700d c, -1d d").select(*[text.format_duration(F.col(x)) for x in "abcd"]).first()) == ["1s", "1m 15s", "1h 1m", "?"]
    assert values(spark, ["a: 1\n  apiKey: secret\nb: 2"], text.redact(F.col("v"))) == ['a: 1\n  apiKey: "***"\nb: 2']


def test_urls(spark):
    base = urls.BASE
    assert values(spark, ["/12-some-slug.html", "x/../7-a.html", "//h.org/1-b.html", "?p=1", "https://o.org/z", ""], urls.absolute(F.col("v"), base + "/")) == [f"{base}/12-some-slug.html", f"{base}/7-a.html", "https://h.org/1-b.html", f"{base}/?p=1", "https://o.org/z", None]
    got = values(spark, [f"{base}/12-some-slug.html", f"{base}/blog/12-x.html", f"{base}/x.html"], urls.book_ref(F.col("v")))
    assert [None if g is None else tuple(g) for g in got] == [(12, "some-slug"), None, None]
    assert values(spark, [f"{base}/xfsearch/avtor/%D0%90+%D0%91%20c/", f"{base}/xfsearch/cikl/x/", f"{base}/xfsearch/avtor/bad%zz/"], urls.facet_key(F.col("v"), "author")) == ["а+б c", None, "bad%zz"]
    assert values(spark, [f"{base}/Fantasy/", f"{base}/tags/", f"{base}/a/b/", f"{base}/x.html"], urls.category_key(F.col("v"))) == ["fantasy", None, None, None]
    assert values(spark, [f"{base}/tags/One%20Two/"], urls.tag_key(F.col("v"))) == ["one two"]
    assert values(spark, ["А Б"], urls.facet_url("author", F.col("v"), F.lit(2))) == [f"{base}/xfsearch/avtor/%D0%90%20%D0%91/page/2/"]


def test_cookies(spark):
    rows = [("www.a.org", ".A.org"), ("a.org", "a.org"), ("ba.org", "a.org")]
    assert values(spark, rows, urls.host_in_domain(F.col("h"), F.col("d")), "h string, d string") == [True, True, False]
