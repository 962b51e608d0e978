"""Pages read in pieces give what their trees give."""

from __future__ import annotations

import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions.urls import BASE
from shelfmark.operators import pages, passing

BITS = ["<a href='/1-x.html'>", "</a>", "<p>", "</p>", "<li>", "<br>", "<img src=i.png>", "<a href=z/>", "text &amp; more", "&lt", "<div class='grid-items'>", "<div class='poster item'>", "<div class=poster__title>", "</div>", "<script>if (a < b) '<a>'</script>", "<!-- <a href=no> -->", "<td>", "</td>", "\n", "é"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=30), st.integers(1, 40))
def test_pieces_equal_the_tree(bits, piece):
    html = "".join(bits)
    want = [(a.attrs, a.text()) for a in pages.tree(html).find(lambda n: n.tag == "a")]
    got = [(k, a.attrs, a.text()) for k, a in passing.elements(html, lambda n: n.tag == "a", piece)]
    assert [x[1:] for x in sorted(got, key=lambda x: x[0])] == want
    cards = [pages.card_of(c) for c in pages.tree(html).find(lambda n: n.has_class("poster")) if passing._in_grid(c)]
    rows = sorted(passing._listing_rows(html), key=lambda r: r["pos"])
    assert [{k: v for k, v in r.items() if k != "pos"} for r in rows] == cards


def test_memory_is_that_of_the_text():
    html = "<html><body>" + "".join(f"<div><a href='/xfsearch/avtor/{k}/'>N {k} - 3 books</a></div>" for k in range(100_000))
    tracemalloc.start()
    n = sum(1 for _ in passing.elements(html, lambda x: x.tag == "a", 1 << 16))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100_000 and most < 4 << 20  # the tree of this page takes over 60 MB


def test_listings_and_entries_equal_parsed_pages(spark):
    card = "<div class='poster'><a class='poster__link' href='/{0}-b.html'></a><div class='poster__title'>{1}</div><div class='poster__ratings'>4,5 (3)</div></div>"
    grid = "<div class='grid-items'>" + card.format(7, "A") + card.format(7, "B") + card.format(8, " ") + card.format(9, "C") + "</div>" + card.format(10, "side")
    pager = "<div class='pagination'><span>2</span><a href='/page/11/'>x</a><a href='/page/99999999999/'>y</a></div>"
    links = "<a href='/xfsearch/avtor/One/'>One</a><a href='/xfsearch/avtor/One/'>One - 4 books</a><a href='/other'>No</a><a href='/xfsearch/avtor/Two/'> </a>"
    df = spark.createDataFrame([(1, grid + pager, 5), (2, "", 5), (3, None, 5), (4, grid + links, 5), (None, grid + pager + links, 5)], "page_id long, html string, card int")
    want = pages.parse_listings(df, BASE)
    got = passing.listings(df, BASE)
    by = lambda rows: sorted(rows.collect(), key=repr)
    assert by(got.select(*want.columns)) == by(want) and want.count() == 6
    want = pages.parse_index(df, "author", BASE)
    assert by(passing.entries(df, "author", BASE).select(*want.columns)) == by(want) and want.count() > 0
    assert passing.listings(df.limit(0), BASE).count() == 0


def test_sql(spark):
    passing.register(spark)
    df = spark.createDataFrame([(1, "<a href='x'>X <b>y</b></a><a>z</a>"), (None, "<a>n</a>")], "page_id int, html string")
    got = spark.sql("SELECT * FROM page_links(TABLE(SELECT page_id, html FROM {df})) ORDER BY page_id DESC NULLS LAST, pos", df=df)
    assert [tuple(r) for r in got.collect()] == [("1", 0, "x", "X y"), ("1", 1, None, "z"), (None, 0, None, "n")]


def test_pages_stay_in_their_partitions(spark):
    df = spark.range(0, 40, 1, 7).select(F.col("id").alias("page_id"), F.lit("<a href='x'>x</a>").alias("html"))
    rows = passing._through(passing.page_links, df, "page_id", "html")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString() and rows.rdd.getNumPartitions() == 7


def test_a_page_of_many_links(spark):
    html = F.concat(F.lit("<body>"), F.repeat(F.lit("<div><a href='/xfsearch/avtor/x/'>x</a></div>"), 200_000))
    got = passing._through(passing.page_links, spark.range(1).select("id", html.alias("html")), "id", "html").agg(F.count("pos"), F.max("pos"))
    assert tuple(got.first()) == (200_000, 199_999)
