"""Queries over the jobs: crawling, recording, syncing, staging, and the catalogue's own tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import catalog, downloads, matching, merge, newest, pages, playlist, pool, queue, selection, sidecar, sync, telemetry
from ..sources import config, landed, library, paged, schema, stored
from ..staging import database, landing, once, shared_folder
from .catalogue_queries import query
from .content_queries import _generations, _playlists
from .testviews import Views

def _at() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp")



def _text(c: str) -> Column:
    return F.col(c).cast("string")


# --- tables


@query(
    """SELECT r_name AS key, 'first' AS name, CAST(NULL AS INTEGER) AS book_count FROM region UNION ALL SELECT n_name, 'second', CAST(n_nationkey AS INTEGER) FROM nation UNION ALL SELECT s_name, 'third', CAST(NULL AS INTEGER) FROM supplier""",
    views=False,
)
def table_generations(v: Views) -> DataFrame:
    """Three files of a table, the first without a column that the second has, the third appended later; and a table that isn't there."""
    folder = f"{shared_folder(v.spark)}/generations-{uuid.uuid4().hex}"
    v.table("region").select(F.col("r_name").alias("key"), F.lit("first").alias("name")).write.mode("overwrite").parquet(f"{folder}/narrators")
    schema.save_table(v.table("nation").select(F.col("n_name").alias("key"), F.lit("second").alias("name"), F.col("n_nationkey").alias("book_count")), folder, "narrators", "append")
    schema.save_table(v.table("supplier").select(F.col("s_name").alias("key"), F.lit("third").alias("name")), folder, "narrators", "append")
    return schema.open_table(v.spark, folder, "narrators").unionByName(schema.open_table(v.spark, folder, "series"))


@query(
    """SELECT 'k' || n_nationkey AS key, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 2 = 0 THEN 'new' || n_nationkey ELSE n_name END AS value FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 2 = 0 OR n_nationkey % 5 <> 0""",
    views=False,
)
def merge_meta(v: Views) -> DataFrame:
    """Keys and values: the new value counts, even a null."""
    n = F.col("n_nationkey")
    rows = v.table("nation").select(F.concat(F.lit("k"), n.cast("string")).alias("key"), "n_nationkey", "n_name")
    old = rows.filter(n % 5 != 0).select("key", F.col("n_name").alias("value"))
    new = rows.filter((n % 3 == 0) | (n % 2 == 0)).select("key", F.when(n % 3 != 0, F.concat(F.lit("new"), n.cast("string"))).alias("value"))
    return merge.merge(old, new, ["key"], merge.META)


_STORED_SQL = """WITH old AS (SELECT o_orderkey AS source_id, 'u' || o_orderkey AS url, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS rating, 'ok' AS detail_state FROM orders WHERE o_orderkey % 5 <> 0),
  seen AS (SELECT l_orderkey AS source_id, l_linenumber * 100000000 + l_suppkey AS seq, 'p' || l_partkey AS url, l_returnflag || l_suppkey AS title, CASE WHEN l_quantity > 25 THEN l_extendedprice END AS rating FROM lineitem),
  batch AS (SELECT source_id, arg_max(url, seq) AS url, arg_min(title, seq) AS title, arg_max(rating, seq) FILTER (WHERE rating IS NOT NULL) AS rating FROM (SELECT * FROM seen QUALIFY count(*) OVER (PARTITION BY source_id, seq) = 1) GROUP BY 1)"""


def _listed(v: Views) -> tuple[str, DataFrame]:
    """Orders as a stored table of books, and lines as listing cards, several a book, to be taken in by their order."""
    o, k = v.table("orders"), F.col("o_orderkey")
    old = o.filter(k % 5 != 0).select(k.alias("source_id"), F.concat(F.lit("u"), _text("o_orderkey")).alias("url"), F.when(k % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"), F.when(k % 2 == 0, F.col("o_totalprice")).alias("rating"), F.lit("ok").alias("detail_state"))
    name = f"{database(v.spark)}.books"
    stored.create(old, name, ["source_id"], int(v.spark.conf.get("spark.sql.shuffle.partitions")))
    card = F.struct(F.concat(F.lit("p"), _text("l_partkey")).alias("url"), F.concat("l_returnflag", _text("l_suppkey")).alias("title"), F.when(F.col("l_quantity") > 25, F.col("l_extendedprice")).alias("rating"))
    lines = v.table("lineitem").select(F.col("l_orderkey").alias("source_id"), (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_suppkey")).alias("seq"), card.alias("card"))
    # lines that tell of the same moment tell nothing
    once_each = lines.groupBy("source_id", "seq").agg(F.count(F.lit(1)).alias("n"), F.first("card").alias("card")).filter("n = 1")
    return name, once_each.select("source_id", "seq", "card.*")


@query(
    _STORED_SQL
    + """ SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(n.url, o.url) AS url, CASE WHEN n.source_id IS NOT NULL AND coalesce(o.title, '') = '' THEN n.title ELSE o.title END AS title, round(coalesce(n.rating, o.rating), 6) AS rating, coalesce(o.detail_state, 'pending') AS detail_state
    FROM old o FULL OUTER JOIN batch n ON o.source_id = n.source_id""",
    views=False,
)
def merge_stored(v: Views) -> DataFrame:
    """Listing cards merged into a table stored by its key: the table isn't shuffled, readers go on with the old rows until the new ones are whole."""
    name, cards = _listed(v)
    rules = {k: r for k, r in merge.LISTING.items() if k in ("url", "title", "rating")}
    return stored.merge_into(v.spark, name, cards, rules, "seq", {"detail_state": F.lit("pending")}).withColumn("rating", F.round("rating", 6))


@query(
    """SELECT l_partkey AS source_id, 's' || l_suppkey AS author_key FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY ALL
    UNION ALL SELECT l_partkey, 'n' || (l_suppkey % 7) FROM lineitem WHERE l_partkey % 6 = 0 GROUP BY ALL""",
    views=False,
)
def children_stored(v: Views) -> DataFrame:
    """Authors of books in a table stored by book: those of every third book go, and half of these books get new ones."""
    l, part = v.table("lineitem"), F.col("l_partkey")
    name = f"{database(v.spark)}.book_authors"
    pairs = l.select(part.alias("source_id"), F.concat(F.lit("s"), _text("l_suppkey")).alias("author_key"))
    stored.create(pairs.distinct(), name, ["source_id"], int(v.spark.conf.get("spark.sql.shuffle.partitions")))
    parents = l.filter(part % 3 == 0).select(part.alias("source_id"))
    fresh = l.filter(part % 6 == 0).select(part.alias("source_id"), F.concat(F.lit("n"), (F.col("l_suppkey") % 7).cast("string")).alias("author_key"))
    return stored.replace_children_into(v.spark, name, parents, fresh, ["source_id", "author_key"])


@query("SELECT lower(p_type) AS key, max(CASE WHEN p_size % 2 = 0 THEN upper(p_type) END) IS NOT NULL AS is_new, coalesce(max(CASE WHEN p_size % 2 = 0 THEN upper(p_type) END), max(p_type)) AS name FROM part GROUP BY 1", views=False)
def merge_genre(v: Views) -> DataFrame:
    p = v.table("part")
    old = p.select(F.lower("p_type").alias("key"), F.col("p_type").alias("name")).distinct()
    new = p.filter("p_size % 2 = 0").select(F.lower("p_type").alias("key"), F.upper("p_type").alias("name")).distinct()
    merged = merge.merge(old, new, ["key"], merge.GENRE)
    return merged.join(new.select("key", F.lit(True).alias("is_new")), "key", "left").select("key", F.coalesce("is_new", F.lit(False)).alias("is_new"), "name")


@query("SELECT 'books' AS name, count(*) AS n FROM part UNION ALL SELECT 'queue', count(*) FROM orders UNION ALL SELECT 'authors', count(*) FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'links', 0", views=False)
def committed_versions(v: Views) -> DataFrame:
    """Two commits of several tables; the last one's authors and the first one's books and queue are what readers see."""
    folder = f"{shared_folder(v.spark)}/versions-{uuid.uuid4().hex}"
    authors = v.table("supplier").select(F.lower("s_name").alias("key"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    first = {"books": v.titles.select("source_id", "title"), "queue": v.queue.select("id", "source_id", "reason", "state"), "authors": authors.drop("k")}
    schema.commit(first, folder)
    schema.commit({"authors": authors.filter("k % 2 = 0").drop("k")}, folder)
    seen = schema.checkout(v.spark, folder)
    return catalog.counts({"books": seen["books"].withColumn("x", F.lit(1))}).filter("name = 'books'").unionByName(catalog.counts({"queue": seen["queue"], "authors": seen["authors"], "links": seen["abs_links"]}))


# --- library


@query("SELECT o_orderkey % 7 AS library, o_orderkey // 1400 AS page, 'item' || o_orderkey AS item_id FROM orders WHERE o_orderkey % 7 <> 3 OR o_orderkey < 1400 OR o_orderkey // 1400 = 1 AND o_orderkey % 2 = 1", views=False)
def library_pages(v: Views) -> DataFrame:
    """Result pages of up to two hundred items; one library has a short page before its end, and what follows it isn't asked for."""
    o = v.table("orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("library"), F.floor(F.col("o_orderkey") / 1400).alias("page"))
    kept = o.filter(~((F.col("library") == 3) & (F.col("page") == 1) & (F.col("o_orderkey") % 2 == 0)))
    landed = kept.groupBy("library", "page").agg(F.to_json(F.struct(F.collect_list(F.struct(F.concat(F.lit("item"), _text("o_orderkey")).alias("id"))).alias("results"))).alias("json"))
    found = library.result_pages(landed)
    return found.select("library", "page", F.get_json_object("json", "$.id").alias("item_id"))


@query("SELECT CAST(o_orderkey % 7 AS VARCHAR) AS library, CAST(o_orderkey // 1400 AS INTEGER) AS page, 'item' || o_orderkey AS item_id FROM orders WHERE o_orderkey % 7 IN (0, 2, 5)", views=False)
def library_source(v: Views) -> DataFrame:
    """Items of three libraries through the paged source, from responses that are landed first."""
    o = v.table("orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("library"), F.floor(F.col("o_orderkey") / 1400).alias("page"))
    landed = o.groupBy("library", "page").agg(F.to_json(F.struct(F.collect_list(F.struct(F.concat(F.lit("item"), _text("o_orderkey")).alias("id"))).alias("results"))).alias("value"))
    root = landing(v.spark)
    landed.write.partitionBy("library", "page").text(root)
    found = paged.load(v.spark, root, ["0", "2", "5"])
    return found.select("library", "page", F.get_json_object("json", "$.id").alias("item_id"))


@query("SELECT n_name AS id, 'N' || n_nationkey AS name FROM nation WHERE n_nationkey % 3 <> 0 AND n_name IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_10', 'NATION_22')", views=False)
def library_list(v: Views) -> DataFrame:
    """The book libraries of a response that are on the allow-list."""
    kind = F.when(F.col("n_nationkey") % 3 == 0, "podcast").otherwise("book")
    raw = v.table("nation").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("n_name").alias("id"), F.concat(F.lit("N"), _text("n_nationkey")).alias("name"), kind.alias("mediaType"))).alias("libraries"))).alias("json"))
    return library.book_libraries(raw, ["NATION_1", "NATION_2", "NATION_3", "NATION_10", "NATION_22"])


def _item_json() -> Column:
    i = F.col("c_custkey")
    return F.concat(
        F.lit('{"id":"item'), i.cast("string"), F.lit('","libraryId":"main","path":"/shelf/'), F.col("c_name"), F.lit('","media":{"tags":["a"],"metadata":{"title":"T'), i.cast("string"), F.lit('","authorName":"'), F.col("c_name"),
        F.lit('","seriesName":"'), F.when(i % 2 == 0, "S #1").otherwise(""), F.lit('","language":"'), F.when(i % 3 == 0, "ukr").otherwise(""), F.lit('","publishedYear":"'), (i % 50 + 1970).cast("string"), F.lit('"}}}'),
    )


@query("SELECT 'item' || c_custkey AS item_id, 'T' || c_custkey AS title, '/shelf/' || c_name AS path, c_name AS authors FROM customer WHERE c_custkey = 7", views=False)
def library_item(v: Views) -> DataFrame:
    return library.item(v.table("customer").select(_item_json().alias("json")), "item7").select("item_id", "title", "path", F.array_join("authors", "|").alias("authors"))


@query("SELECT 'item' || c_custkey AS item_id, 'T' || c_custkey AS title, c_name AS authors, CASE WHEN c_custkey % 2 = 0 THEN 'S #1' END AS series, CASE WHEN c_custkey % 3 = 0 THEN 'ukr' ELSE '' END AS language, CAST(c_custkey % 50 + 1970 AS VARCHAR) AS year, 'a' AS tags, CAST(NULL AS VARCHAR) AS narrators FROM customer", views=False)
def item_sidecars(v: Views) -> DataFrame:
    """What the library holds of its items, as sidecars: empty lists are missing."""
    made = library.items(v.table("customer").select(_item_json().alias("json"))).select("item_id", sidecar.of_item().alias("s"))
    lists = lambda c: F.array_join(F.col(f"s.{c}"), "|").alias(c)
    return made.select("item_id", "s.title", lists("authors"), lists("series"), F.col("s.language").alias("language"), F.col("s.publishedYear").alias("year"), lists("tags"), lists("narrators"))


def _files(v: Views) -> DataFrame:
    """A folder per part with a cover, tracks and a text, some of them tiny or of other formats."""
    i, size = F.col("p_partkey"), F.col("p_size")
    names = F.array(
        F.struct(F.when(size % 2 == 0, "cover.jpg").otherwise("cover.webp").alias("file"), F.when(size % 3 == 0, F.lit(10)).otherwise(size * 100).alias("length")), F.struct(F.lit("cover.png").alias("file"), (size * 10).alias("length")),
        F.struct(F.when(size % 5 == 0, "01.MP3").when(size % 5 == 1, "b.m4b").otherwise("notes.txt").alias("file"), (size * 50).alias("length")), F.struct(F.lit("A.flac").alias("file"), F.when(size % 7 == 0, F.lit(2000)).otherwise(1).alias("length")),
    )
    dirs = v.table("part").select(F.concat(F.lit("/lib/"), i.cast("string")).alias("dir"), F.explode(names).alias("f"))
    return dirs.select("dir", "f.file", "f.length", F.concat("dir", F.lit("/"), "f.file").alias("path"))


_FILES_SQL = """WITH f AS (SELECT '/lib/' || p_partkey AS dir, p_size, unnest([1, 2, 3, 4]) AS k FROM part), files AS (
  SELECT dir, p_size, CASE k WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'cover.jpg' ELSE 'cover.webp' END WHEN 2 THEN 'cover.png' WHEN 3 THEN CASE p_size % 5 WHEN 0 THEN '01.MP3' WHEN 1 THEN 'b.m4b' ELSE 'notes.txt' END ELSE 'A.flac' END AS file,
         CASE k WHEN 1 THEN CASE WHEN p_size % 3 = 0 THEN 10 ELSE p_size * 100 END WHEN 2 THEN p_size * 10 WHEN 3 THEN p_size * 50 ELSE CASE WHEN p_size % 7 = 0 THEN 2000 ELSE 1 END END AS length FROM f)
"""


@query(_FILES_SQL + "SELECT DISTINCT dir FROM files WHERE NOT starts_with(file, 'cover') AND file <> 'notes.txt'", views=False)
def media_folders(v: Views) -> DataFrame:
    return library.folders_with_media(_files(v))


@query(_FILES_SQL + "SELECT dir, dir || '/' || arg_min(file, CASE file WHEN 'cover.jpg' THEN 1 WHEN 'cover.png' THEN 3 ELSE 4 END) AS path FROM files WHERE starts_with(file, 'cover') AND length >= 64 GROUP BY dir", views=False)
def cached_covers(v: Views) -> DataFrame:
    return library.best_cover(_files(v)).select("dir", "path")


@query(_FILES_SQL + "SELECT dir, file, row_number() OVER (PARTITION BY dir ORDER BY lower(file)) AS place FROM files", views=False)
def file_order(v: Views) -> DataFrame:
    return library.listing(_files(v)).select("dir", "file", F.col("place").cast("long").alias("place"))


@query(_FILES_SQL + "SELECT dir AS playlist_id, count(*) AS downloaded, count(*) AS total, true AS complete FROM files WHERE NOT starts_with(file, 'cover') AND file <> 'notes.txt' AND length >= 1024 GROUP BY dir", views=False)
def audio_without_manifest(v: Views) -> DataFrame:
    return playlist.media_status(_files(v).withColumnRenamed("dir", "playlist_id"))


@query(
    _FILES_SQL
    + """SELECT dir, file, CASE WHEN file IN ('A.flac', '01.MP3', 'b.m4b') THEN CASE WHEN p_size % 4 = 0 THEN 'skipped' ELSE 'linked' END WHEN p_size % 4 = 0 THEN 'skipped' ELSE 'copied' END AS action FROM files WHERE NOT starts_with(file, '.')""",
    views=False,
)
def placement(v: Views) -> DataFrame:
    """What placing staged files does where a quarter of the folders hold the same ones already."""
    staged = _files(v).withColumn("file", F.concat("dir", F.lit("|"), "file")).withColumn("hash", F.md5(F.col("file").cast("binary")))
    part = v.table("part").select(F.concat(F.lit("/lib/"), _text("p_partkey")).alias("dir"), (F.col("p_size") % 4 == 0).alias("there"))
    present = staged.join(part, "dir").withColumn("hash", F.when(F.col("there"), F.col("hash")).otherwise("other"))
    plan = library.placement_plan(staged.select("file", "length", "hash"), present.select("file", "length", "hash"), "full")
    return plan.select(F.substring_index("file", "|", 1).alias("dir"), F.substring_index("file", "|", -1).alias("file"), "action")


@query("SELECT user_id AS origin, array_to_string(list_sort(list(name || '=v' || id)), '; ') AS header FROM (SELECT user_id, 'c' || (event_id % 5) AS name, max(event_id) AS id FROM events GROUP BY 1, 2) GROUP BY user_id", views=False)
def cookie_headers(v: Views) -> DataFrame:
    """Cookies that a meta row of each origin holds as JSON, as a header: by name the last one counts."""
    e = v.table("events").select("user_id", "event_id", F.concat(F.lit("c"), (F.col("event_id") % 5).cast("string")).alias("name"))
    # by name the last one first, so an origin's list is as long as its names, not its events
    last = e.groupBy("user_id", "name").agg(F.max("event_id").alias("event_id"))
    jar = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "name"))), lambda x: F.struct(x["name"].alias("name"), F.concat(F.lit("v"), x["event_id"].cast("string")).alias("value")))
    stored = last.groupBy("user_id").agg(F.to_json(jar).alias("value"))
    meta = stored.select(F.concat(F.lit("cookies/"), _text("user_id")).alias("key"), "value").unionByName(v.table("region").select(F.concat(F.lit("cookies/"), "r_name").alias("key"), F.lit("{bad").alias("value")))
    found = library.cookie_header(library.cookies(meta, F.col("key").startswith("cookies/")), "pos", ("key",))
    return found.select(F.substring_index("key", "/", -1).cast("long").alias("origin"), "header")


@query(
    """SELECT c_custkey AS id, 'n' || c_custkey AS name, CASE WHEN c_custkey % 2 = 0 THEN 'v=1' ELSE '' END AS value, CASE c_custkey % 4 WHEN 0 THEN 1445412480 WHEN 1 THEN 1000 + c_custkey WHEN 2 THEN 1000 + 60 END AS expires,
    CASE WHEN c_custkey % 3 = 0 THEN '.x.org' ELSE 'www.y.org' END AS domain FROM customer WHERE c_custkey % 7 <> 0""",
    views=False,
)
def set_cookies(v: Views) -> DataFrame:
    i = F.col("c_custkey")
    pair = F.when(i % 7 == 0, "=bad").otherwise(F.concat(F.lit(" n"), i.cast("string"), F.lit(" = "), F.when(i % 2 == 0, "v=1").otherwise("")))
    life = F.when(i % 4 == 0, "; Max-Age=x; Expires=Wed, 21 Oct 2015 07:28:00 GMT").when(i % 4 == 1, F.concat(F.lit(";max-age="), i.cast("string"))).when(i % 4 == 2, "; Expires=Wed, 21-Oct-2015 07:28:00 GMT; Max-Age= 60").otherwise("; expires=soon; HttpOnly")
    rows = v.table("customer").select(i.alias("id"), F.concat(pair, life, F.when(i % 3 == 0, "; Domain= .x.org ; Path=/").otherwise("; Domain=")).alias("line"), F.lit("www.y.org").alias("host"), F.lit(1000).cast("long").alias("at_s"))
    return library.set_cookies(rows).select("id", "name", "value", "expires", "domain")


# --- pages and crawls


@query("SELECT lower(s_name) AS key, CASE WHEN s_suppkey % 4 = 0 THEN 'known' ELSE s_name END AS name, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 5 WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS INTEGER) AS book_count, s_suppkey % 4 <> 0 AS seen FROM supplier", views=False)
def seed_entities(v: Views) -> DataFrame:
    """Authors after an index page a nation came in: links with and without counts; every fourth is known and on no page."""
    s = v.table("supplier")
    known = s.filter("s_suppkey % 4 = 0").select(F.lower("s_name").alias("key"), F.lit("known").alias("name"), F.lit(5).alias("book_count"))
    link = F.concat(F.lit('<li><a href="/xfsearch/avtor/'), F.replace("s_name", F.lit("#"), F.lit("%23")), F.lit('/">'), F.col("s_name"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit(" - "), _text("s_suppkey"), F.lit(" книг"))).otherwise(""), F.lit("</a></li>"))
    index = s.filter("s_suppkey % 4 <> 0").groupBy(F.col("s_nationkey").cast("long").alias("page_id")).agg(F.concat(F.lit("<ul>"), F.array_join(F.collect_list(link), ""), F.lit('</ul><a href="/other/">no</a>')).alias("html"))
    found = pages.parse_index(index, "author", urls.BASE)
    authors, _ = catalog.seed(known, known.limit(0), found, found.limit(0))
    return authors.join(found.select("key", F.lit(True).alias("seen")), "key", "left").select("key", "name", "book_count", F.coalesce("seen", F.lit(False)).alias("seen"))


@query("SELECT CAST(o_custkey AS BIGINT) AS facet, page FROM (SELECT o_custkey, unnest(range(1, 9)) AS page, min(o_orderkey % 6 + 1) AS most, max(o_orderkey % 9 + 1) AS gap FROM orders GROUP BY o_custkey) WHERE page <= least(5, most + 2) AND page < gap", views=False)
def crawl_bounds(v: Views) -> DataFrame:
    """The listing pages that a crawl of each facet takes: up to five, to the pager's last one, and to the first empty one."""
    facets = v.table("orders").groupBy(F.col("o_custkey").cast("long").alias("facet")).agg((F.min(F.col("o_orderkey") % 6 + 1) + 2).alias("last_page"), F.max(F.col("o_orderkey") % 9 + 1).alias("empty_from"))
    landed = facets.select("facet", "last_page", "empty_from", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("page")).withColumn("n_cards", F.when(F.col("page") >= F.col("empty_from"), 0).otherwise(24))
    return pages.crawl_pages(landed, "facet", "page", 5).select("facet", "page")


@query(
    """SELECT 'pair' AS what, CAST(source_id AS VARCHAR) AS a, author_key AS b FROM book_authors WHERE source_id % 2 = 0 UNION SELECT 'pair', CAST(source_id AS VARCHAR), series_key FROM books WHERE size % 5 = 0
    UNION SELECT 'entity', key, CASE WHEN key IN (SELECT series_key FROM books WHERE size % 5 = 0) THEN series_name ELSE key END FROM (SELECT DISTINCT series_key AS key, series_name FROM books WHERE size % 5 = 0 OR size % 3 = 0)"""
)
def attach_facet(v: Views) -> DataFrame:
    """Entities and pairs after the listings of some facets came in."""
    cards = v.titles.filter("size % 5 = 0").select("source_id", F.col("series_key").alias("key"), F.col("series_name").alias("name"))
    known = v.titles.filter("size % 3 = 0").select(F.col("series_key").alias("key")).distinct().select("key", F.col("key").alias("name"), F.lit(None).cast("int").alias("book_count"))
    entities, bridge = catalog.attach_facet(known, v.book_authors.filter("source_id % 2 = 0"), cards, "author_key")
    return bridge.select(F.lit("pair").alias("what"), _text("source_id").alias("a"), F.col("author_key").alias("b")).unionByName(entities.select(F.lit("entity").alias("what"), F.col("key").alias("a"), F.col("name").alias("b")))


@query("SELECT source_id, CASE WHEN size % 2 = 0 THEN 'own' WHEN size % 3 = 0 THEN series_key END AS series_key FROM books")
def facet_series(v: Views) -> DataFrame:
    """A series' listing fills in the series of books that have none."""
    books = v.titles.select("source_id", F.when(F.col("size") % 2 == 0, "own").alias("series_key"), F.when(F.col("size") % 2 == 0, "Own").alias("series_name"))
    return catalog.attach_facet_series(books, v.titles.filter("size % 3 = 0").select("source_id", "series_key", "series_name")).select("source_id", "series_key")


def _detail_tables(v: Views) -> dict[str, DataFrame]:
    empty = {name: schema.empty(v.spark, name) for name in schema.TABLES}
    books = v.titles.filter("source_id % 2 = 0").select("source_id", F.lit("old").alias("title"), F.lit("pending").alias("detail_state"), F.lit("was").alias("detail_error"), F.lit("L1").alias("lastmod"), F.lit(7).alias("votes"))
    bridge = v.titles.select("source_id", F.explode(F.array(F.lit("gone"), F.lit("shared"))).alias("author_key"))
    return empty | {"books": schema.conform(books, "books"), "book_authors": bridge}


def _parsed(v: Views) -> DataFrame:
    """Detail pages of a third of the books."""
    some = v.titles.filter("source_id % 3 = 0")
    entry = lambda k, n: F.struct(k.alias("key"), n.alias("name"))
    none = F.array().cast("array<struct<key:string,name:string>>")
    return some.select(
        "source_id", F.concat(F.lit("u"), _text("source_id")).alias("url"), F.lit("s").alias("slug"), F.initcap("title").alias("title"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("cover_url"), F.col("size").alias("duration_sec"), F.lit(4.5).alias("rating"), F.lit(None).cast("int").alias("votes"),
        F.array(entry(F.lit("shared"), F.lit("Shared")), entry(F.col("series_key"), F.col("series_name"))).alias("authors"), F.when(F.col("size") % 2 == 0, F.array(entry(F.lit("nar"), F.lit("Nar")))).otherwise(none).alias("narrators"), none.alias("genres"),
        F.struct(F.col("series_key").alias("key"), F.col("series_name").alias("name"), F.lit("2").alias("sequence")).alias("series"), F.split("title", " ").alias("tags"), F.array(F.col("source_id") + 1, F.lit(-5).cast("long")).alias("related_ids"),
    )


_DETAIL_SQL = """, parsed AS (SELECT source_id, 'u' || source_id AS url, upper(title[1]) || split_part(substr(title, 2), ' ', 1) || ' ' || upper(split_part(title, ' ', 2)[1]) || substr(split_part(title, ' ', 2), 2) AS title, size, series_key, series_name FROM books WHERE source_id % 3 = 0)
"""


@query(_DETAIL_SQL + "SELECT coalesce(p.source_id, o.source_id) AS source_id, coalesce(p.title, 'old') AS title, CASE WHEN p.source_id IS NULL THEN 'pending' ELSE 'ok' END AS detail_state, CASE WHEN p.source_id IS NULL THEN 'was' END AS detail_error, CASE WHEN o.source_id IS NOT NULL THEN 'L1' END AS lastmod, CAST(CASE WHEN p.source_id IS NULL THEN 7 END AS INTEGER) AS votes, p.size AS duration_sec, p.series_key FROM (SELECT source_id FROM books WHERE source_id % 2 = 0) o FULL OUTER JOIN parsed p ON p.source_id = o.source_id")
def record_detail(v: Views) -> DataFrame:
    """Books after detail pages came in: overwritten, with their state and error, but for the date of change."""
    return catalog.record_details(_detail_tables(v), _parsed(v), _at())["books"].select("source_id", "title", "detail_state", "detail_error", "lastmod", "votes", "duration_sec", "series_key")


@query(
    _DETAIL_SQL
    + """SELECT 'author' AS what, source_id, unnest(['gone', 'shared']) AS key FROM books WHERE source_id % 3 <> 0 UNION ALL SELECT 'author', source_id, unnest(['shared', series_key]) FROM parsed UNION ALL SELECT 'narrator', source_id, 'nar' FROM parsed WHERE size % 2 = 0
    UNION ALL SELECT DISTINCT 'tag', t.source_id, t.tag FROM book_tags t JOIN parsed p ON p.source_id = t.source_id"""
)
def record_detail_children(v: Views) -> DataFrame:
    """The bridges of these books, replaced."""
    done = catalog.record_details(_detail_tables(v), _parsed(v), _at())
    part = lambda name, what, key: done[name].select(F.lit(what).alias("what"), "source_id", F.col(key).alias("key"))
    return part("book_authors", "author", "author_key").unionByName(part("book_narrators", "narrator", "narrator_key")).unionByName(part("book_tags", "tag", "tag"))


@query(
    _DETAIL_SQL
    + """, known AS (SELECT source_id FROM books WHERE source_id % 2 = 0 UNION SELECT source_id FROM parsed)
    SELECT source_id, CASE WHEN source_id % 3 = 0 THEN 'ok' WHEN source_id % 3 = 1 THEN 'skipped' ELSE 'pending' END AS detail_state, CASE WHEN source_id % 3 = 1 THEN 'not a book page' WHEN source_id % 3 = 2 THEN 'was' END AS detail_error FROM known
    UNION ALL SELECT DISTINCT source_id, 'pending', NULL FROM (SELECT source_id + 1 AS source_id FROM parsed UNION SELECT -5 FROM parsed) WHERE source_id NOT IN (SELECT source_id FROM known)"""
)
def backfill(v: Views) -> DataFrame:
    """Books after a backfill: recorded, skipped where the page is no book, and the siblings that pages link to."""
    landed = v.titles.filter("source_id % 3 <> 2").select("source_id")
    return catalog.backfill(_detail_tables(v), landed, _parsed(v), _at())["books"].select("source_id", "detail_state", "detail_error")


@query("SELECT source_id, CASE WHEN size % 4 = 0 THEN 'skipped' ELSE detail_state END AS detail_state, CASE WHEN size % 8 = 0 THEN 'why' WHEN size % 4 = 0 THEN NULL ELSE 'old' END AS detail_error, size % 4 = 0 AS stamped FROM books")
def mark_states(v: Views) -> DataFrame:
    books = v.titles.select("source_id", "detail_state", F.lit("old").alias("detail_error"), F.lit(None).cast("timestamp").alias("fetched_at"))
    marks = v.titles.filter("size % 4 = 0").select("source_id", F.lit("skipped").alias("detail_state"), F.when(F.col("size") % 8 == 0, "why").alias("detail_error"))
    return catalog.mark_state(books, marks, _at()).select("source_id", "detail_state", "detail_error", F.col("fetched_at").isNotNull().alias("stamped"))


@query("""SELECT source_id, md5('{"title":"' || title || '",' || CASE WHEN size % 2 = 0 THEN '"series_key":"' || series_key || '",' ELSE '' END || '"size":' || size || '}') AS hash FROM books""")
def content_hashes(v: Views) -> DataFrame:
    return v.titles.select("source_id", merge.content_hash(F.col("title"), F.when(F.col("size") % 2 == 0, F.col("series_key")).alias("series_key"), F.col("size")).alias("hash"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'sci fi ' || s_suppkey WHEN 1 THEN 'ab' END AS tag, 'https://catalogue.example.org/g' || s_suppkey || '/' || CASE WHEN s_suppkey % 3 > 1 THEN 'page/' || (s_suppkey % 3) || '/' ELSE '' END AS category FROM supplier", views=False)
def tag_keys(v: Views) -> DataFrame:
    """Keys of tag pages, and the addresses of category pages."""
    i = F.col("s_suppkey")
    url = F.when(i % 4 == 0, F.concat(F.lit(f"{urls.BASE}/tags/Sci%20Fi%20%20"), i.cast("string"), F.lit("//"))).when(i % 4 == 1, f"{urls.BASE}/tags/AB?x=1").when(i % 4 == 2, f"{urls.BASE}/tags/").otherwise(f"{urls.BASE}/genre/x")
    return v.table("supplier").select(i.alias("id"), urls.tag_key(url).alias("tag"), urls.category_url(F.concat(F.lit("g"), i.cast("string")), i % 3).alias("category"))


@query("SELECT source_id, CASE WHEN size % 3 <> 0 THEN 'https://x/c' || source_id END AS cover, CASE WHEN size % 3 <> 0 THEN '/api/covers/' || source_id || CASE WHEN size % 2 = 0 THEN '?v=' || size ELSE '' END END AS proxy FROM books")
def cover_urls(v: Views) -> DataFrame:
    own = F.when(F.col("size") % 3 != 0, F.concat(F.lit(" https://x/c"), _text("source_id"))).otherwise(" ")
    return v.titles.select("source_id", urls.preferred_cover(own).alias("cover"), urls.cover_proxy_url(F.col("source_id"), own, F.when(F.col("size") % 2 == 0, F.col("size"))).alias("proxy"))


# --- selection and the queue


@query(
    """, w AS (SELECT source_id, coalesce(CASE WHEN size % 4 <> 0 THEN series_key END, 'unkeyed:' || source_id) AS work, price FROM books)
    SELECT work, count(*) AS n, arg_max(source_id, price * 100000 + source_id / 1000000.0) AS best FROM w GROUP BY work"""
)
def work_groups(v: Views) -> DataFrame:
    """Works by their key; a book without one is a work of its own."""
    rows = v.titles.withColumn("work_key", F.when(F.col("size") % 4 != 0, F.col("series_key")))
    scored = rows.select("source_id", selection.group_key().alias("work"), F.lit(False).alias("blocked"), (F.col("price") * 100000 + F.col("source_id") / 1000000.0).alias("score"))
    sizes = scored.groupBy("work").agg(F.count(F.lit(1)).alias("n"))
    return selection.best_editions(scored, ["work"]).select("work", F.col("source_id").alias("best")).join(sizes, "work").select("work", "n", "best")


@query(
    """, matched AS (SELECT source_id, 'series:' || series_key AS reason, title AS work FROM books WHERE size % 3 = 0 UNION ALL SELECT source_id, 'genre:' || genre, title FROM books WHERE size % 4 = 0),
    wanted AS (SELECT DISTINCT source_id FROM matched)
    SELECT (SELECT count(*) FROM matched) AS matched, (SELECT count(*) FROM matched) - (SELECT count(*) FROM (SELECT DISTINCT reason, work FROM matched)) AS deduped,
           count(*) FILTER (WHERE l.source_id IS NULL AND q.source_id IS NULL) AS queued, count(*) FILTER (WHERE l.source_id IS NULL AND q.source_id IS NOT NULL) AS already_queued, count(*) FILTER (WHERE l.source_id IS NOT NULL) AS already_linked
    FROM wanted w LEFT JOIN queue q ON q.source_id = w.source_id LEFT JOIN links l ON l.source_id = w.source_id"""
)
def refresh_totals(v: Views) -> DataFrame:
    one = lambda where, reason: v.titles.filter(where).select("source_id", reason.alias("reason"), F.col("title").alias("work"))
    matched = once(one("size % 3 = 0", F.concat(F.lit("series:"), "series_key")).unionByName(one("size % 4 = 0", F.concat(F.lit("genre:"), "genre"))))
    return queue.refresh_totals(matched, queue.reasons_by_source(matched), v.queue, v.links)


@query("SELECT q.source_id, q.state, p_name AS title, l.item_id, CAST(CASE WHEN q.source_id % 5 = 0 THEN q.source_id % 3 END AS BIGINT) AS downloaded FROM queue q LEFT JOIN part ON p_partkey = q.source_id LEFT JOIN links l ON l.source_id = q.source_id")
def queue_enriched(v: Views) -> DataFrame:
    """All entries with what is known of their books, links and audio files."""
    audio = v.queue.filter("source_id % 5 = 0").select("source_id", (F.col("source_id") % 3).cast("long").alias("downloaded"))
    return queue.enriched(v.queue.select("source_id", "state"), v.titles.select("source_id", "title"), v.links, audio).select("source_id", "state", "title", "item_id", "downloaded")


@query("SELECT source_id, item_id FROM links WHERE source_id % 3 <> 0")
def remove_links(v: Views) -> DataFrame:
    return merge.delete_keys(v.links, v.queue.filter("source_id % 3 = 0"), ["source_id"])


# --- sync


def _sync_tables(v: Views) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Books, items, matches and links: every book has an item that a match links to it."""
    null, none, i = F.lit(None).cast("string"), F.array().cast("array<string>"), F.col("source_id")
    empty = {**{c: null for c in ("subtitle", "description", "published_year", "isbn", "asin", "series_seq")}, **{c: none for c in ("authors", "narrators", "genres", "tags")}}
    books = v.titles.withColumns(empty)
    item = F.concat(F.lit("i"), i.cast("string"))
    items = v.titles.select(
        item.alias("item_id"), F.lit("main").alias("library_id"), F.when(F.col("size") % 7 != 0, F.concat(F.lit("/books/"), i.cast("string"))).alias("path"), F.when(F.col("size") % 2 == 0, F.col("title")).otherwise("edited").alias("title"),
        null.alias("subtitle"), null.alias("description"), null.alias("asin"), null.alias("isbn"), F.lit("ukr").alias("language"), null.alias("published_year"), none.alias("authors"), none.alias("narrators"),
        F.array(F.col("series_name")).alias("series"), none.alias("genres"), F.array(F.concat(F.lit("shelfmark:"), i.cast("string"))).alias("tags"),
    )
    matched = v.titles.select(item.alias("item_id"), F.when(F.col("size") % 11 != 0, i).alias("source_id"), F.lit(0.9).alias("score"), F.lit("fuzzy").alias("via"))
    wrote = books.select("source_id", item.alias("abs_item_id"), sidecar.build().alias("s"), "size")
    links = schema.conform(wrote.filter("size % 3 = 0").select("source_id", "abs_item_id", sidecar.digest(F.col("s")).alias("written_hash"), F.to_json("s").alias("written_payload"), F.lit(0.5).alias("confidence"), F.lit(True).alias("pinned")), "abs_links")
    return books, items, matched, links


_SYNC_SQL = """, s AS (SELECT *, size % 2 <> 0 AS edited, size % 3 = 0 AS linked FROM books WHERE size % 11 <> 0),
d AS (SELECT *, edited AND NOT linked AS changed, size % 7 <> 0 AS has_path FROM s)
"""


def _sync_rows(v: Views) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    books, items, matched, links = _sync_tables(v)
    rows = sync.reconciled(items, books, matched, links, "overwrite-ours", "shelfmark")
    maps = v.spark.createDataFrame([(0, "/books", "/mnt")], "pos int, from string, to string")
    media = v.titles.filter("size % 5 <> 0").select(F.concat(F.lit("/mnt/"), _text("source_id")).alias("dir"))
    return rows, sync.actions(rows, maps, media), links, items


@query(
    _SYNC_SQL
    + """SELECT 'i' || source_id AS item_id, source_id, CASE WHEN has_path THEN '/mnt/' || source_id END AS folder, CASE WHEN NOT has_path THEN 'error' WHEN NOT changed AND linked AND NOT edited AND size % 5 <> 0 THEN 'skip' ELSE 'write' END AS action, CASE WHEN NOT has_path THEN 'no local path' END AS error FROM d"""
)
def sync_actions(v: Views) -> DataFrame:
    """What a sync does with each matched item: an edited title that was never ours stays, and so does its payload's own hash."""
    return _sync_rows(v)[1].select("item_id", "source_id", "folder", "action", "error")


@query(_SYNC_SQL + "SELECT source_id, linked AND has_path AND NOT (NOT edited AND size % 5 <> 0) AS stamped FROM (SELECT *, size % 7 <> 0 AS p FROM (SELECT *, size % 2 <> 0 AS edited, size % 3 = 0 AS linked, size % 7 <> 0 AND size % 11 <> 0 AS has_path FROM books)) WHERE linked")
def sync_recorded(v: Views) -> DataFrame:
    """Links after the writes: those that were written have a time."""
    _, todo, links, _ = _sync_rows(v)
    return sync.recorded(links, todo, _at()).select("source_id", F.col("written_at").isNotNull().alias("stamped"))


@query("SELECT source_id, 'i' || source_id AS item, CAST(CASE WHEN size % 11 <> 0 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence, size % 3 = 0 AS pinned FROM books WHERE size % 11 <> 0 OR size % 3 = 0")
def sync_remembered(v: Views) -> DataFrame:
    """Links with what a sync matched: pins stay."""
    _, items, matched, links = _sync_tables(v)
    return sync.remembered(links, matched, items).select("source_id", F.col("abs_item_id").alias("item"), "confidence", "pinned")


@query("SELECT count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS matched, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS written, count(*) FILTER (WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 0) AS unchanged, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS errors FROM orders", views=False)
def sync_counters(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    return telemetry.sync_counters(v.table("orders").select(F.when(k % 4 == 0, "none").otherwise("tag").alias("via"), (k % 3 == 0).alias("written"), F.when(k % 5 == 0, F.concat(F.lit("e"), (k % 4).cast("string"))).alias("error")))


@query("SELECT 'e' || (o_orderkey % 4) AS error, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1", views=False)
def sync_errors(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    return telemetry.sync_errors(v.table("orders").select(F.when(k % 5 == 0, F.concat(F.lit("e"), (k % 4).cast("string"))).alias("error")))


@query("SELECT p_partkey AS source_id, CASE WHEN p_size % 3 = 0 THEN p_name END AS title, CASE WHEN p_size % 3 = 0 THEN 'a|b' END AS tags FROM part", views=False)
def previous_payloads(v: Views) -> DataFrame:
    """What was written last, from its JSON; nothing where that is missing or malformed."""
    payload = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('{"title":"'), "p_name", F.lit('","tags":["a","b"],"other":1}'))).when(F.col("p_size") % 3 == 1, F.concat(F.lit('{"title":"'), "p_name"))
    return v.table("part").select(F.col("p_partkey").alias("source_id"), sidecar.previous(payload).alias("p")).select("source_id", F.col("p.title").alias("title"), F.array_join("p.tags", "|").alias("tags"))


@query("""SELECT p_partkey AS source_id, '{' || chr(10) || '  "title" : "' || p_name || '",' || chr(10) || CASE WHEN p_size % 4 <> 0 THEN '  "genres" : [ "' || lower(p_type) || '", "audio" ],' || chr(10) ELSE '' END || '  "tags" : [ "a", "shelf:' || p_partkey || '" ]' || CASE WHEN p_size % 3 = 0 THEN ',' || chr(10) || '  "description" : "about ' || p_name || '"' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN ',' || chr(10) || '  "language" : "ukr"' ELSE '' END || chr(10) || '}' || chr(10) AS text FROM part""", views=False)
def sidecar_text(v: Views) -> DataFrame:
    return _generations(v).select("source_id", sidecar.serialised(F.col("desired")).alias("text"))


@query("SELECT '/stage/' || s_suppkey || '-slug' || '/' || f AS path FROM (SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['metadata.json', CASE WHEN s_suppkey % 2 = 0 THEN 'cover.png' ELSE 'cover.jpg' END] ELSE ['metadata.json'] END) AS f FROM supplier)", views=False)
def staged_files(v: Views) -> DataFrame:
    """The files of staging folders: a sidecar each, and a cover where there is one."""
    i = F.col("s_suppkey")
    none = lambda f: F.lit(None).cast("array<string>" if f in sidecar.LISTS else "string")
    card = F.struct(*[(F.col("s_name") if f == "title" else none(f)).alias(f) for f in sidecar.FIELDS])
    books = v.table("supplier").select(i.alias("source_id"), F.lit("slug").alias("slug"), card.alias("sidecar"))
    covers = v.table("supplier").filter("s_suppkey % 3 = 0").select(i.alias("source_id"), F.when(i % 2 == 0, "image/png").alias("content_type"), F.lit("https://x/c").alias("url"), F.lit(b"x").alias("bytes"))
    return sync.staged(books, covers, "/stage").select("path")


@query("SELECT '/stage/' || s_suppkey || '/' || f AS path FROM (SELECT s_suppkey, unnest(['cover.jpg', 'cover.webp']) AS f FROM supplier WHERE s_suppkey % 2 = 0) WHERE f <> CASE WHEN s_suppkey % 4 = 0 THEN 'cover.jpg' ELSE 'cover.png' END", views=False)
def stale_covers(v: Views) -> DataFrame:
    i = F.col("s_suppkey")
    path = lambda name: F.concat(F.lit("/stage/"), i.cast("string"), F.lit("/"), name)
    new = v.table("supplier").filter(i % 2 == 0).select(F.explode(F.array(path(F.when(i % 4 == 0, "cover.jpg").otherwise("cover.png")), path(F.lit("metadata.json")))).alias("path"))
    present = v.table("supplier").select(F.explode(F.array(path(F.lit("cover.jpg")), path(F.lit("cover.webp")), path(F.lit("metadata.json")))).alias("path"))
    return sync.stale_covers(new, present)


# --- playlists


@query("""SELECT playlist_id, 'https://list.example.org/' || playlist_id AS playlist_url, CAST(pos AS INTEGER) AS pos, file, name FROM (SELECT conv_id AS playlist_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 4, '0') || '-' || CASE turn % 3 WHEN 0 THEN 'é' || turn || '.mp3' ELSE turn || '.ogg' END AS file, CASE turn % 3 WHEN 0 THEN conv_id || '/é' || turn || '.mp3' ELSE 'a/files/' || turn || '.ogg' END AS name FROM conversations WHERE turn % 3 <> 2)""", views=False)
def tracks_manifest(v: Views) -> DataFrame:
    """Manifests written and read again."""
    found = playlist.tracks(_playlists(v), base_col="base")
    made = playlist.manifest(found, url=F.concat(F.lit("https://list.example.org/"), _text("playlist_id")))
    broken = made.limit(1).select(F.lit(-1).cast(made.schema["playlist_id"].dataType).alias("playlist_id"), F.lit('{"tracks":').alias("manifest"))
    return playlist.read_manifest(made.unionByName(broken))


@query("SELECT conv_id AS playlist_id, CASE WHEN conv_id % 2 = 0 THEN count(*) FILTER (WHERE turn % 4 <> 0) ELSE count(*) FILTER (WHERE turn % 4 <> 0) END AS downloaded, CASE WHEN conv_id % 2 = 0 THEN count(*) ELSE count(*) FILTER (WHERE turn % 4 <> 0) END AS total, CASE WHEN conv_id % 2 = 0 THEN bool_and(turn % 4 <> 0) ELSE true END AS complete FROM conversations GROUP BY conv_id HAVING conv_id % 2 = 0 OR count(*) FILTER (WHERE turn % 4 <> 0) > 0", views=False)
def folder_status(v: Views) -> DataFrame:
    """Audio of folders: half of them with a manifest, a quarter of the files too small."""
    c = v.table("conversations").select(F.col("conv_id").alias("playlist_id"), "turn", F.concat(_text("turn"), F.lit(".mp3")).alias("file"))
    files = c.select("playlist_id", "file", F.when(F.col("turn") % 4 == 0, 10).otherwise(5000).alias("length"))
    manifests = c.filter("playlist_id % 2 = 0").groupBy("playlist_id").agg(F.to_json(F.struct(F.collect_list(F.struct("file")).alias("tracks"))).alias("manifest"))
    return playlist.folder_status(manifests, files)


@query("SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN (s_suppkey + 1) || '-from-url' WHEN 1 THEN s_suppkey || '-own' WHEN 2 THEN '77-whole' WHEN 3 THEN s_suppkey || '-a.b' END AS key, 'https://catalogue.example.org/m33u2/' || CASE s_suppkey % 6 WHEN 0 THEN (s_suppkey + 1) || '-from-url' WHEN 1 THEN s_suppkey || '-own' WHEN 2 THEN '77-whole' WHEN 3 THEN s_suppkey || '-a.b' END || '.m3u' AS url FROM supplier", views=False)
def playlist_keys(v: Views) -> DataFrame:
    """The playlists' names by the books' URLs, ids and slugs."""
    i = F.col("s_suppkey")
    k = i % 6
    url = F.when(k == 0, F.concat(F.lit(f"{urls.BASE}/"), (i + 1).cast("string"), F.lit("-from-url.html"))).when(k == 1, f"{urls.BASE}/blog/")
    slug = F.when(k == 2, "77-whole").when(k == 3, "a%2Eb").when(k == 4, "%3Chtml%3E").when(k == 5, "").otherwise("own")
    rows = v.table("supplier").select(i.alias("id"), playlist.playlist_key(F.when(k != 2, i), slug, url).alias("key"))
    return rows.select("id", "key", urls.playlist_url(F.col("key")).alias("url"))


@query("SELECT c_custkey AS id, '7-' || 'slug' || c_custkey AS folder FROM customer", views=False)
def staging_folders(v: Views) -> DataFrame:
    return v.table("customer").select(F.col("c_custkey").alias("id"), playlist.staging_folder(F.lit(7), F.concat(F.lit("slug"), _text("c_custkey"))).alias("folder"))


# --- text and telemetry


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_size % 10 BETWEEN 2 AND 4 WHEN p_size % 3 = 1 THEN p_size % 10 = 3 END AS inside FROM part", views=False)
def years_inside(v: Views) -> DataFrame:
    title = F.when(F.col("p_size") % 3 == 0, "Years 2 - Four").when(F.col("p_size") % 3 == 1, "Year three").otherwise("No range")
    return v.table("part").select(F.col("p_partkey").alias("id"), text.in_year_range(text.year_range(title), F.col("p_size") % 10).alias("inside"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'library:' || chr(10) || '  apiKey: "***"' || chr(10) || 'x: ' || s_name ELSE 'no: ' || s_name END AS text FROM supplier""", views=False)
def redacted(v: Views) -> DataFrame:
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("library:\n  apiKey: "), "s_name", F.lit("\nx: "), "s_name")).otherwise(F.concat(F.lit("no: "), "s_name"))
    return v.table("supplier").select(F.col("s_suppkey").alias("id"), text.redact(raw).alias("text"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'never' WHEN s < 90 THEN s || 's ago' WHEN s < 5400 THEN CAST(floor(s / 60.0 + 0.5) AS BIGINT) || 'm ago' WHEN s < 172800 THEN CAST(floor(s / 3600.0 + 0.5) AS BIGINT) || 'h ago' ELSE CAST(floor(s / 86400.0 + 0.5) AS BIGINT) || 'd ago' END AS ago FROM (SELECT *, c_custkey * c_custkey AS s FROM customer)", views=False)
def ago(v: Views) -> DataFrame:
    i = F.col("c_custkey").cast("long")
    return v.table("customer").select("c_custkey", text.format_ago(F.when(i % 10 != 0, i * i)).alias("ago")).withColumnRenamed("c_custkey", "id")


@query("SELECT event_id AS id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 200)", views=False)
def log_tail(v: Views) -> DataFrame:
    return telemetry.recent(v.fetch_log.select("id", "event_type"), 200)


@query("SELECT event_id AS id, event_type FROM (SELECT event_id, event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 2 = 1) ORDER BY id DESC LIMIT 1000", views=False)
def log_compacted(v: Views) -> DataFrame:
    """A log with new entries appended, cut to its bound."""
    log = v.fetch_log.select("id", "event_type")
    return merge.keep_newest(log.filter("id % 2 = 0").unionByName(log.filter("id % 2 = 1")), 1000)


@query("SELECT event_id AS id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT (SELECT count(*) // 10 FROM events)", views=False)
def log_newest_tenth(v: Views) -> DataFrame:
    """The newest tenth of the log by time, by a threshold instead of a sort."""
    log = v.fetch_log.select(F.col("at").cast("timestamp").alias("at"), "id", "event_type")
    return newest.newest(log, log.count() // 10, ["at", "id"]).select("id", "event_type")


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS origin, event_id AS id, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), s AS (
      SELECT origin, id, n, at_ms AS go_ms FROM e WHERE n = 1 UNION ALL SELECT e.origin, e.id, e.n, greatest(e.at_ms, s.go_ms + 3600000) FROM s JOIN e ON e.origin = s.origin AND e.n = s.n + 1)
    SELECT origin, id, CAST(go_ms AS BIGINT) AS go_ms FROM s""",
    views=False,
)
def paced_requests(v: Views) -> DataFrame:
    """When each request of an origin may go, an hour apart."""
    return telemetry.paced(v.fetch_log.select("origin", "id", "at_ms"), "origin", 3_600_000).select("origin", "id", "go_ms")


@query(
    "SELECT user_id AS origin, event_id AS id, coalesce(epoch_us(ts) // 1000 < max(CASE WHEN event_type = 'error' THEN epoch_us(ts) // 1000 + 43200000 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS blocked FROM events",
    views=False,
)
def probe_blocks(v: Views) -> DataFrame:
    """Requests inside the window that a challenge opens, half a day here."""
    return telemetry.probe_blocked(v.fetch_log.select("origin", "id", "at_ms", "kind"), "origin", 43_200_000).select("origin", "id", "blocked")


@query(
    """SELECT page_id AS id, CASE WHEN mapped LIKE '/en/%' OR mapped = '/en' THEN '/mnt/english' || substr(mapped, 4) ELSE mapped END AS back FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/en/a' || page_id WHEN 1 THEN '/en' ELSE '/fr/b' END AS mapped FROM pages)""",
    views=False,
)
def path_back(v: Views) -> DataFrame:
    """Local paths to the library's, the mappings taken the other way."""
    rules = v.spark.createDataFrame([(0, "/mnt/english/", "/en")], "pos int, from string, to string")
    i = F.col("page_id")
    local = v.table("pages").select(i.alias("id"), F.when(i % 3 == 0, F.concat(F.lit("/en/a"), i.cast("string"))).when(i % 3 == 1, "/en").otherwise("/fr/b").alias("path"))
    return matching.map_paths(local, rules, inverse=True).select("id", F.col("mapped").alias("back"))


_CONFIG = """
logLevel: info
server: {port: 9000}
sync: {writePolicy: fill-empty, matchThreshold: 0.9, linkMode: hardlink}
audio: {trackConcurrency: 5}
subscriptions:
  - {type: author, value: A, enabled: false}
  - {type: tag, value: B, note: '', enabled: true}
"""
_ENVIRONMENT = {"PORT": "x", "HOST": " 0.0.0.0 ", "WRITE_POLICY": "", "AUDIO_TRACK_CONCURRENCY": "7", "LOG_LEVEL": "warn"}


def _flat(given: object, at: str = "") -> list[tuple[str, str]]:
    if isinstance(given, dict):
        return [x for k, v in given.items() for x in _flat(v, f"{at}.{k}".strip("."))]
    if isinstance(given, list):
        return [x for k, v in enumerate(given) for x in _flat(v, f"{at}[{k}]")]
    return [(at, str(given))]


@query("SELECT * FROM (VALUES ('logLevel', 'warn'), ('server.host', '0.0.0.0'), ('server.port', '9000'), ('audio.trackConcurrency', '7'), ('sync.writePolicy', 'fill-empty'), ('sync.matchThreshold', '0.9'), ('subscriptions[0].type', 'author'), ('subscriptions[0].value', 'A'), ('subscriptions[0].enabled', 'False'), ('subscriptions[1].type', 'tag'), ('subscriptions[1].value', 'B')) t(setting, value)", views=False)
def config_differences(v: Views) -> DataFrame:
    """A configuration under its environment, what differs from the defaults: on the driver, as configurations are."""
    effective = config.overlay(config.parse(_CONFIG), _ENVIRONMENT)
    return v.spark.createDataFrame(_flat(config.compact(effective)), "setting string, value string")


@query("SELECT c_custkey AS pos, upper(c_name) AS name FROM customer", views=False)
def pool_in_order(v: Views) -> DataFrame:
    """Work on rows by four tasks at most."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.utf8_upper(batch.column(1))], names=["pos", "name"])

    rows = v.table("customer").select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"))
    return pool.ordered_map(rows, work, f"pos {rows.schema['pos'].dataType.simpleString()}, name string", 4, "pos")


# --- payloads


@query(
    """WITH b AS (SELECT o_orderkey AS source_id, CASE o_orderkey % 6 WHEN 0 THEN unhex('FFD8FFE0') WHEN 1 THEN unhex('89504E470D0A1A0A') WHEN 2 THEN unhex('524946460000000057454250') WHEN 3 THEN encode(' <!DOCTYPE html>') ELSE encode('ID3') END
      || encode(CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE repeat(o_orderpriority, 20) END) AS content FROM orders)
    SELECT source_id, CASE WHEN ok THEN sha256(content) END AS digest, CASE WHEN ok THEN CASE source_id % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' ELSE 'application/octet-stream' END END AS content_type,
      CASE WHEN ok THEN 'ok' WHEN source_id % 6 = 5 THEN 'missing' WHEN source_id % 6 = 3 THEN 'html' ELSE 'short' END AS outcome FROM (SELECT *, source_id % 6 NOT IN (3, 5) AND source_id % 7 <> 0 AS ok FROM b)""",
    views=False,
)
def payload_types(v: Views) -> DataFrame:
    """Covers and files that came as base64 in a browser service's responses, in each of its places, and what they are by their first bytes."""
    k = F.col("o_orderkey")
    magic = lambda digits: F.unhex(F.lit(digits))
    head = F.when(k % 6 == 0, magic("FFD8FFE0")).when(k % 6 == 1, magic("89504E470D0A1A0A")).when(k % 6 == 2, magic("524946460000000057454250")).when(k % 6 == 3, F.lit(" <!DOCTYPE html>").cast("binary")).otherwise(F.lit("ID3").cast("binary"))
    rest = F.when(k % 7 == 0, "").otherwise(F.repeat("o_orderpriority", F.lit(20))).cast("binary")
    coded = F.base64(F.concat(head, rest))
    body = (
        F.when(k % 6 == 0, F.concat(F.lit('{"solution":{"download":{"data":"data:image/x;base64,'), coded, F.lit('","mime":"image/x"}}}')))
        .when(k % 6 == 1, F.concat(F.lit('{"solution":{"download":[{"encoded_data":"'), F.translate(coded, "+/=", "-_"), F.lit('"}]}}')))
        .when(k % 6 == 5, F.concat(F.lit('{"solution":{"response":"'), coded, F.lit('"}}')))
        .otherwise(F.concat(F.lit('{"solution":{"responseEncoding":"base64","response":"'), F.regexp_replace(coded, "\r?\n", ""), F.lit('"}}')))
    )
    got = downloads.downloads(v.table("orders").select(k.alias("source_id"), F.regexp_replace(body, "\r?\n", "").alias("body")))
    return got.select("source_id", F.sha2("content", 256).alias("digest"), "content_type", "outcome")


@query("SELECT 'cover' || s_suppkey || '.jpg' AS file, CASE s_suppkey % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' END AS kind, CAST(12 + strlen(s_name) AS BIGINT) AS length FROM supplier", views=False)
def sniffed_covers(v: Views) -> DataFrame:
    """Cover files of one extension, written and read again, by what they hold."""
    folder, k = landing(v.spark), F.col("s_suppkey")
    head = F.when(k % 4 == 0, F.unhex(F.lit("FFD8FFE00000000000000000"))).when(k % 4 == 1, F.unhex(F.lit("89504E470D0A1A0A00000000"))).when(k % 4 == 2, F.unhex(F.lit("524946460000000057454250"))).otherwise(F.lit("no picture..").cast("binary"))
    path = F.concat(F.lit(f"{folder}/"), (k % 16).cast("string"), F.lit("/cover"), k.cast("string"), F.lit(".jpg"))
    library.write_files(v.table("supplier").select(path.alias("path"), F.concat(head, F.col("s_name").cast("binary")).alias("content")))
    return library.sniffed(v.spark, folder).select("file", "kind", "length")


@query(
    """WITH days AS (SELECT event_type AS kind, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE value >= 1) AS n_done, count(*) AS n_pages FROM events GROUP BY ALL)
    SELECT event_id AS page_id, event_type AS kind, CAST(ts AS DATE) AS day, user_id FROM events JOIN days ON event_type = kind AND CAST(ts AS DATE) = day WHERE n_done < n_pages""",
    views=False,
)
def landed_backfill(v: Views) -> DataFrame:
    """Fetched pages landed by kind and day, and those of days that aren't done, whose folders alone are opened."""
    folder, e = landing(v.spark), v.table("events")
    pages_ = e.select(F.col("event_id").alias("page_id"), "user_id")
    landed.land(e.select(F.col("event_id").alias("page_id"), "user_id", "event_type", "ts"), folder, F.col("event_type"), F.col("ts"))
    log = e.groupBy(F.col("event_type").alias("kind"), F.to_date("ts").alias("day")).agg(F.count_if(F.col("value") >= 1).alias("n_done"), F.count(F.lit(1)).alias("n_pages"))
    return landed.open_days(landed.landed(v.spark, folder, pages_.schema), log).select("page_id", "kind", "day", "user_id")
