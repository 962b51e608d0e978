"""The catalogue's reads: people, subscriptions, counts, pending details, siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import work_key, work_label
from ..functions.urls import book_url
from . import merge as m


def names_of(bridge: DataFrame, dimension: DataFrame, bridge_key: str, out: str) -> DataFrame:
    """source_id to the sorted names that a bridge leads to."""
    found = bridge.join(dimension.select(F.col("key").alias(bridge_key), "name"), bridge_key)
    return found.groupBy("source_id").agg(F.array_sort(F.collect_list("name")).alias(out))


def with_people(books: DataFrame, authors: DataFrame, narrators: DataFrame, genres: DataFrame, tags: DataFrame) -> DataFrame:
    """Books with arrays authors, narrators, genres and tags; empty where there are none.

    Each input has source_id and one array column (``names_of``); tags may be flat (source_id, tag).
    """
    if "tag" in tags.columns:
        tags = tags.groupBy("source_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    out = books
    for side in (authors, narrators, genres, tags):
        name = next(c for c in side.columns if c != "source_id")
        out = out.join(side, "source_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def match_people(subscriptions: DataFrame, bridge: DataFrame, dimension: DataFrame, bridge_key: str, kind: str) -> DataFrame:
    """(source_id, reason) of books whose person has the subscribed key or name.

    The key and the lower-cased name are two equi-joins, each of one distinct entity table; a book
    comes once a subscription.
    """
    wanted = subscriptions.filter((F.col("type") == kind) & F.col("enabled")).select(F.lower(F.trim("value")).alias("needle"), F.concat_ws(":", "type", "value").alias("reason"))
    ways = dimension.select("key", F.col("key").alias("needle")).unionByName(dimension.select("key", F.lower("name").alias("needle"))).distinct()
    keys = ways.join(wanted, "needle").select(F.col("key").alias(bridge_key), "reason").distinct()
    return bridge.join(keys, bridge_key).select("source_id", "reason").distinct()


def match_series(subscriptions: DataFrame, books: DataFrame, series: DataFrame) -> DataFrame:
    """Series by the book's own key, or by the series' name where the series is known."""
    wanted = subscriptions.filter((F.col("type") == "series") & F.col("enabled")).select(F.lower(F.trim("value")).alias("needle"), F.concat_ws(":", "type", "value").alias("reason"))
    named = series.select("key", F.lower("name").alias("needle"))
    ways = books.select("source_id", F.col("series_key").alias("needle")).unionByName(books.select("source_id", F.col("series_key").alias("key")).join(named, "key").select("source_id", "needle"))
    return ways.join(wanted, "needle").select("source_id", "reason").distinct()


def match_tag(subscriptions: DataFrame, tags: DataFrame) -> DataFrame:
    wanted = subscriptions.filter((F.col("type") == "tag") & F.col("enabled")).select(F.lower(F.trim("value")).alias("needle"), F.concat_ws(":", "type", "value").alias("reason"))
    return tags.select("source_id", F.lower("tag").alias("needle")).join(wanted, "needle").select("source_id", "reason").distinct()


def counts(tables: dict[str, DataFrame], state: str = "detail_state") -> DataFrame:
    """(name, n) of each table, and of the books by state, one pass a table."""
    out = None
    for name, df in tables.items():
        if name == "books":
            one = df.agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col(state) == "ok").alias("b"), F.count_if(F.col(state) == "pending").alias("c"))
            part = one.select(F.explode(F.array(F.struct(F.lit("books").alias("name"), F.col("a").alias("n")), F.struct(F.lit("books_ok").alias("name"), F.col("b").alias("n")), F.struct(F.lit("books_pending").alias("name"), F.col("c").alias("n")))).alias("x")).select("x.*")
        else:
            part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def pending_detail(books: DataFrame, wanted: DataFrame, queue: DataFrame, limit: int) -> DataFrame:
    """Pending books of subscriptions or the queue: never fetched first, then newest, then greatest id."""
    ids = wanted.select("source_id").union(queue.select("source_id")).distinct()
    pending = books.filter(F.col("detail_state") == "pending").join(ids, "source_id", "left_semi")
    return pending.orderBy(F.col("fetched_at").isNotNull(), F.coalesce("lastmod", F.lit("")).desc(), F.col("source_id").desc()).limit(limit)


def new_siblings(related: DataFrame, books: DataFrame) -> DataFrame:
    """Ids that pages link to and the catalogue lacks, as pending books without a title."""
    fresh = related.select(F.col("related_id").alias("source_id")).filter("source_id is not null").distinct().join(books.select("source_id"), "source_id", "left_anti")
    return fresh.select("source_id", book_url(F.col("source_id"), F.lit("")).alias("url"), F.lit("").alias("title"), F.lit("pending").alias("detail_state"))


def record_listing(books: DataFrame, cards: DataFrame, seen_at: Column, order: str | None = None) -> DataFrame:
    """Cards of listing pages: new books are pending, known ones are filled in."""
    batch = cards.withColumn("first_seen_at", seen_at)
    return m.merge(books, batch, ["source_id"], m.LISTING, order, {"detail_state": F.lit("pending")})


def attach_facet_series(books: DataFrame, facet: DataFrame) -> DataFrame:
    """(source_id, series_key, series_name) of a series' listing, where a book has none yet."""
    return m.update_by_key(books, facet, ["source_id"], m.FACET_SERIES)


def record_detail(books: DataFrame, parsed: DataFrame, fetched_at: Column, order: str | None = None) -> DataFrame:
    """Parsed detail pages: the book is overwritten, its state is ok and its error is gone."""
    names = F.transform("authors", lambda x: x["name"])
    batch = (
        parsed.withColumn("work_label", work_label(names, F.col("title")))
        .withColumn("work_key", work_key(names, F.col("title")))
        .withColumn("content_hash", m.content_hash(*[F.col(c) for c in ("title", "description", "cover_url", "duration_sec", "rating", "votes", "authors", "narrators", "genres", "tags")]))
        .withColumn("fetched_at", fetched_at)
        .withColumn("first_seen_at", fetched_at)
        .withColumn("detail_state", F.lit("ok"))
        .withColumn("detail_error", F.lit(None).cast("string"))
    )
    return m.merge(books, batch, ["source_id"], {k: v for k, v in m.DETAIL.items() if k in batch.columns}, order)


def _people(parsed: DataFrame, column: str) -> DataFrame:
    """(key, name, book_count) of the people that parsed pages name; of several names of a key the one of the greatest book counts."""
    flat = parsed.select("source_id", F.explode(column).alias("x"))
    return flat.groupBy(F.col("x.key").alias("key")).agg(F.max_by("x.name", "source_id").alias("name")).withColumn("book_count", F.lit(None).cast("int"))


def record_details(tables: dict[str, DataFrame], parsed: DataFrame, fetched_at: Column) -> dict[str, DataFrame]:
    """All tables after detail pages came in: the books, their people, genres and series, and the bridges of these books anew.

    ``tables`` are those of ``sources.schema``; ``parsed`` comes from ``pages.parse_books``, a row a book.
    """
    flat = parsed.withColumns({"series_key": F.col("series.key"), "series_name": F.col("series.name"), "series_seq": F.col("series.sequence")})
    out = {"books": record_detail(tables["books"], flat, fetched_at)}
    for name, column, key in (("authors", "authors", "author_key"), ("narrators", "narrators", "narrator_key"), ("genres", "genres", "genre_key")):
        found = _people(parsed, column)
        out[name] = m.merge(tables[name], found if name != "genres" else found.drop("book_count"), ["key"], m.GENRE if name == "genres" else m.ENTITY)
        fresh = parsed.select("source_id", F.explode(column).alias("x")).select("source_id", F.col("x.key").alias(key))
        out[f"book_{name}"] = m.replace_children(tables[f"book_{name}"], parsed, fresh, "source_id", ["source_id", key])
    series = _people(parsed.filter("series is not null").withColumn("all", F.array("series")), "all")
    out["series"] = m.merge(tables["series"], series, ["key"], m.ENTITY)
    out["book_tags"] = m.replace_children(tables["book_tags"], parsed, parsed.select("source_id", F.explode("tags").alias("tag")), "source_id", ["source_id", "tag"])
    return out


def skipped(landed: DataFrame, parsed: DataFrame) -> DataFrame:
    """(source_id, detail_state, detail_error) of landed pages that are no books."""
    return landed.select("source_id").join(parsed.select("source_id"), "source_id", "left_anti").select("source_id", F.lit("skipped").alias("detail_state"), F.lit("not a book page").alias("detail_error"))


def backfill(tables: dict[str, DataFrame], landed: DataFrame, parsed: DataFrame, fetched_at: Column) -> dict[str, DataFrame]:
    """All tables after a backfill: books recorded, other pages marked, and siblings that pages link to added as pending."""
    out = record_details(tables, parsed, fetched_at)
    books = mark_state(out["books"], skipped(landed, parsed), fetched_at)
    fresh = new_siblings(parsed.select(F.explode("related_ids").alias("related_id")), books).withColumn("slug", F.lit("")).withColumn("first_seen_at", fetched_at)
    extra = [F.col(c).cast(books.schema[c].dataType).alias(c) if c in fresh.columns else F.lit(None).cast(books.schema[c].dataType).alias(c) for c in books.columns]
    return {**tables, **out, "books": books.unionByName(fresh.select(*extra))}


def seed(authors: DataFrame, narrators: DataFrame, author_index: DataFrame, narrator_index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Authors and narrators after both index pages (``pages.parse_index``) came in."""
    entries = lambda index: index.groupBy("key").agg(F.min_by(F.struct("name", "book_count"), "page_id").alias("x")).select("key", "x.*")
    return m.merge(authors, entries(author_index), ["key"], m.ENTITY), m.merge(narrators, entries(narrator_index), ["key"], m.ENTITY)


def attach_facet(dimension: DataFrame, bridge: DataFrame, cards: DataFrame, bridge_key: str) -> tuple[DataFrame, DataFrame]:
    """An entity table and its bridge after listing cards (source_id, key, name) of facets came in: names are taken, pairs added once."""
    names = cards.groupBy("key").agg(F.min("name").alias("name")).withColumn("book_count", F.lit(None).cast("int"))
    return m.merge(dimension, names, ["key"], m.ENTITY), m.insert_or_ignore(bridge, cards.select("source_id", F.col("key").alias(bridge_key)), ["source_id", bridge_key])


def mark_state(books: DataFrame, marks: DataFrame, at: Column) -> DataFrame:
    """(source_id, detail_state, detail_error): the state as given, and when."""
    return m.update_by_key(books, marks.withColumn("fetched_at", at), ["source_id"], {"detail_state": m.OVERWRITE, "detail_error": m.OVERWRITE, "fetched_at": m.OVERWRITE})
