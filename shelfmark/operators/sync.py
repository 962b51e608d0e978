"""Library sync as a plan: which item is which book, what changes, and what is to be done.

Nothing is written here. Each step is a table, failures are a column, and the last table lists actions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import target_folder
from ..functions.urls import cover_extension
from . import matching, sidecar
from . import merge as m
from .playlist import staging_folder


def remembered(links: DataFrame, matched: DataFrame, items: DataFrame) -> DataFrame:
    """Links with what a sync matched: (source_id, item_id) pairs are added or refreshed."""
    found = matched.filter("source_id is not null").join(items.select("item_id", "library_id", "path"), "item_id")
    batch = found.select("source_id", F.col("item_id").alias("abs_item_id"), F.col("library_id").alias("abs_library_id"), F.col("path").alias("abs_path"), F.col("score").alias("confidence"), F.lit(False).alias("pinned"))
    return m.merge(links, batch, ["source_id", "abs_item_id"], m.LINK)


def reconciled(items: DataFrame, books: DataFrame, matched: DataFrame, links: DataFrame, policy: str, prefix: str, language: str = "ukr") -> DataFrame:
    """A row per matched item with payload, changed fields and the payload's hash beside the last one.

    ``links`` are those from before the sync: what was written last is read from them.
    """
    wanted = books.select("source_id", sidecar.build(language, prefix).alias("desired"))
    have = items.select("item_id", "path", sidecar.of_item().alias("current"))
    last = links.select(F.col("abs_item_id").alias("item_id"), "source_id", "written_hash", sidecar.previous(F.col("written_payload")).alias("previous"))
    rows = matched.filter("source_id is not null").join(wanted, "source_id").join(have, "item_id").join(last, ["item_id", "source_id"], "left")
    return sidecar.reconcile(rows, policy).withColumn("hash", sidecar.digest(F.col("payload")))


def actions(rows: DataFrame, mappings: DataFrame, media_folders: DataFrame) -> DataFrame:
    """(item_id, source_id, folder, action, error): write, skip or error.

    An item is skipped if nothing changed, the last hash is the same and its folder has media
    (``media_folders`` has a column dir). An item without a path is an error.
    """
    mapped = matching.map_paths(rows.select(F.col("item_id").alias("id"), "path"), mappings).select(F.col("id").alias("item_id"), F.col("mapped").alias("folder"))
    there = media_folders.select(F.col("dir").alias("folder")).distinct().withColumn("has_media", F.lit(True))
    full = rows.join(mapped, "item_id").join(there, "folder", "left")
    error = F.when(F.coalesce("folder", F.lit("")) == "", "no local path")
    same = ~F.col("changed") & F.coalesce(F.col("hash") == F.col("written_hash"), F.lit(False)) & F.coalesce("has_media", F.lit(False))
    return full.select("item_id", "source_id", "folder", F.when(error.isNotNull(), "error").when(same, "skip").otherwise("write").alias("action"), error.alias("error"), "hash", F.to_json("payload").alias("payload"))


def recorded(links: DataFrame, done: DataFrame, at) -> DataFrame:
    """Links after the writes of ``done``: hash, payload and time."""
    batch = done.filter("action = 'write'").select("source_id", F.col("item_id").alias("abs_item_id"), F.col("hash").alias("written_hash"), F.col("payload").alias("written_payload"), at.alias("written_at"))
    return m.update_by_key(links, batch, ["source_id", "abs_item_id"], {c: m.OVERWRITE for c in ("written_hash", "written_payload", "written_at")})


def prepared(batch: DataFrame, books: DataFrame, template: str = "{author}/{series}/{title}") -> DataFrame:
    """(source_id, folder) for queue entries that are to be laid out in the library."""
    author = F.try_element_at("authors", F.lit(1))
    return batch.join(books, "source_id").select("source_id", target_folder(author, F.col("series_name"), F.col("series_seq"), F.col("title"), template).alias("folder"))


def staged(books: DataFrame, covers: DataFrame, root: str) -> DataFrame:
    """(path, content) of what a book's staging folder gets: its sidecar, and its cover where there is one.

    ``books`` has source_id, slug and sidecar, ``covers`` source_id, content_type, url and bytes.
    """
    rows = books.select("source_id", F.concat(F.lit(root.rstrip("/") + "/"), staging_folder(F.col("source_id"), F.col("slug"))).alias("folder"), "sidecar")
    texts = rows.select(F.concat("folder", F.lit("/metadata.json")).alias("path"), sidecar.serialised(F.col("sidecar")).cast("binary").alias("content"))
    images = rows.join(covers, "source_id").select(F.concat("folder", F.lit("/cover"), cover_extension(F.col("content_type"), F.col("url"))).alias("path"), F.col("bytes").alias("content"))
    return texts.unionByName(images)


def stale_covers(staged_files: DataFrame, present: DataFrame) -> DataFrame:
    """(path): covers of other formats in folders that get a cover, which are to go."""
    folder, name = F.regexp_extract("path", "^(.*)/", 1), F.regexp_extract("path", "([^/]+)$", 1)
    cover = name.rlike(r"^cover\.(?:jpe?g|png|webp)$")
    new = staged_files.filter(cover).select(folder.alias("folder"), F.col("path").alias("new"))
    return present.filter(cover).select(folder.alias("folder"), "path").join(new, "folder").filter("path <> new").select("path")
