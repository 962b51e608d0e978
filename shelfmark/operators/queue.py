"""The queue's state machine and its views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import merge as m

#: Buckets that number new entries; bounds the table of their starts.
BUCKETS = 1024


def reasons_by_source(winners: DataFrame, *more: Column) -> DataFrame:
    """(source_id, reason): the distinct reasons of a book, sorted, in one text; and ``more`` aggregates."""
    return winners.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ", ").alias("reason"), *more)


def outcomes(wanted: DataFrame, queue: DataFrame, links: DataFrame) -> DataFrame:
    """What a refresh does with each wanted (source_id, reason): queued, refreshed, synced or left."""
    linked = links.select("source_id").distinct().withColumn("linked", F.lit(True))
    known = queue.select("source_id", F.col("state").alias("old_state"))
    what = (
        F.when(F.col("linked") & (F.col("old_state") == "new"), "synced").when(F.col("linked"), "left")
        .when(F.col("old_state").isNotNull(), "refreshed").otherwise("queued")
    )
    return wanted.join(linked, "source_id", "left").join(known, "source_id", "left").withColumn("outcome", what)


def transition(queue: DataFrame, wanted: DataFrame, links: DataFrame, as_of: Column) -> DataFrame:
    """The queue after a refresh at ``as_of``.

    Linked books that are new become synced; other linked ones stay; queued ones get the new reason,
    whatever their state; the rest is inserted as new, with ids after the greatest there is.
    """
    told = outcomes(wanted, queue, links).filter("outcome <> 'left'").select("source_id", F.col("reason").alias("new_reason"), "outcome")
    both = queue.join(told, "source_id", "full_outer")
    new = F.col("outcome").isNotNull()
    changed = both.select(
        "id",
        "source_id",
        F.when(new, F.col("new_reason")).otherwise(F.col("reason")).alias("reason"),
        F.when(F.col("outcome") == "synced", "synced").when(F.col("outcome") == "queued", "new").otherwise(F.col("state")).alias("state"),
        "note",
        F.coalesce("created_at", as_of).alias("created_at"),
        F.when(new, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    # ids run on from the greatest one: inside hash buckets, after the counts of the buckets before
    top = queue.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    added = changed.filter("id is null").withColumn("bucket", F.pmod(F.xxhash64("source_id"), F.lit(BUCKETS)))
    counts = added.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).crossJoin(top)
    placed = added.join(F.broadcast(starts), "bucket").withColumn("id", F.col("top") + F.col("start") + F.row_number().over(Window.partitionBy("bucket").orderBy("source_id")))
    return changed.filter("id is not null").unionByName(placed.select(*changed.columns))


def counters(wanted: DataFrame, queue: DataFrame, links: DataFrame) -> DataFrame:
    """One row: queued, already_queued and already_linked of a refresh."""
    done = outcomes(wanted, queue, links)
    return done.agg(F.count_if(F.col("outcome") == "queued").alias("queued"), F.count_if(F.col("outcome") == "refreshed").alias("already_queued"), F.count_if(F.col("outcome").isin("synced", "left")).alias("already_linked"))


def refresh_totals(matched: DataFrame, wanted: DataFrame, queue: DataFrame, links: DataFrame) -> DataFrame:
    """One row: what ``counters`` tells, with matched (source_id, reason, work) rows and those that a better edition stands for."""
    found = matched.agg(F.count(F.lit(1)).alias("matched"), (F.count(F.lit(1)) - F.count_distinct("reason", "work")).alias("deduped"))
    return found.crossJoin(F.broadcast(counters(wanted, queue, links)))  # one row each


def set_state(queue: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """(id, state, note): the new state; the old note stays unless there is a new one."""
    return m.update_by_key(queue, changes.withColumn("updated_at", as_of), ["id"], {"state": m.OVERWRITE, "note": m.TAKE, "updated_at": m.OVERWRITE})


def delete_entries(queue: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queue without the entries, and the links without those of the entries' books."""
    gone = queue.join(ids.select("id").distinct(), "id", "left_semi").select("source_id")
    return m.delete_keys(queue, ids, ["id"]), m.delete_keys(links, gone, ["source_id"])


def state_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def listing(queue: DataFrame, state: str | None = None, limit: int = 200) -> DataFrame:
    """Newest entries first, to the second; ties by source_id."""
    rows = queue if state is None else queue.filter(F.col("state") == state)
    return rows.orderBy(F.date_trunc("second", "created_at").desc(), "source_id").limit(limit)


def enriched(entries: DataFrame, books: DataFrame, links: DataFrame, audio: DataFrame) -> DataFrame:
    """Entries with what is known of their books, links and audio files."""
    out = entries.join(books.withColumnRenamed("state", "book_state"), "source_id", "left") if "state" in books.columns else entries.join(books, "source_id", "left")
    return out.join(links, "source_id", "left").join(audio, "source_id", "left")


def prepare_batch(queue: DataFrame, limit: int = 50) -> DataFrame:
    """The oldest accepted or prepared entries, to the second; ties by source_id."""
    return queue.filter(F.col("state").isin("accepted", "prepared")).orderBy(F.date_trunc("second", "created_at"), "source_id").limit(limit)
