"""Keyed merges with a rule per column, and what goes with them: children, deletes, retention.

A merge computes the whole new table from the old one and a batch, to be written once. Rows of a batch
apply in arrival order: several rows of one key are first reduced to the one that has the same effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a rule does with a column of a key that is there already.
OVERWRITE = "overwrite"  # the new value, even a null
TAKE = "take"  # the new value unless it is null
KEEP = "keep"  # the old value unless it is null
KEEP_TEXT = "keep_text"  # the old value unless it is null or empty
GREATEST = "greatest"  # the greater one
INSERT_ONLY = "insert_only"  # the old value, always

_N = "__old_"


def reduce_batch(batch: DataFrame, keys: list[str], rules: dict[str, str], order: str | None) -> DataFrame:
    """One row per key with the effect of the key's rows applied one after the other."""
    if order is None:
        return batch
    seq = F.col(order)

    def reduced(name: str, rule: str) -> Column:
        value = F.col(name)
        some = F.when(value.isNotNull(), seq)
        if rule == OVERWRITE:
            return F.max_by(value, seq)
        if rule == TAKE:
            return F.max_by(value, some)
        if rule == GREATEST:
            return F.max(value)
        if rule == KEEP:
            return F.min_by(value, some)
        if rule == KEEP_TEXT:
            return F.coalesce(F.min_by(value, F.when(value.isNotNull() & (value != ""), seq)), F.max_by(value, seq))
        return F.min_by(value, seq)

    return batch.groupBy(*keys).agg(*[reduced(name, rule).alias(name) for name, rule in rules.items()])


def merge(target: DataFrame, batch: DataFrame, keys: list[str], rules: dict[str, str], order: str | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """``target`` with the rows of ``batch`` merged in; columns without a rule stay as they are.

    ``defaults`` are for columns that a new key gets no value for from the batch.
    """
    new = reduce_batch(batch, keys, rules, order)
    names = [c for c in target.columns if c not in keys]
    old = target.select(*keys, *[F.col(c).alias(_N + c) for c in names], F.lit(True).alias(f"{_N}there"))
    extra = [c for c in rules if c in new.columns]
    both = new.select(*keys, *extra, F.lit(True).alias("__new_there")).join(old, keys, "full_outer")
    was, is_new = F.col(f"{_N}there").isNotNull(), F.col("__new_there").isNotNull()

    def value(name: str) -> Column:
        before = F.col(_N + name)
        start = (defaults or {}).get(name, F.lit(None).cast(target.schema[name].dataType))
        if name not in extra:
            return F.when(was, before).otherwise(start)
        after, rule = F.col(name), rules[name]
        merged = {
            OVERWRITE: after,
            TAKE: F.coalesce(after, before),
            KEEP: F.coalesce(before, after),
            KEEP_TEXT: F.when(before.isNull() | (before.cast("string") == ""), after).otherwise(before),
            GREATEST: F.greatest(after, before),
            INSERT_ONLY: before,
        }[rule]
        return F.when(~is_new, before).when(~was, F.coalesce(after, start)).otherwise(merged)

    return both.select(*[F.col(k) if k in keys else value(k).cast(target.schema[k].dataType).alias(k) for k in target.columns])


#: Rules of the catalogue's merges.
ENTITY = {"name": OVERWRITE, "book_count": TAKE}
GENRE = {"name": OVERWRITE}
LISTING = {"url": OVERWRITE, "slug": OVERWRITE, "title": KEEP_TEXT, "cover_url": KEEP, "duration_sec": KEEP, "rating": TAKE, "votes": TAKE, "first_seen_at": INSERT_ONLY}
FACET_SERIES = {"series_key": KEEP, "series_name": KEEP}
DETAIL = {
    **{c: OVERWRITE for c in ("url", "slug", "title", "description", "cover_url", "duration_sec", "rating", "votes", "series_key", "series_name", "series_seq", "fetched_at", "content_hash", "work_key", "work_label", "detail_state", "detail_error")},
    "lastmod": TAKE,
    "first_seen_at": INSERT_ONLY,
}
LINK = {"abs_library_id": TAKE, "abs_path": TAKE, "confidence": TAKE, "pinned": GREATEST}
META = {"value": OVERWRITE}


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't there are added, once a key."""
    fresh = new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def replace_children(existing: DataFrame, parents: DataFrame, new: DataFrame, parent: str, keys: list[str]) -> DataFrame:
    """The children of ``parents`` are replaced by those in ``new``; other parents keep theirs."""
    kept = existing.join(parents.select(parent).distinct(), parent, "left_anti")
    return kept.select(*existing.columns).unionByName(new.select(*existing.columns).dropDuplicates(keys))


def update_by_key(target: DataFrame, changes: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """A merge that adds no key."""
    return merge(target, changes.join(target.select(*keys), keys, "left_semi"), keys, rules)


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def keep_newest(df: DataFrame, n: int, by: str = "id") -> DataFrame:
    """The n rows with the greatest ``by``: a bounded retention."""
    return df.orderBy(F.col(by).desc()).limit(n)


def content_hash(*columns: Column) -> Column:
    """md5 of the columns' JSON; nulls don't count."""
    return F.md5(F.to_json(F.struct(*columns)).cast("binary"))
