"""Sidecars: the metadata that a library should hold, merged three ways with what it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_series

#: The reconciled fields and their order.
FIELDS = ("title", "subtitle", "authors", "narrators", "series", "genres", "tags", "description", "publishedYear", "publisher", "language", "isbn", "asin")
LISTS = frozenset(("authors", "narrators", "series", "genres", "tags"))
POLICIES = ("fill-empty", "overwrite-ours", "overwrite-all")
SCHEMA = "struct<" + ",".join(f"{f}:{'array<string>' if f in LISTS else 'string'}" for f in FIELDS) + ">"


def source_tag(source_id: Column, prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), source_id.cast("string"))


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _list(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def _null(name: str) -> Column:
    return F.lit(None).cast("array<string>" if name in LISTS else "string")


def build(language: str = "ukr", prefix: str = "shelfmark") -> Column:
    """The sidecar of a book row with people and tags."""
    values = {
        "title": _some(F.col("title")), "subtitle": _some(F.col("subtitle")), "authors": _list(F.col("authors")), "narrators": _list(F.col("narrators")),
        "series": F.when(F.coalesce("series_name", F.lit("")) != "", F.array(format_series(F.col("series_name"), F.col("series_seq")))), "genres": _list(F.col("genres")),
        "tags": F.array_union(F.col("tags"), F.array(source_tag(F.col("source_id"), prefix))), "description": _some(F.col("description")), "publishedYear": _some(F.col("published_year")),
        "language": _some(F.lit(language)), "isbn": _some(F.col("isbn")), "asin": _some(F.col("asin")),
    }
    return F.struct(*[values.get(f, _null(f)).alias(f) for f in FIELDS])


def of_item() -> Column:
    """The sidecar of a library item row, as the library reports it."""
    values = {f: (_list(F.col(f)) if f in LISTS else F.col(f)) for f in ("subtitle", "authors", "narrators", "series", "genres", "tags", "description", "language", "isbn", "asin")}
    values |= {"title": _some(F.col("title")), "publishedYear": F.col("published_year")}
    return F.struct(*[values.get(f, _null(f)).alias(f) for f in FIELDS])


def previous(payload: Column) -> Column:
    """What was written last, from its JSON; null where that is missing or malformed."""
    return F.when(payload.isNotNull() & (F.try_parse_json(payload).isNotNull()), F.from_json(payload, SCHEMA))


def is_empty(name: str, value: Column) -> Column:
    return value.isNull() | ((F.size(value) == 0) if name in LISTS else (F.trim(value) == ""))


def same(name: str, a: Column, b: Column) -> Column:
    """Lists as multisets, texts trimmed; two missing values are the same."""
    equal = F.array_sort(a) == F.array_sort(b) if name in LISTS else F.trim(a) == F.trim(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(equal)


def reconcile(rows: DataFrame, policy: str, desired: str = "desired", current: str = "current", before: str = "previous") -> DataFrame:
    """Add payload, changed, changed_fields and skipped_fields to rows of three sidecars.

    A field without a wanted value keeps the library's. Otherwise overwrite-all writes it, fill-empty
    only into an empty one, overwrite-ours into an empty one or one that still has what was written
    last (or that was never written). The wanted tags are added whatever the policy says.
    """
    if policy not in POLICIES:
        raise ValueError(f"no such policy: {policy}")
    payload, changed, skipped = {}, [], []
    for f in FIELDS:
        want, have, ours = F.col(f"{desired}.{f}"), F.col(f"{current}.{f}"), F.col(f"{before}.{f}")
        gap = is_empty(f, want)
        write = {
            "overwrite-all": F.lit(True),
            "fill-empty": is_empty(f, have),
            "overwrite-ours": is_empty(f, have) | ours.isNull() | F.coalesce(same(f, have, ours), F.lit(False)),
        }[policy]
        value = F.when(gap, F.when(~is_empty(f, have), have)).when(write, want).otherwise(have)
        moved = ~gap & write & ~same(f, have, want)
        if f == "tags":
            base = F.coalesce(value, F.array().cast("array<string>"))
            union = F.array_union(base, want)
            marked = F.coalesce(F.size(want) > 0, F.lit(False))
            grown = marked & ~same(f, value, union)
            moved = moved | (grown & ~same(f, have, union))
            value = F.when(grown, union).otherwise(value)
        payload[f] = value
        changed.append(F.when(moved, F.lit(f)))
        skipped.append(F.when(~gap & ~write, F.lit(f)))
    out = rows.withColumn("payload", F.struct(*[payload[f].alias(f) for f in FIELDS]))
    # tags go last where only their marker moved, which the order of FIELDS can't tell: lists are sorted by field
    return out.withColumn("changed_fields", F.array_compact(F.array(*changed))).withColumn("skipped_fields", F.array_compact(F.array(*skipped))).withColumn("changed", F.size("changed_fields") > 0)


def digest(sidecar: Column) -> Column:
    """A hash that doesn't depend on the order of lists: md5 of the fields by name."""
    ordered = [F.when(sidecar[f].isNotNull(), F.array_sort(sidecar[f]) if f in LISTS else sidecar[f]).alias(f) for f in sorted(FIELDS)]
    return F.md5(F.to_json(F.struct(*ordered)).cast("binary"))


def serialised(sidecar: Column) -> Column:
    """Pretty JSON without missing fields, with a line break at the end."""
    return F.concat(F.to_json(sidecar, {"pretty": "true"}), F.lit("\n"))
