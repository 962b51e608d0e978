"""The newest n rows for large n: a threshold found by counting, instead of a sort that ends in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A counting pass tells 2 ** BITS ranges of values apart (one more where they don't start at a border).
BITS = 12


def _as_long(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name))
    if isinstance(kind, T.TimestampNTZType):
        at = F.col(name)  # by its parts, as hours come twice in a session's time zone
        minutes = (F.unix_date(at.cast("date")).cast("long") * 24 + F.hour(at)) * 60 + F.minute(at)
        return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("long")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(name).cast("long")
    raise TypeError(f"{name} is neither a whole number nor a time")


def newest(df: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The n rows of ``df`` that come last by ``by`` (all, if there are fewer), nulls before everything.

    The first column's n-th greatest value is found by counts of ever smaller ranges of its values: each pass is one
    aggregate of at most 4097 groups, six of them at most, and reads only the range that holds the value. Rows above
    it are taken whole; rows at it are told apart by the next column in the same way. Where rows are equal in all of ``by``
    and not all of them fit, any of them are taken. The result is a filter of ``df`` that runs in parallel; only such equal
    rows go through a limit. ``df`` is read once a pass, so it should be a stored table.
    """
    n, keep, tie = max(n, 0), F.lit(False), F.lit(True)
    for name in by:
        key = _as_long(df, name)
        rows = df.filter(tie)
        low, high, there, count = rows.agg(F.min(key), F.max(key), F.count(key), F.count(F.lit(1))).first()
        if n >= count:
            return df.filter(keep | tie)
        if n >= there:
            keep, n, tie = keep | (tie & key.isNotNull()), n - there, tie & key.isNull()
            continue
        while n and low < high:
            shift = max(0, (high - low).bit_length() - BITS)
            part = F.shiftright(key, shift)
            counts = rows.filter(key.between(low, high)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
            above, where = 0, None
            for r in sorted(counts, key=lambda r: -r["part"]):
                if above + r["n"] > n:
                    where = r["part"]
                    break
                above += r["n"]
            first, last = (where << shift), (where << shift) + (1 << shift) - 1
            keep, n = keep | (tie & (key > min(last, high)) & (key <= high)), n - above
            low, high = max(low, first), min(high, last)
        keep, tie = F.coalesce(keep, F.lit(False)), tie & F.coalesce(key == low, F.lit(False))
        if not n:
            return df.filter(keep)
    chosen = df.filter(keep)
    return chosen.unionByName(df.filter(tie).limit(n)) if n else chosen
