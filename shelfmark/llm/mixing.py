"""Mixing sources to target weights by systematic sampling.

Each document has expected copies (its source's target over its source's size). Within a source
the expected copies are prefix-summed over the documents in order of size class and hash (of id and text), one
random offset is added, and a document is emitted once for each integer boundary that its
interval crosses. In size order neighbours replace each other, so the words taken differ from the
target by little more than one document of each class.

Expected copies are whole multiples of 2^-32, so sums don't depend on the order in which tasks end
and reruns agree. A source's documents have the same expected copies, so its prefix sums are multiples of running numbers, which
``numbered`` deals out in buckets; it also splits null or repeated ids and repeated texts.

Null text and text without a word have size 0: they are sampled as others are and take no word. Whole texts are
counted, however long. A null source is a source of its own, last in order. Ties (rows alike in id and
text) and repeated rows are documents of their own, and which of them is taken can't be told apart. Columns of any name pass
through, but for those that begin with ``__sm_``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, bucketed, checkpoint, heavy_keys, numbered, salted_join, word_count

UNIT = 1 << 32
SEED = "mix-1"
WEIGHTS = (5, 2, 1)
MOST = 3


def _key(source: Column) -> Column:
    """A source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _class(size: Column) -> Column:
    """Ascending size classes, each about a tenth wide: bit length and the four leading bits."""
    bits = F.length(F.bin(size))
    top = F.expr(f"shiftright({OWN}size, greatest(length(bin({OWN}size)) - 4, 0))")
    return (bits * 16 + top).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Targets of (source, source_size) rows: shares by weight, each at most ``most`` times its size.

    Sources by code point, null last, weigh ``weights`` in turn. One row per source goes to one
    task: the sources of a mixture are its configuration, a few numbers each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    order = Window.orderBy("ratio", "rank")
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    return (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("w", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("cap").cast("double") * F.col("rest") <= F.col("w").cast("double") * (F.col("total") - F.col("before")))
        .withColumn("spent", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every))
        .withColumn("open", F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))).over(every))
        .select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w").cast("double") * (F.col("total") - F.col("spent")) / F.col("open")).alias("target"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_text: bool = True) -> DataFrame:
    """``docs`` (without the text if ``keep_text`` is false) with the columns __sm_size, __sm_source_size, __sm_target and __sm_copies (0 or more)."""
    text = F.col(text_col)
    rows = docs.withColumn(f"{OWN}size", word_count(text)).withColumn(f"{OWN}key", _key(F.col(source_col)))
    # rows alike in id and text are alike in all that counts here
    alike = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    rows = rows.withColumn(f"{OWN}order", _class(F.col(f"{OWN}size"))).withColumn(f"{OWN}hash", alike)
    groups = [f"{OWN}key", f"{OWN}order", f"{OWN}sub"]
    counts = checkpoint(bucketed(rows).groupBy(F.col(source_col).alias(f"{OWN}source"), *groups).agg(F.count(F.lit(1)).alias("n"), F.sum(f"{OWN}size").alias("size")))
    targets = source_targets(counts.groupBy(F.col(f"{OWN}source").alias("source")).agg(F.sum("size").alias("source_size")), weights, most)
    targets = targets.select(
        _key(F.col("source")).alias(f"{OWN}key"),
        F.col("source_size").alias(f"{OWN}source_size"),
        F.col("target").alias(f"{OWN}target"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long").alias(f"{OWN}units"),
        F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long").alias(f"{OWN}start"),
    )
    sources = counts.groupBy(f"{OWN}key").agg(F.sum("n").alias("n"))
    placed = numbered(rows if keep_text else rows.drop(text_col), [f"{OWN}key"], f"{OWN}number", counts=counts.select(*groups, "n"))
    placed = salted_join(placed, targets, f"{OWN}key", heavy_keys(sources, f"{OWN}key", "n", sources.agg(F.sum("n")).first()[0] or 0), F.col(f"{OWN}hash"), "inner")
    # all documents of a source have the same expected copies, so the prefix sum is a multiple of the number
    upto = lambda k: F.expr(f"cast((cast({OWN}units as decimal(19,0)) * ({OWN}number + {k}) + {OWN}start) div {UNIT} as long)")
    return placed.withColumn(f"{OWN}copies", F.least(F.lit(most).cast("long"), upto(1) - upto(0))).drop(f"{OWN}key", f"{OWN}order", f"{OWN}hash", f"{OWN}number", f"{OWN}units", f"{OWN}start")


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each copy that the mix takes."""
    return mixed.filter(F.col(f"{OWN}copies") > 0).select(*[F.col(f"`{c}`") for c in columns], F.explode(F.sequence(F.lit(1), F.col(f"{OWN}copies").cast("int"))).alias(f"{OWN}copy")).drop(f"{OWN}copy")
