"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, heavy_keys, salted_join


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One star step over ``total`` distinct edges (u > v).

    Large star: each node's larger neighbours move to its least neighbour (or itself).
    Small star: each node and its smaller neighbours move to the least of these. The edges of
    nodes with very many are dealt out over several tasks.
    """
    pairs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    degrees = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    least = degrees.select("u", F.least("u", "m").alias("m"))
    joined = salted_join(pairs, least, "u", heavy_keys(degrees, "u", "n", total), F.col("v"), "inner")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u long, v long) links to (node, root): a row per linked node, root the least of its component.

    Each round is written to the checkpoint folder. Rounds grow with the logarithm of the longest
    chain, and every edge table is at most as long as the first. No link reaches the driver, only
    a count and a sum of hashes that tell when nothing moves any more.
    """
    edges = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    mark = edges.agg(*state).first()
    while mark[0]:
        edges = checkpoint(_star(edges, True, 2 * mark[0]), 2 * mark[0])
        n = edges.count()
        edges = checkpoint(_star(edges, False, n), 2 * n)
        before, mark = mark, edges.agg(*state).first()
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
