"""Merkle manifest of a table: a tree over the rows of each source, a tree over the sources, and a proof for every row.

Leaves get their index in order of (source, id) from a range-partitioned sort, so no task numbers a whole source. The
tree is built SPAN levels at a time: the blocks of FANOUT ** SPAN consecutive nodes are one shuffle, and the nodes above them
are made inside a block. All nodes lie in the materialised node tables of the tiers.

A proof is made by coordinate lookup: from its index and the group's size a leaf explodes the coordinates (level, index) of the
siblings that it needs inside its block, joins the node table, orders and concatenates. The block's own top node is a leaf of the tier above, and its
siblings are looked up once for the whole block; so a node is asked for by a block's leaves at most, however many leaves a source
has, and nothing near the root becomes a hot key. ``fold`` goes from a leaf along its proof to the root.

Nulls in any column have an encoding of their own ("-"); a null source is a source that comes first, null ids come first in their source and count as the empty text for the choice
of tampered rows. Empty texts and very long ones are hashed whole. Equal ids are ordered by leaf, so repeated rows are leaves beside
each other; which of them gets which place doesn't show. An empty table gives an empty result. Further columns, whatever their names, aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, crc_of_id, forget, written

#: Nodes of a run, and levels that are built and proved at a time.
FANOUT, SPAN = 3, 3
BLOCK = FANOUT**SPAN
#: Bits of a running number inside a partition, in Spark's monotonically_increasing_id.
PLACE_BITS = 33
STEPS = "array<struct<left: string, right: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """A value that no other value or sequence of values can be mistaken for."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(F.concat(*map(encoded, values)))


def _up(n: Column, levels: int = 1) -> Column:
    """How many nodes stand so many levels above ``n`` nodes."""
    return F.floor((n + F.lit(FANOUT**levels - 1)) / F.lit(FANOUT**levels)).cast("long")


def _down(n: Column, by: int) -> Column:
    return F.floor(n / F.lit(by)).cast("long")


def in_order(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with tree (the group's number, from 0), idx (from 0, in ``order``) and size, and the groups (tree, size).

    ``group`` is a text without null. Rows are sorted over ranges; a range's place among its group's rows is a sum over one row a range and group.
    """
    keys = [group, *order]
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", PLACE_BITS)))
    spans = checkpoint(placed.groupBy("part", group).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("start")))
    sizes = spans.groupBy(group).agg(F.sum("n").alias("size"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("start"))
    # The groups' numbers come the same way, from ranges of the groups.
    ranked = checkpoint(sizes.repartitionByRange(group).sortWithinPartitions(group).withColumn("place", F.monotonically_increasing_id()).withColumn("range", F.shiftright("place", PLACE_BITS)))
    ranges = ranked.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("start"))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", (F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("start")).alias("move"))
    groups = checkpoint(ranked.join(ranges, "range").select(group, (F.col("place") + F.col("move")).alias("tree"), "size"))
    numbers = spans.join(groups, group).select("part", group, "shift", "tree", "size")
    out = written(placed.join(numbers, ["part", group]).withColumn("idx", F.col("place") + F.col("shift")).drop("part", "place", "shift", group))
    forget(placed)
    return out, groups.select("tree", "size")


@dataclass
class Tree:
    """The tiers of one or many trees: per tier a table (tree, block, size, nodes), where nodes[l] are the block's nodes l levels up."""

    tiers: list[DataFrame]
    tops: DataFrame


def _runs(nodes: Column) -> Column:
    """The level above ``nodes``: the digest of every FANOUT consecutive ones."""
    return F.transform(F.sequence(F.lit(0), _up(F.size(nodes).cast("long")).cast("int") - 1), lambda i: digest(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), "")))


def build(leaves: DataFrame) -> Tree:
    """Trees over ``leaves`` (tree, idx, size, hash); ``tops`` has (tree, size, hash), size being the number of leaves."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    base, tiers, tops, scale = leaves.select("tree", "idx", "size", "hash"), [], [], 1
    while True:
        rows = base.groupBy("tree", _down(F.col("idx"), BLOCK).alias("block")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("found"))
        levels = [F.transform("found", lambda x: x["hash"])]
        for k in range(SPAN):
            rows = rows.withColumn(f"l{k}", levels[-1])
            levels.append(F.when(_up(F.col("size"), k) > 1, _runs(F.col(f"l{k}"))))
        rows = rows.withColumn(f"l{SPAN}", levels[-1])
        tier = rows.select("tree", "block", "size", F.array(*[f"l{k}" for k in range(SPAN + 1)]).alias("nodes"))
        tier = written(tier) if not tiers else checkpoint(tier)
        tiers.append(tier)
        ended = tier.filter(F.col("size") <= BLOCK)
        tops.append(ended.select("tree", F.element_at(F.element_at(F.filter("nodes", lambda x: x.isNotNull()), -1), 1).alias("hash")))
        scale *= BLOCK
        if most <= scale:
            break
        base = tier.filter(F.col("size") > BLOCK).select("tree", F.col("block").alias("idx"), _up(F.col("size"), SPAN).alias("size"), F.element_at(F.element_at("nodes", SPAN + 1), 1).alias("hash"))
    whole = tops[0]
    for t in tops[1:]:
        whole = whole.unionByName(t)
    return Tree(tiers, whole)


def _node_table(tier: DataFrame) -> DataFrame:
    """(tree, level, at, hash): a row for each node of a tier's levels but the last, which is the next tier's first."""
    level = tier.select("tree", "block", F.posexplode(F.slice("nodes", 1, SPAN)).alias("level", "row")).filter(F.col("row").isNotNull())
    wide = F.element_at(F.array(*[F.lit(BLOCK // FANOUT**k).cast("long") for k in range(SPAN)]), F.col("level") + 1)
    return level.select("tree", "level", F.posexplode("row").alias("pos", "hash"), (F.col("block") * wide).alias("first")).select("tree", "level", (F.col("first") + F.col("pos")).alias("at"), "hash")


def coordinates(idx: Column, size: Column) -> Column:
    """Level and index of the siblings inside a block: those of the run of the node's ancestor on each level, without the ancestor."""
    return F.concat(*[_siblings(k, _down(idx, FANOUT**k), _up(size, k)) for k in range(SPAN)])


def _siblings(level: int, own: Column, there: Column) -> Column:
    run = F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda d: _down(own, FANOUT) * FANOUT + d)
    return F.transform(F.filter(run, lambda at: (at != own) & (at < there)), lambda at: F.struct(F.lit(level).alias("level"), at.cast("long").alias("at")))


def _step(found: Column, level: int, own: Column) -> Column:
    """What stands left and right of the node ``own`` in its run, of the looked-up siblings in order."""
    mine = F.filter(found, lambda x: x["level"] == level)
    left, right = F.filter(mine, lambda x: x["at"] < own), F.filter(mine, lambda x: x["at"] > own)
    return F.struct(*[F.array_join(F.transform(side, lambda x: x["hash"]), "").alias(name) for name, side in (("left", left), ("right", right))])


def prove(tree: Tree, leaves: DataFrame, ends: DataFrame, carried: list[str]) -> DataFrame:
    """(tree, idx, steps, carried): the whole proof of each of ``leaves`` (tree, idx, size).

    ``ends`` has, by tree, its size, the steps that follow above its top, and the carried columns. A step has the
    siblings to the left and to the right of a level, concatenated; a level without siblings has a step of two empty texts.
    """
    above = None
    for t in reversed(range(len(tree.tiers))):
        tier, scale = tree.tiers[t], BLOCK**t
        own = leaves.select("tree", "idx", "size") if t == 0 else tree.tiers[t].select("tree", F.posexplode(F.element_at("nodes", 1)).alias("pos", "hash"), "block", "size").select("tree", (F.col("block") * BLOCK + F.col("pos")).alias("idx"), "size")
        asked = own.select("tree", "idx", "size", F.explode_outer(coordinates(F.col("idx"), F.col("size"))).alias("x")).select("tree", "idx", "size", F.col("x.level").alias("level"), F.col("x.at").alias("at"))
        found = asked.join(_node_table(tier), ["tree", "level", "at"], "left")
        found = found.groupBy("tree", "idx").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.when(F.col("hash").isNotNull(), F.struct("level", "at", "hash")))).alias("found"))
        steps = [F.when(_up(F.col("size"), k) > 1, _step(F.col("found"), k, _down(F.col("idx"), FANOUT**k))) for k in range(SPAN)]
        low = found.select("tree", "idx", _down(F.col("idx"), BLOCK).alias("block"), F.filter(F.array(*steps), lambda x: x.isNotNull()).alias("low"))
        here = _up(F.col("size"), SPAN * t)
        last = ends.filter((here <= BLOCK) & ((here > 1) | F.lit(t == 0))).select("tree", F.lit(0).cast("long").alias("block"), "steps", *carried)
        upper = last if above is None else last.unionByName(above.withColumnRenamed("idx", "block"))
        above = low.join(upper, ["tree", "block"]).select("tree", "idx", F.concat("low", "steps").alias("steps"), *carried)
        if t:
            above = checkpoint(above)
    return above


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(steps, leaf, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def proof_digest(steps: Column) -> Column:
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(leaves: DataFrame, source_col: str, id_col: str, leaf_col: str, further: list[str]) -> tuple[DataFrame, str | None]:
    """A row for each of ``leaves``: its id, leaf and further columns, subroot and steps; and the root (None for no rows)."""
    rows = leaves.select(F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("-")).alias("__sm_source"), F.col(id_col).alias("__sm_id"), F.col(leaf_col).alias("hash"), *further)
    rows, groups = in_order(rows, "__sm_source", ["__sm_id", "hash"])
    many = groups.count()
    lower = build(rows)
    subroots = checkpoint(lower.tops.join(groups, "tree").select("tree", "size", "hash"))
    nodes = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(many).cast("long").alias("size"), "hash")
    upper = build(nodes)
    root = upper.tops.first()
    end = nodes.sparkSession.createDataFrame([(0, many, [])], f"tree long, size long, steps {STEPS}")
    top = prove(upper, nodes, end, []).select(F.col("idx").alias("tree"), "steps")
    ends = checkpoint(subroots.join(top, "tree").select("tree", "size", "steps", F.col("hash").alias("subroot")))
    proofs = prove(lower, rows, ends, ["subroot"])
    return rows.join(proofs, ["tree", "idx"]).select(F.col("__sm_id").alias(id_col), F.col("hash").alias(leaf_col), *further, "subroot", "steps"), root["hash"] if root else None


def of_documents(docs: DataFrame) -> DataFrame:
    """Every document's leaf, proof and root, and what the proof says once some texts lost their line ends.

    Rows whose id has an even CRC-32 are tampered with: their texts lose every line feed.
    """
    shown = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = (crc_of_id(F.col("doc_id")) % 2 == 0) & F.col("text").contains("\n")
    thin = docs.select("doc_id", "source", leaf_of(*shown, F.col("text")).alias("leaf"), F.when(changed, leaf_of(*shown, F.translate("text", "\n", ""))).alias("tampered"))
    rows, root = manifest(thin, "source", "doc_id", "leaf", ["tampered"])
    folded = fold(F.coalesce("tampered", "leaf"), F.col("steps"))
    told = rows.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"), F.size("steps").cast("long").alias("n_levels"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
