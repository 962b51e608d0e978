"""Hard negatives by bit-sliced integer products.

Components are quantised to integers. Anchors are compared with all rows in a grid: rows are dealt by hash to cells of bounded size,
anchors to groups of bounded size, and each (group, cell) is one task's work of a cogroup. Inside, the rows' components lie as bit planes. The planes are
taken from the most significant on; after each, a pair's score lies between the partial product plus the least and the most that the remaining
bits can add (the sums of the anchor's negative and positive components, scaled). A pair goes once its interval can't qualify:
below the k-th best lower bound of its anchor, or outside every window of its positives. What is left after the last plane is exact.

Two passes: the first finds each anchor's positives (same label), the second the negatives in the windows of their scores. Each cell gives the
first few of an anchor, and a window over those finds the first few of all.

Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors of unlike length count as if zeros followed the shorter; empty ones
have score 0. Quantised components saturate at +-2**20, so that scores of up to 65,536 components fit. A null id is no anchor, and comes last among ties. Repeated rows count
as often as they stand: a copy of the anchor is another row. Rows of one id with unlike vectors or labels are rows of their own. An empty table gives an empty result; other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, written

#: Quantised components saturate here.
MOST = 1 << 20
#: Rows of a cell and anchors of a group at most, components of either at most, and the least number of cells.
CELL_ROWS, GROUP_ROWS, CELL_COMPONENTS, CELLS = 32_768, 4096, 1 << 22, 64
#: Pairs whose intervals are held at a time: anchors x rows.
SIDE_ANCHORS, SIDE_ROWS = 512, 512
#: From this share of pairs on down, pairs are followed one by one instead of as a matrix.
SPARSE = 1 / 32
LEAST, LAST = np.int64(-(1 << 62)), np.int64((1 << 63) - 1)


def quantised(df: DataFrame, id_col: str, label: Column, vec_col: str, scale: int) -> DataFrame:
    """(id, label, q, n): the rows that take part, equal ones as one with their number."""
    x = F.col(vec_col)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    q = F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * float(scale)).cast("double"), F.lit(float(MOST))), F.lit(float(-MOST))).cast("int"))
    rows = df.filter(x.isNotNull() & label.isNotNull()).filter(whole).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), q.alias("q"))
    return rows.groupBy("id", "label", "q").agg(F.count(F.lit(1)).alias("n"))


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """int64 [rows, width] of lists, zeros behind the shorter ones."""
    lists = lists.combine_chunks()
    sizes = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten(), dtype=np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


class Rows:
    """A cell's or a group's rows as arrays."""

    def __init__(self, table: pa.Table, width: int) -> None:
        self.q = _matrix(table["q"], width)
        self.row = np.asarray(table["row"])
        self.label = np.asarray(table["label"])
        self.n = np.asarray(table["n"])
        ids = table["id"].combine_chunks()
        self.unnamed = np.asarray(ids.is_null())
        self.id = np.asarray(ids.fill_null(0))

    def __len__(self) -> int:
        return len(self.row)


class Planes:
    """Bit planes of a block's components, offset so that none is negative, the most significant first."""

    def __init__(self, q: np.ndarray, dtype: type) -> None:
        self.bits = max(1, int(max(-int(q.min()), int(q.max()) + 1) - 1).bit_length() + 1) if q.size else 1
        self.offset = 1 << (self.bits - 1)
        self.u = (q + self.offset).astype(np.int32)
        self.dtype = dtype

    def plane(self, p: int, rows: np.ndarray | None = None) -> np.ndarray:
        return ((self.u if rows is None else self.u[rows]) >> p & 1).astype(self.dtype)


def _kth(values: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest valid value of each row, LEAST where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), LEAST)
    at = values.shape[1] - k
    return np.partition(np.where(valid, values, LEAST), at, axis=1)[:, at]


def _kth_of_pairs(owner: np.ndarray, values: np.ndarray, owners: int, k: int) -> np.ndarray:
    """The same where the values lie as pairs (owner, value)."""
    out = np.full(owners, LEAST)
    order = np.lexsort((-values, owner))
    owner, values = owner[order], values[order]
    first = np.searchsorted(owner, np.arange(owners))
    place = first + k - 1
    there = place < np.append(first[1:], len(owner))
    out[there] = values[place[there]]
    return out


class Windows:
    """Score ranges [lo, hi] of each anchor (one or several), of which the first ``k`` scores each are wanted; floors are the k-th best found so far."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, k: int) -> None:
        self.lo, self.hi, self.k = lo, hi, k
        self.floor = np.where(lo <= hi, lo, LAST)
        self.known = np.full(len(lo), False)

    def dense(self, low: np.ndarray, high: np.ndarray, valid: np.ndarray) -> np.ndarray:
        floor = self.floor
        if not self.known.all():
            floor = floor.copy()
            for j in range(floor.shape[1]):
                sure = valid & (low >= self.lo[:, j : j + 1]) & (high <= self.hi[:, j : j + 1])
                floor[:, j] = np.maximum(floor[:, j], _kth(low, sure, self.k))
        keep = np.zeros_like(valid)
        for j in range(floor.shape[1]):
            keep |= (high >= floor[:, j : j + 1]) & (low <= self.hi[:, j : j + 1])
        return keep

    def sparse(self, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(a), bool)
        for j in range(self.lo.shape[1]):
            sure = (low >= self.lo[a, j]) & (high <= self.hi[a, j])
            floor = np.maximum(self.floor[:, j], _kth_of_pairs(a[sure], low[sure], len(self.lo), self.k))
            keep |= (high >= floor[a]) & (low <= self.hi[a, j])
        return keep


def survivors(q: np.ndarray, planes: Planes, valid: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) that no interval ruled out, with their exact scores."""
    a = q.astype(planes.dtype)
    most, least = np.maximum(q, 0).sum(1), np.minimum(q, 0).sum(1)
    partial = np.broadcast_to((-planes.offset * q.sum(1))[:, None], valid.shape).copy()
    p = planes.bits
    while p and valid.sum() > SPARSE * valid.size:
        p -= 1
        partial += (a @ planes.plane(p).T).astype(np.int64) << p
        rest = (1 << p) - 1
        # Intervals wider than the scores' own spread can't rule out anything.
        if rest * int((most - least).min(initial=0)) <= int(np.ptp(partial)):
            valid &= windows.dense(partial + rest * least[:, None], partial + rest * most[:, None], valid)
    i, c = np.nonzero(valid)
    score = partial[i, c]
    while p and len(i):
        p -= 1
        rest = (1 << p) - 1
        bits = planes.plane(p)
        score = score + (np.einsum("pd,pd->p", a[i], bits[c]).astype(np.int64) << p)
        keep = windows.sparse(i, score + rest * least[i], score + rest * most[i])
        i, c, score = i[keep], c[keep], score[keep]
    return i, c, score


class Best:
    """The first ``k`` rows of each anchor and window so far: higher scores first, then lower ids, rows without an id last."""

    def __init__(self, windows: Windows) -> None:
        self.windows, self.found = windows, None

    def add(self, owner: np.ndarray, rows: Rows, c: np.ndarray, score: np.ndarray) -> None:
        w = self.windows
        width = w.lo.shape[1]
        parts = []
        for j in range(width):
            fit = (score >= w.lo[owner, j]) & (score <= w.hi[owner, j])
            parts.append((owner[fit] * width + j, score[fit], rows.unnamed[c[fit]], rows.id[c[fit]], rows.n[c[fit]]))
        if self.found is not None:
            parts.append(self.found)
        key, score, unnamed, ids, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, unnamed, -score, key))
        key = key[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        order = order[place < w.k]
        key, place = key[place < w.k], place[place < w.k]
        self.found = (key, score[order], unnamed[order], ids[order], n[order])
        full = place == w.k - 1
        at = key[full]
        w.floor[at // width, at % width] = np.maximum(w.floor[at // width, at % width], self.found[1][full])
        w.known = (w.floor > np.where(w.lo <= w.hi, w.lo, LEAST)).all(1)


def _searched(anchors: Rows, rows: Rows, windows: Windows, same: bool) -> Best:
    """All pairs of a group and a cell, a matrix of bounded size at a time; ``same``: of one label, otherwise of two."""
    best = Best(windows)
    dtype = np.float32 if int(np.abs(anchors.q).sum(1).max(initial=0)) < 1 << 24 else np.float64
    if same:
        # Only rows of the anchors' own labels are looked at.
        labels = np.unique(anchors.label)
        parts = [(np.nonzero(anchors.label == x)[0], np.nonzero(rows.label == x)[0]) for x in labels]
    else:
        parts = [(np.arange(len(anchors)), np.arange(len(rows)))]
    for mine, theirs in parts:
        for b in range(0, len(theirs), SIDE_ROWS):
            c = theirs[b : b + SIDE_ROWS]
            planes = Planes(rows.q[c], dtype)
            for s in range(0, len(mine), SIDE_ANCHORS):
                i = mine[s : s + SIDE_ANCHORS]
                if same:
                    valid = (anchors.row[i][:, None] != rows.row[c][None, :]) | (rows.n[c] > 1)[None, :]
                else:
                    valid = anchors.label[i][:, None] != rows.label[c][None, :]
                view = Windows(windows.lo[i], windows.hi[i], windows.k)
                view.floor, view.known = windows.floor[i], windows.known[i]
                x, y, score = survivors(anchors.q[i], planes, valid, view)
                best.add(i[x], rows, c[y], score)
    return best


def _told(anchors: Rows, best: Best, wanted: np.ndarray | None) -> dict[str, pa.Array]:
    width = best.windows.lo.shape[1]
    key, score, unnamed, ids, n = best.found if best.found is not None else (np.zeros(0, np.int64),) * 5
    a = key // width
    out = {"row": pa.array(anchors.row[a], pa.int64()), "id": pa.array(ids, pa.int64(), mask=unnamed.astype(bool)), "score": pa.array(score, pa.int64()), "n": pa.array(n, pa.int64())}
    return out if wanted is None else {"wanted": pa.array(wanted[a, key % width], pa.int64())} | out


def mine(df: DataFrame, anchor: Column, id_col: str, label: Column, vec_col: str, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """For each anchor and each of its first ``positives``, the first ``negatives`` of another label between ``low`` and ``high`` percent of the positive's score.

    ``anchor`` is a condition on the column ``id``. (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)
    """
    rows = written(quantised(df, id_col, label, vec_col, scale).withColumn("row", F.monotonically_increasing_id()))
    n_rows, width = rows.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    width = max(1, width or 0)
    asked = F.coalesce(anchor, F.lit(False))
    n_anchors = rows.filter(asked).count()
    cells = max(CELLS, -(-n_rows // max(1, min(CELL_ROWS, CELL_COMPONENTS // width))))
    groups = max(1, -(-n_anchors // max(1, min(GROUP_ROWS, CELL_COMPONENTS // width))))
    dealt = F.pmod(F.xxhash64("id", "label", "row"), F.lit(cells)).cast("int")
    sides = rows.select("row", "id", "label", "q", "n", dealt.alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    own = checkpoint(rows.filter(asked).select("row", "id", "label", "q", "n", F.pmod(F.xxhash64("id", "row"), F.lit(groups)).cast("int").alias("group")), n_anchors)
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell")

    def nearest(key, left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, those = Rows(left, width), Rows(right, width)
        any_score = np.full((len(anchors), 1), LEAST), np.full((len(anchors), 1), LAST - 1)
        return pa.table(_told(anchors, _searched(anchors, those, Windows(*any_score, positives), True), None))

    found = own.select("*", everywhere).groupBy("group", "cell").cogroup(sides.groupBy("group", "cell")).applyInArrow(nearest, "row long, id long, score long, n long")
    place = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(positives)).cast("int")))).withColumn("place", F.row_number().over(place)).filter(F.col("place") <= positives)
    found = checkpoint(found.select("row", "id", "score"), n_anchors * positives)
    scores = found.groupBy("row").agg(F.array_sort(F.collect_set("score")).alias("wanted"))

    def between(key, left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, those = Rows(left, width), Rows(right, width)
        lists = left["wanted"].combine_chunks()
        sizes = np.asarray(lists.value_lengths())
        wanted = np.zeros((len(sizes), positives), np.int64)
        there = np.arange(positives)[None, :] < sizes[:, None]
        wanted[there] = np.asarray(lists.flatten())
        lo, hi = -(-(low * wanted) // 100), high * wanted // 100
        lo, hi = np.where(there, lo, 1), np.where(there, hi, 0)
        return pa.table(_told(anchors, _searched(anchors, those, Windows(lo, hi, negatives), False), wanted))

    asking = own.join(scores, "row").select("*", everywhere)
    hard = asking.groupBy("group", "cell").cogroup(sides.groupBy("group", "cell")).applyInArrow(between, "wanted long, row long, id long, score long, n long")
    place = Window.partitionBy("row", "wanted").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    hard = hard.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(negatives)).cast("int")))).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= negatives)
    hard = hard.select("row", F.col("wanted").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = found.select("row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = own.select("row", F.col("id").alias("anchor_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return names.join(pairs, "row").join(hard, ["row", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
