"""SimHash near-duplicates with a pigeonring filter.

Fingerprints: 64 bits, majority of the XXH64 (seed 42) of all word shingles, repeats included.
Fingerprints link at ``bits`` (3) or fewer differing bits.

Search: a fingerprint is cut into ``segments`` consecutive segments. Two that link share at least
``segments - bits`` whole segments, so every fingerprint is listed under the values of each choice
of that many segments (20 keys of about 32 bits for 6 segments; 35 of about 36 bits for 7, for
corpora past ten billion documents). Inside a key, pairs must pass the pigeonring filter: on the
ring of segments some start has a chain of 1, 2, ... segments whose differences add up to no more
than the proportional share of the budget each time (length * bits / segments). Only pairs that pass
get the full Hamming check. Both are exact: no linked pair fails the filter.

A key lists distinct fingerprints only, so copies of a text count once however many there are. What
leaves a key is a forest that connects the same fingerprints as all links do, never all pairs. Inside a task, a
key with more than ``block`` fingerprints is cut again by quarters of the bits that the key leaves
open (three differences leave one quarter equal), and so on down to four open bits, which sixteen fingerprints can differ in.
A key with more than SPLIT fingerprints isn't compared in its task: it streams them out, and they are listed anew under
the quarters of its open bits, dealt over all tasks. At 16 open bits a key has no more than 2^16 fingerprints. Nothing is capped.

Null text, empty text and text without a word have fingerprint zero and link as any other. Very long texts are hashed whole.
Ties: the smallest doc_id of a component names it. Repeated rows each get a row. Ids may be null or repeated: the graph's nodes are fingerprints.
A component of null ids only has a null component_id. Of the input only id and text are read by ``near_duplicates``; columns of any name pass
through ``keep_one``, but for those that begin with ``__sm_``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, add_columns, bytes_of, checkpoint, heavy_keys, salted_join
from .components import components

SHINGLE, SEED, BITS, SEGMENTS, BLOCK = 3, 42, 3, 6, 2048
#: Fingerprints of a key from which it is dealt over tasks, and open bits up to which it can't have more.
SPLIT, FEW_BITS = 1 << 16, 16
_HASH = xxhash.xxh64_intdigest
_U = np.uint64


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """Majority bits of the shingles' hashes; 0 where there is no word."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and split at ASCII white space only
    n = len(words)
    if not n:
        return 0
    if n <= width:
        hashed = [_HASH(b" ".join(words), SEED)]
    else:
        data = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: n - width].tolist()]
        hashed = [_HASH(data[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    return _majority(np.array(hashed, dtype=_U))


def _majority(hashed: np.ndarray) -> int:
    total = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashed), 1 << 14):
        total += np.unpackbits(hashed[a : a + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashed)).tobytes(), "big")


def with_fingerprint(df: DataFrame, text_col: str = "text", out: str = "fp", width: int = SHINGLE) -> DataFrame:
    """Append the fingerprint as a signed long."""

    def compute():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            values = np.array([fingerprint(t, width) for t in bytes_of(batch, text_col)], dtype=_U)
            return [pa.array(values.view(np.int64), pa.int64())]

        return work

    return add_columns(df, [T.StructField(out, T.LongType())], compute)


def layout(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment, the low bits first."""
    base, more = divmod(64, segments)
    out, at = [], 0
    for k in range(segments):
        width = base + (k < more)
        out.append((at, width))
        at += width
    return out


def pigeonring(x: np.ndarray, bits: int = BITS, segments: int = SEGMENTS) -> np.ndarray:
    """Whether differing bits ``x`` leave a viable chain around the ring of segments."""
    parts = [np.bitwise_count((x >> _U(at)) & _U((1 << width) - 1)).astype(np.int8) for at, width in layout(segments)]
    some = np.zeros(x.shape, dtype=bool)
    for start in range(segments):
        fits, total = np.ones(x.shape, dtype=bool), np.zeros(x.shape, dtype=np.int8)
        for length in range(1, segments + 1):
            total = total + parts[(start + length - 1) % segments]
            fits &= total <= length * bits // segments
            if not fits.any():
                break
        some |= fits
    return some


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return int(k)

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _compare(values: np.ndarray, where: np.ndarray, other: np.ndarray, forest: _Forest, bits: int, segments: int) -> Iterator[tuple[int, int]]:
    """Forest links between two lists of positions (the same list: each pair once)."""
    same = where is other
    for a in range(0, len(where), 256):
        left = where[a : a + 256]
        right = other[a:] if same else other
        x = values[left][:, None] ^ values[right][None, :]
        rough = np.bitwise_count(x >> _U(32)) <= bits  # half of the bits alone rule most pairs out
        i, j = np.nonzero(rough)
        if same:
            i, j = i[j > i], j[j > i]
        d = x[i, j]
        ok = pigeonring(d, bits, segments)
        i, j, d = i[ok], j[ok], d[ok]
        ok = np.bitwise_count(d) <= bits
        for p, q in zip(left[i[ok]].tolist(), right[j[ok]].tolist(), strict=True):
            if forest.join(p, q):
                yield p, q


def links(values: np.ndarray, open_bits: list[int], forest: _Forest, where: np.ndarray | None = None, bits: int = BITS, segments: int = SEGMENTS, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Forest links of distinct fingerprints that agree outside ``open_bits``."""
    where = np.arange(len(values)) if where is None else where
    varied = np.bitwise_or.reduce(values[where]) ^ np.bitwise_and.reduce(values[where])
    open_bits = [b for b in open_bits if int(varied) >> b & 1]
    if len(where) <= block or len(open_bits) <= bits + 1:
        yield from _compare(values, where, where, forest, bits, segments)
        return
    for k in range(bits + 1):
        part = open_bits[k :: bits + 1]
        mask = _U(sum(1 << b for b in part))
        masked = values[where] & mask
        order = np.argsort(masked, kind="stable")
        cuts = np.nonzero(np.diff(masked[order]))[0] + 1
        rest = [b for b in open_bits if b not in part]
        for group in np.split(where[order], cuts):
            if len(group) > 1:
                yield from links(values, rest, forest, group, bits, segments, block)


def _keys(fps: np.ndarray, segments: int, exact: int) -> list[np.ndarray]:
    """The values of each choice of ``exact`` segments."""
    parts = layout(segments)
    out = []
    for choice in combinations(range(segments), exact):
        key = np.zeros(len(fps), dtype=_U)
        for k in choice:
            at, width = parts[k]
            key = (key << _U(width)) | ((fps >> _U(at)) & _U((1 << width) - 1))
        out.append(key)
    return out


def open_bits(way: int, bits: int = BITS, segments: int = SEGMENTS) -> list[int]:
    """The bits that a key leaves open. Its way is the number of its choice of segments and, from digit 64 on, the parts (from 1) it was cut by."""
    parts = layout(segments)
    choice = [*combinations(range(segments), segments - bits)][way % 64]
    out = [b for k, (at, width) in enumerate(parts) if k not in choice for b in range(at, at + width)]
    way //= 64
    while way:
        way, cut = divmod(way, bits + 2)
        part = out[cut - 1 :: bits + 1]
        out = [b for b in out if b not in part]
    return out


def similar(fps: DataFrame, col: str = "fp", bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """Distinct fingerprints to links (u, v) with the components of all pairs within ``bits``."""
    split, few = SPLIT, FEW_BITS

    def rows(way: np.ndarray, key: np.ndarray, fp: np.ndarray, names: tuple[str, str, str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(way.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=list(names))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
            for number, key in enumerate(_keys(own, segments, segments - bits)):
                yield rows(np.full(len(own), number), key, own, ("way", "key", "fp"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            way, key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for w in np.unique(way).tolist():
                here, own = key[way == w].view(_U), fp[way == w].view(_U)
                left, place = open_bits(w, bits, segments), 1
                while w // 64 >= (bits + 2) ** (place - 1):
                    place += 1
                for part in range(1, bits + 2):
                    mask = _U(sum(1 << b for b in left[part - 1 :: bits + 1]))
                    # keys that meet by chance only cost comparisons
                    new = (here * _U(0x9E3779B97F4A7C15)) ^ ((own & mask) * _U(0xC2B2AE3D27D4EB4F)) ^ _U(part)
                    yield rows(np.full(len(own), w + 64 * part * (bits + 2) ** (place - 1)), new ^ (new >> _U(29)), own, ("way", "key", "fp"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opens: dict[int, list[int]] = {}
        pairs: tuple[list, list] = ([], [])  # links of the batch at hand
        group, held, size, streams = None, [], 0, False  # the key that may go on in the next batch

        def compare(way: int, own: np.ndarray) -> None:
            for p, q in links(own, opens[way], _Forest(len(own)), None, bits, segments):
                pairs[0].append(own[p])
                pairs[1].append(own[q])

        def streamed() -> Iterator[pa.RecordBatch]:
            for own in held:
                yield rows(np.full(len(own), group[0]), np.full(len(own), group[1]), own, ("way", "u", "v"))
            held.clear()

        def told() -> pa.RecordBatch:
            u, v = (np.array(x, dtype=_U) for x in pairs)
            pairs[0].clear(), pairs[1].clear()
            return rows(np.full(len(u), -1), u, v, ("way", "u", "v"))

        for batch in batches:  # sorted by way and key
            if not batch.num_rows:
                continue
            way, key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            fp = fp.view(_U)
            cuts = np.nonzero((np.diff(key) != 0) | (np.diff(way) != 0))[0] + 1
            begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            some = ends - begins > 1
            some[0] = some[-1] = True
            for a, b in zip(begins[some].tolist(), ends[some].tolist(), strict=True):
                own = int(way[a]), key[a]
                opens.setdefault(own[0], open_bits(own[0], bits, segments))
                if own != group:
                    if size > 1 and not streams:
                        compare(group[0], np.concatenate(held))
                    group, size, streams = own, 0, False
                    held.clear()
                held.append(fp[a:b])
                size += b - a
                if size > split and len(opens[own[0]]) > few:
                    streams = True
                    yield from streamed()
            yield told()
        if size > 1 and not streams:
            compare(group[0], np.concatenate(held))
        yield told()

    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed, found = fps.select(F.col(col).alias("fp")).mapInArrow(spread, "way int, key long, fp long"), None
    while True:
        step = checkpoint(listed.repartition(tasks, "way", "key").sortWithinPartitions("way", "key").mapInArrow(match, "way int, u long, v long"))
        pairs, large = step.filter("way < 0").select("u", "v"), step.filter("way >= 0")
        found = pairs if found is None else found.unionByName(pairs)
        if large.isEmpty():
            return found
        listed = large.mapInArrow(cut, "way int, key long, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """(id, __sm_hash, fp, component_id) of every row; __sm_hash is xxhash64 of the text."""
    rows = checkpoint(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn(f"{OWN}hash", F.xxhash64("text")), "text").drop("text"))
    counts = checkpoint(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")))
    most = counts.count()
    roots = checkpoint(components(similar(counts, "fp", bits, segments)), most)
    nodes = checkpoint(counts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root")), most)
    firsts = checkpoint(nodes.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("fps")), most)
    found = salted_join(nodes.select("fp", "root"), firsts.select("root", "component_id"), "root", heavy_keys(firsts, "root", "fps", most), F.col("fp"), "inner")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return salted_join(rows, found, "fp", heavy_keys(counts, "fp", "n", total), F.concat_ws(",", F.col("doc_id"), F.col(f"{OWN}hash")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: the one with the least id, then the least text hash."""
    from pyspark.sql import Window

    found = near_duplicates(docs, id_col, text_col)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(f"{OWN}hash").alias("hash"))).alias("best"))
    # one text key of id and hash, never null, so that the join has a plain key
    key, salt, salts, n = (OWN + x for x in ("key", "salt", "salts", "n"))
    joined = lambda of, digest: F.concat_ws("|", digest.cast("string"), F.coalesce(of.cast("string"), F.lit("~")))
    kept = best.select(joined(F.col("best.id"), F.col("best.hash")).alias(key))
    rows = docs.withColumn(key, joined(F.col(id_col), F.xxhash64(text_col)))
    one = lambda df, *by: df.withColumn(n, F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(1)))).filter(f"{n} = 1").drop(n)
    copies = found.groupBy(joined(F.col("doc_id"), F.col(f"{OWN}hash")).alias(key)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    heavy = checkpoint(heavy_keys(copies, key, "n", found.count()))
    if heavy.isEmpty():
        return one(rows.join(kept, key, "left_semi"), key).drop(key)
    # many rows of one id and text are dealt over salts; one row of each salt goes on to the choice of one
    small = F.broadcast(heavy)
    dealt = rows.withColumn(f"{OWN}row", F.monotonically_increasing_id()).join(small, F.col(key) == F.col(f"{OWN}heavy"), "left")
    dealt = dealt.withColumn(salt, F.coalesce(F.pmod(F.xxhash64(f"{OWN}row"), F.col(salts)).cast("int"), F.lit(0))).drop(f"{OWN}row", f"{OWN}heavy", salts)
    spread = kept.join(small, F.col(key) == F.col(f"{OWN}heavy"), "left").select(key, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1)).alias(salt))
    return one(one(dealt.join(spread, [key, salt], "left_semi"), key, salt), key).drop(key, salt)
