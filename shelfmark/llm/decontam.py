"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Index: the test items' terms with their BM25 impacts, each divided by the item's own score (its
whole text as the query), so one threshold fits items of any length. A term's postings stand in order of item,
in blocks of ``POSTINGS`` with their largest impact. Document frequencies and mean length are those of all
items, also where the items are dealt over several indexes, so results don't depend on the deal.

Queries: every passage of every document. Items are classed by length (up to 16, 64, 256, ... words); for
each class the passages are windows of twice its longest length at steps of it, so any item that a document
holds lies whole in some passage, and a long item doesn't make the passages of short ones long.

Opening, for the passages of many documents together in numpy: an item's pivot terms are all but its
lightest, whose impacts add up to less than half of the threshold. A passage goes on if, for some item, the
pivot terms that it has weigh what the lightest terms leave open. This is exact, and drops nearly all passages.

Search, for each passage that goes on: block-max WAND. A cursor for each of the passage's terms, sorted by
item; the pivot is the first item at which the upper bounds of the lists up to it reach the threshold; the
maxima of the blocks that hold the pivot decide whether it is scored or the cursors leap past the nearest end of
these blocks. Every item whose score reaches the threshold comes out.

Verification: an item found is split into a question (all sentences but the last) and an answer
(the last sentence, or the last quarter of a single one). The document is contaminated by it if it
holds at least ``overlap`` of the item's five-word shingles and either at least ``OVERLAP`` (0.8) of them,
which no edit of a short answer undoes, or at least half of the question's and half of the answer's. So the
parts only decide below 0.8. Parts of fewer than five words take shingles of their length.

The index is broadcast. Its size is checked: items are dealt over as many indexes as needed for
``INDEX_BYTES`` bytes of text each (about ten times that in memory), and the documents are read once per index.

Null or empty text holds nothing. Items without a word are never found. Whole texts are searched, however
long. Ties: every item that reaches the threshold is found. Repeated rows each get
their own. Columns of any name pass through ``clean``, but for those that begin with ``__sm_``. Empty tables
give no pairs.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, add_columns, checkpoint, texts_of

K1, B = 1.2, 0.75
RETRIEVE, OVERLAP, PART = 0.5, 0.8, 0.5
SHINGLE, POSTINGS = 5, 64
#: Longest item of the first length class, and how much longer that of each next one is.
FIRST_CLASS, WIDER = 16, 4
#: Sums of floats in another order may differ by this.
SLACK = 1e-9
INDEX_BYTES = 8 << 20
#: Words that are searched together.
TOGETHER = 1 << 17
#: Postings of these words that are held in arrays at a time (a passage's own more, if it is the last one).
POSTINGS_TOGETHER = 1 << 20
_WORDS = re.compile(r"\w+").findall
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def tokens(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def question_length(text: str | None) -> int:
    """How many of an item's words are its question; the rest are its answer."""
    sizes = [n for n in (len(tokens(x)) for x in _SENTENCE.split(text or "")) if n]
    if len(sizes) > 1:
        return sum(sizes[:-1])
    return sizes[0] - max(1, sizes[0] // 4) if sizes and sizes[0] > 1 else 0


def length_class(words: int) -> int:
    """The longest length of the class of items with so many words."""
    longest = FIRST_CLASS
    while longest < words:
        longest *= WIDER
    return longest


def shingles(words: np.ndarray, size: int) -> set[bytes]:
    """The shingles of term numbers, as bytes."""
    data, width = words.tobytes(), words.itemsize
    return {data[k * width : (k + size) * width] for k in range(len(words) - size + 1)}


class _Class:
    """Items of one length class: a range of item numbers, the passages' step, and the pivot postings."""

    def __init__(self, low: int, high: int, stride: int):
        self.low, self.high, self.stride = low, high, stride


class Index:
    """Postings with block maxima of the items that have a word.

    ``statistics`` (items, mean length, document frequencies by term) are those of the items given, unless
    they are part of more.
    """

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = RETRIEVE, statistics: tuple[int, float, dict[str, int]] | None = None):
        split = [(i, t, tokens(t)) for i, t in items]
        split = sorted(((i, t, w) for i, t, w in split if w), key=lambda x: (len(x[2]), x[0] is None, x[0] or 0, x[1]))
        self.threshold = threshold
        self.ids = [i for i, _, _ in split]
        self.cut = [question_length(t) for _, t, _ in split]
        lengths = np.array([len(w) for _, _, w in split], dtype=np.int64)
        self.ends = np.cumsum(lengths)
        self.terms: dict[str, int] = {}
        self.words = np.array([self.terms.setdefault(w, len(self.terms)) for _, _, ws in split for w in ws], dtype=np.int32)
        n = len(split)
        pairs, tf = np.unique(self.words.astype(np.int64) * max(n, 1) + np.repeat(np.arange(n), lengths), return_counts=True)
        term, self.item = pairs // max(n, 1), (pairs % max(n, 1)).astype(np.int32)
        frequency = np.bincount(term, minlength=len(self.terms))
        self.begin = np.concatenate([[0], np.cumsum(frequency)])
        total, mean = n, float(lengths.mean()) if n else 1.0
        if statistics is not None:
            total, mean = statistics[:2]
            frequency = np.array([statistics[2][w] for w in self.terms], dtype=np.int64)
        idf = np.log(1 + (total - frequency + 0.5) / (frequency + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.item] / mean))
        own = np.argsort(self.item, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.item, minlength=n))]).astype(np.int64) if n else np.zeros(1, dtype=np.int64)
        whole = np.array([fsum(impact[own[starts[k] : starts[k + 1]]].tolist()) for k in range(n)])
        self.impact = impact / whole[self.item] if n else impact
        # blocks of postings, list by list
        lists = np.diff(self.begin)
        self.block_begin = np.concatenate([[0], np.cumsum(-(-lists // POSTINGS))]).astype(np.int64)
        first = np.repeat(self.begin[:-1], np.diff(self.block_begin)) + POSTINGS * (np.arange(int(self.block_begin[-1])) - np.repeat(self.block_begin[:-1], np.diff(self.block_begin)))
        self.block_max = np.maximum.reduceat(self.impact, first) if n else np.zeros(0)
        self.block_last = self.item[np.concatenate([first[1:], [len(self.item)]]).astype(np.int64) - 1] if n else np.zeros(0, dtype=np.int32)
        self.top = np.maximum.reduceat(self.impact, self.begin[:-1]) if n else np.zeros(0)
        self.skipped = 0
        # pivot terms: the heaviest ones of each item, in sum at least what is left beside half of the threshold
        light = np.lexsort((term, self.impact, self.item))
        run = np.cumsum(self.impact[light])
        item = self.item[light]
        run -= np.concatenate([[0.0], run])[np.searchsorted(item, item, "left")] if n else 0
        pivot = run >= threshold / 2
        spent = np.bincount(item[~pivot], weights=self.impact[light][~pivot], minlength=n) if n else np.zeros(0)
        self.need = threshold - spent - SLACK
        chosen = light[pivot]
        chosen = chosen[np.lexsort((self.item[chosen], term[chosen]))]
        self.classes: list[_Class] = []
        bounds = [length_class(int(k)) for k in lengths]
        for stride in sorted(set(bounds)):
            c = _Class(bounds.index(stride), n - bounds[::-1].index(stride), stride)
            here = chosen[(self.item[chosen] >= c.low) & (self.item[chosen] < c.high)]
            c.item, c.weight = self.item[here].astype(np.int64), self.impact[here]
            # one more, without a posting: a word that no item has
            c.begin = np.concatenate([[0], np.cumsum(np.bincount(term[here], minlength=len(self.terms) + 1))]).astype(np.int64)
            self.classes.append(c)

    def numbers(self, words: list[str]) -> np.ndarray:
        get, none = self.terms.get, len(self.terms)
        return np.array([get(w, none) for w in words], dtype=np.int32)

    def opened(self, docs: list[np.ndarray], c: _Class) -> list[tuple[int, int]]:
        """(document, place of its first word) of the passages that some item of the class may reach the threshold for."""
        n, none, stride = len(self.ids), len(self.terms), c.stride
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        term = np.concatenate(docs).astype(np.int64)
        doc = np.repeat(np.arange(len(docs)), lengths)
        place = (np.arange(len(term)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // stride
        last = np.maximum(0, -(-(lengths - stride) // stride) - 1)
        first = np.cumsum(last + 1) - (last + 1)  # number of a document's first passage
        some = c.begin[term + 1] > c.begin[term]
        term, doc, place = term[some], doc[some], place[some]
        late = first[doc] + np.minimum(place, last[doc])
        early = first[doc] + np.minimum(np.maximum(place - 1, 0), last[doc])
        keys = np.unique(np.concatenate([late, early]) * none + np.concatenate([term, term]))
        passage, term = keys // none, keys % none
        many = c.begin[term + 1] - c.begin[term]
        # so many passages at a time that their postings are about POSTINGS_TOGETHER
        begins = np.flatnonzero(np.diff(passage, prepend=-1))
        before = (np.cumsum(many) - many)[begins]
        edges = [*begins[np.flatnonzero(np.diff(before // POSTINGS_TOGETHER, prepend=-1))].tolist(), len(passage)]
        some = [np.zeros(0, dtype=np.int64)]
        for a, b in pairwise(edges):
            own, lists = many[a:b], c.begin[term[a:b]]
            at = np.repeat(lists - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            pairs, where = np.unique(np.repeat(passage[a:b], own) * n + c.item[at], return_inverse=True)
            reached = np.bincount(where, weights=c.weight[at], minlength=len(pairs)) >= self.need[pairs % n]
            some.append(np.unique(pairs[reached] // n))
        passages = np.concatenate(some)
        doc = np.searchsorted(first, passages, "right") - 1
        return list(zip(doc.tolist(), ((passages - first[doc]) * stride).tolist(), strict=True))

    def wand(self, terms: list[int], low: int, high: int) -> list[tuple[int, float]]:
        """The items from ``low`` on and below ``high`` that distinct terms reach the threshold for, with their scores."""
        item, impact, top, last, peak = self.item, self.impact, self.top, self.block_last, self.block_max
        least, out = self.threshold - SLACK, []
        ends = {t: int(self.begin[t + 1]) for t in terms}
        cursors: list[tuple[int, int, int]] = []  # item, posting, term

        def move(t: int, at: int, to: int) -> None:
            """Put a term's cursor on its first posting from an item on, or drop it."""
            at = bisect_left(item, to, at, ends[t])
            if at < ends[t] and item[at] < high:
                cursors.append((int(item[at]), at, t))

        for t in terms:
            move(t, int(self.begin[t]), low)
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += top[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            here = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == here:
                pivot += 1
            bound, leap = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else high
            for _, _, t in cursors[: pivot + 1]:
                block = bisect_left(last, here, int(self.block_begin[t]), int(self.block_begin[t + 1]))
                if block < self.block_begin[t + 1]:
                    bound += peak[block]
                    leap = min(leap, int(last[block]) + 1)
            if bound < least:
                self.skipped += 1
                to = leap
            elif cursors[0][0] == here:
                score = fsum(float(impact[at]) for _, at, _ in cursors[: pivot + 1])
                if score >= least:
                    out.append((here, score))
                to = here + 1
            else:
                to = here
            moved, cursors = cursors[: pivot + 1], cursors[pivot + 1 :]
            for _, at, t in moved:
                move(t, at, to)
        return out

    def candidates(self, docs: list[np.ndarray]) -> list[dict[int, float]]:
        """For each document's term numbers: the items that some passage reaches the threshold for, and the best score."""
        out: list[dict[int, float]] = [{} for _ in docs]
        for c in self.classes if docs else []:
            for d, k in self.opened(docs, c):
                terms = np.unique(docs[d][k : k + 2 * c.stride])
                for i, score in self.wand(terms[terms < len(self.terms)].tolist(), c.low, c.high):
                    out[d][i] = max(score, out[d].get(i, 0.0))
        return out

    def overlap(self, words: np.ndarray, item: int, have: dict[int, set[bytes]]) -> tuple[float, float, float]:
        """Shares of the item's, its question's and its answer's shingles that a document has; ``have`` keeps its sets."""
        own = self.words[self.ends[item - 1] if item else 0 : self.ends[item]]

        def share(part: np.ndarray) -> float:
            size = min(SHINGLE, len(part))
            if not size:
                return 1.0
            if size not in have:
                have[size] = shingles(words, size)
            wanted = shingles(part, size)
            return len(wanted & have[size]) / len(wanted)

        return share(own), share(own[: self.cut[item]]), share(own[self.cut[item] :])

    def find(self, texts: list[str | None], overlap: float = OVERLAP) -> list[list[tuple[int, float, float, float, float]]]:
        """(item id, score, overlap, question overlap, answer overlap) of the items that each text holds."""
        out: list[list[tuple[int, float, float, float, float]]] = []
        waiting: list[np.ndarray] = []

        def settle() -> None:
            for words, found in zip(waiting, self.candidates(waiting), strict=True):
                have: dict[int, set[bytes]] = {}
                checked = [(self.ids[i], s, *self.overlap(words, i, have)) for i, s in sorted(found.items())]
                out.append([c for c in checked if c[2] >= overlap and (c[2] >= OVERLAP or (c[3] >= PART and c[4] >= PART))])
            waiting.clear()

        size = 0
        for text in texts:
            waiting.append(self.numbers(tokens(text)))
            size += len(waiting[-1])
            if size >= TOGETHER:
                settle()
                size = 0
        settle()
        return out


def _terms(items: DataFrame) -> DataFrame:
    """A row (term) for each distinct term of each item, and one (null, words) for each item that has any."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in texts_of(batch, "text"):
                if words := tokens(text):
                    distinct = sorted(set(words))
                    yield pa.RecordBatch.from_arrays([pa.array([None, *distinct], pa.string()), pa.array([len(words), *[None] * len(distinct)], pa.int64())], names=["term", "words"])

    return items.select("text").mapInArrow(work, "term string, words long")


def indexes(items: DataFrame, threshold: float = RETRIEVE, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The items in indexes of about INDEX_BYTES bytes of text each."""
    items = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    many = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // INDEX_BYTES
    if many == 1:
        yield Index([(r["id"], r["text"]) for r in items.collect()], threshold)
        return
    listed = _terms(items)
    frequency = checkpoint(listed.filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    n, words = listed.filter("term is null").agg(F.count(F.lit(1)), F.sum("words")).first()
    for k in range(many):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(many)) == k)
        own = _terms(part).filter("term is not null").select("term").distinct().join(frequency, "term")
        known = {r["term"]: r["n"] for r in own.collect()}
        yield Index([(r["id"], r["text"]) for r in part.collect()], threshold, (n, (words or 0) / max(n, 1), known))


_FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in ("score", "overlap", "question_overlap", "answer_overlap")]]))


def with_items(docs: DataFrame, index: Index, text_col: str = "text", out: str = f"{OWN}found", overlap: float = OVERLAP) -> DataFrame:
    """``docs`` with an array of the index's items that each text holds."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    names = _FOUND.elementType.names

    def compute():
        own = shared.value
        kind = pa.list_(pa.struct([(names[0], pa.int64()), *[(n, pa.float64()) for n in names[1:]]]))

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([[dict(zip(names, f, strict=True)) for f in fs] for fs in own.find(texts_of(batch, text_col), overlap)], kind)]

        return work

    return add_columns(docs, [T.StructField(out, _FOUND)], compute)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = RETRIEVE, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap): what each document holds."""
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index in indexes(items, threshold):
        pairs = with_items(thin, index, "text", f"{OWN}found", overlap).select("doc_id", F.inline(f"{OWN}found"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no item."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    for index in indexes(items):
        docs = with_items(docs, index, text_col).filter(F.size(f"{OWN}found") == 0).select(*columns)
    return docs
