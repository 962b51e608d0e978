"""Toxicity: a counterfactual-regularised classifier.

A logistic model over hashed features of a text: its distinct words (runs of letters, lower case)
and their first four to six letters. Besides the labels, training sees pairs of labelled sentences with
identity terms and the same sentences with the terms swapped for others of their group; the squared
difference of the two scores is penalised, so that terms that name a group don't move the score.
Features whose share differs between the labels by less than LEAST_Z standard errors take no part; an
L1 penalty leaves few of the others with a weight.

Identity terms are a parameter, ``groups``: words and phrases that name groups of people, in groups within which they are
swapped (default: the table ``IDENTITY_TERMS``, of five languages). Of several terms that begin at a word the longest counts. Where no labelled sentence holds a
term there are no pairs, and the penalty changes nothing; ``Model.pairs`` tells how many there were.

Training rows are bounded: about ``rows`` labelled rows (default 12,000), taken by a hash of id and
text at a rate that the count gives; they are written to the shared folder and read twice: for features and for the pairs.
Executors do all that; the driver gets features (a few hundred numbers a row) and, of at most ``pairs`` pairs (default 200,000; beyond that those with the
least hashes, so the same ones in every run), only the features that take part, and fits them with proximal gradient steps. The weights (2^20 float32, mostly zero) are broadcast.

Null, empty and letterless texts have no feature and score as the intercept says. Texts are scored
whole, however long. Repeated labels of a document count as rows of their own. Where there is no row to learn from
every score is 0. Ties: pairs with one hash are alike. Repeated rows score alike. Columns of any name pass through, but
for the one of the score. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, crc_of_id, forget, texts_of, written

BUCKETS = 1 << 20
ROWS = 12_000
#: Weight of the counterfactual penalty, of L1, of L2, and gradient steps.
PAIRS, L1, L2, STEPS = 4.0, 3e-4, 1e-6, 200
#: Pairs of sentences that the driver fits at most.
MOST_PAIRS = 200_000
_WORDS = re.compile(r"[^\W\d_]+").findall
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
PREFIXES = (4, 5, 6)
LEAST_Z = 3.0

#: Identity terms in groups within which they are swapped.
IDENTITY_TERMS = (
    ("woman", "man", "girl", "boy", "transgender"),
    ("women", "men", "girls", "boys"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black people", "white people", "asian people", "latino people", "arab people"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("deaf", "blind", "disabled"),
    ("native american", "african american", "asian american"),
    ("american", "mexican", "german", "french", "turkish", "russian", "chinese"),
    ("frau", "mann"),
    ("christen", "muslime", "juden", "hindus"),
    ("femme", "homme"),
    ("chrétiens", "musulmans", "juifs"),
    ("mujer", "hombre"),
    ("cristianos", "musulmanes", "judíos"),
)


def swaps_of(groups) -> dict[tuple[str, ...], tuple[str, ...]]:
    """Each term and the next one of its group, as words."""
    split = [[tuple(_WORDS(t.lower())) for t in g] for g in groups]
    return {w: g[(k + 1) % len(g)] for g in split if len(g) > 1 for k, w in enumerate(g) if w}


SWAPS = swaps_of(IDENTITY_TERMS)


@dataclass
class Model:
    """Weights of BUCKETS features, the intercept, and what it was fitted to."""

    weights: np.ndarray
    bias: float
    pairs: int = 0


def words_of(text: str | None) -> set[str]:
    return set(_WORDS(text.lower())) if text else set()


def _buckets(word: str) -> tuple[int, ...]:
    out = [crc32(b"w:" + word.encode("utf-8", "surrogatepass")) % BUCKETS]
    out += [crc32(b"p:" + word[:k].encode("utf-8", "surrogatepass")) % BUCKETS for k in PREFIXES if len(word) >= k]
    return tuple(out)


def features(words: set[str], cache: dict[str, tuple[int, ...]] | None = None) -> list[int]:
    cache = {} if cache is None else cache
    out: set[int] = set()
    for w in words:
        got = cache.get(w)
        if got is None:
            got = _buckets(w)
            if len(cache) < 200_000:  # memory only: a word that isn't kept is hashed again
                cache[w] = got
        out.update(got)
    return sorted(out)


def counterfactuals(text: str | None, swaps: dict[tuple[str, ...], tuple[str, ...]] = SWAPS) -> list[tuple[set[str], set[str]]]:
    """For each sentence with identity terms: its words, and its words with each term swapped for the next of its group, if that are others."""
    starts: dict[str, list[int]] = {}
    for term in swaps:
        starts.setdefault(term[0], []).append(len(term))
    out = []
    for sentence in _SENTENCE.split(text or ""):
        words = _WORDS(sentence.lower())
        if starts.keys().isdisjoint(words):
            continue
        swapped, k = [], 0
        while k < len(words):
            term = next((t for n in sorted(starts.get(words[k], ()), reverse=True) if (t := tuple(words[k : k + n])) in swaps), None)
            swapped += swaps[term] if term else words[k : k + 1]
            k += len(term) if term else 1
        if set(swapped) != set(words):
            out.append((set(words), set(swapped)))
    return out


class Rows:
    """Sparse binary rows, only over the given columns."""

    def __init__(self, rows: list[np.ndarray], columns: np.ndarray):
        self.n = len(rows)
        flat, row = _flat(rows)
        place = np.searchsorted(columns, flat).astype(np.int32)
        known = place < len(columns)
        known[known] = columns[place[known]] == flat[known]
        self.row, self.col = row[known], place[known]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.col, weights=r[self.row], minlength=size)


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All features of the rows, and which row each is of."""
    return np.concatenate([*rows, np.zeros(0, dtype=np.int32)]).astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])


def telling(rows: list[np.ndarray], labels: np.ndarray, least_z: float = LEAST_Z) -> np.ndarray:
    """Features whose share among the rows of either label differs by at least ``least_z`` standard errors."""
    flat, row = _flat(rows)
    positive = labels[row] > 0
    ones, zeros = np.bincount(flat[positive], minlength=BUCKETS), np.bincount(flat[~positive], minlength=BUCKETS)
    n1, n0 = int((labels > 0).sum()), int((labels <= 0).sum())
    share = (ones + zeros) / (n1 + n0)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    return np.nonzero((np.abs(ones / n1 - zeros / n0) >= least_z * error) & (ones + zeros > 0))[0].astype(np.int32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], penalty: float = PAIRS, columns: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights of BUCKETS features and an intercept, by accelerated proximal gradient steps."""
    weights = np.zeros(BUCKETS, dtype=np.float32)
    n = len(rows)
    if not n:
        return weights, -np.inf
    if len(set(labels.tolist())) < 2:
        return weights, 40.0 if labels[0] else -40.0
    columns = telling(rows, labels) if columns is None else columns
    x, a, b = Rows(rows, columns), Rows([p[0] for p in pairs], columns), Rows([p[1] for p in pairs], columns)
    size, y = len(columns), labels.astype(np.float64)
    # rows of both labels weigh the same in sum
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    w, bias = np.zeros(size), 0.0
    # features are scaled by their frequency, so that frequent ones don't set the step
    scale = 1.0 / np.sqrt(np.maximum(x.back(share, size), 1e-9) + 1e-3)
    v, vb, t = w.copy(), bias, 1.0
    step = 1.0

    def loss(w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        z = x.times(w * scale) + bias
        p = _sigmoid(z)
        value = float((share * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * L2 * (w @ w))
        r = share * (p - y)
        g, gb = x.back(r, size) * scale + L2 * w, float(r.sum())
        if a.n and penalty:
            pa_, pb = _sigmoid(a.times(w * scale) + bias), _sigmoid(b.times(w * scale) + bias)
            d = pa_ - pb
            value += penalty * float((d * d).mean())
            ra, rb = 2 * penalty / a.n * d * pa_ * (1 - pa_), 2 * penalty / a.n * d * pb * (1 - pb)
            g += (a.back(ra, size) - b.back(rb, size)) * scale
            gb += float((ra - rb).sum())
        return value, g, gb

    for _ in range(STEPS):
        value, g, gb = loss(v, vb)
        while True:
            moved = v - step * g
            new = np.sign(moved) * np.maximum(np.abs(moved) - step * L1, 0)
            new_b = vb - step * gb
            d, db = new - v, new_b - vb
            if loss(new, new_b)[0] <= value + float(g @ d) + gb * db + (float(d @ d) + db * db) / (2 * step) + 1e-12 or step < 1e-8:
                break
            step /= 2
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        change = float(np.abs(new - w).max()) if size else 0.0
        v, vb = new + (t - 1) / nt * (new - w), new_b + (t - 1) / nt * (new_b - bias)
        w, bias, t = new, new_b, nt
        step *= 1.1
        if change < 1e-5:
            break
    weights[columns] = (w * scale).astype(np.float32)
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, groups=IDENTITY_TERMS, penalty: float = PAIRS, most_pairs: int = MOST_PAIRS) -> Model:
    """Fit the labelled documents (all of those that are given; bounded as said above)."""
    marked = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).filter("id is not null and y is not null")
    count = marked.count()
    # ids are sampled before the texts are joined; repeated ids go in or stay out together
    picked = marked.filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < float(1 << 30) * min(1.0, rows / max(1, count)))
    # by number: few rows, but much work for each
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = written(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(picked, F.col("doc") == F.col("id")).select("y", "text").repartition(tasks))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            found = [np.array(features(words_of(t), cache), dtype=np.int32).tobytes() for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("y")), pa.array(found, pa.binary())], names=["y", "x"])

    numbers = lambda b: np.frombuffer(b, dtype=np.int32)
    got = joined.mapInArrow(extract, "y int, x binary").toArrow()
    # in an order of their own, so that sums don't depend on which task ended first
    ordered = sorted(zip(got.column("x").to_pylist(), got.column("y").to_pylist(), strict=True))
    x, y = [numbers(b) for b, _ in ordered], np.array([int(label == 1) for _, label in ordered])
    if len(set(y.tolist())) < 2:
        forget(joined)
        return Model(*fit(x, y, []))
    columns = telling(x, y)
    shared = docs.sparkSession.sparkContext.broadcast((swaps_of(groups), columns))

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swaps, columns = shared.value
        part, cache = set(columns.tolist()), {}

        def numbers_of(words: set[str]) -> bytes:
            out: set[int] = set()
            for w in words:
                got = cache.get(w)
                if got is None:
                    got = tuple(x for x in _buckets(w) if x in part)
                    if len(cache) < 500_000:  # memory only
                        cache[w] = got
                if got:
                    out.update(got)
            return np.array(sorted(out), dtype=np.int32).tobytes()

        for batch in batches:
            for t in texts_of(batch, "text"):  # a text's pairs at a time
                moved = [p for a, b in counterfactuals(t, swaps) if (p := (numbers_of(a), numbers_of(b)))[0] != p[1]]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in moved], pa.binary()) for k in (0, 1)], names=["a", "b"])

    found = joined.mapInArrow(swap, "a binary, b binary")
    got = found.withColumn("h", F.xxhash64("a", "b")).orderBy("h", "a", "b").limit(most_pairs).select("a", "b").toArrow()
    pairs = sorted(zip(got.column("a").to_pylist(), got.column("b").to_pylist(), strict=True))
    forget(joined)
    return Model(*fit(x, y, [(numbers(a), numbers(b)) for a, b in pairs], penalty, columns), len(pairs))


def predict(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with a score from 0 to 1."""
    used = np.nonzero(model.weights)[0]
    shared = df.sparkSession.sparkContext.broadcast((used.astype(np.int32), model.weights[used], model.bias))

    def compute():
        used, values, bias = shared.value
        table = np.zeros(BUCKETS, dtype=np.float64)
        table[used] = values
        weighty = set(used.tolist())
        cache: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            hit: set[int] = set()
            for w in words_of(text):
                got = cache.get(w)
                if got is None:
                    got = tuple(b for b in _buckets(w) if b in weighty)
                    if len(cache) < 500_000:  # memory only
                        cache[w] = got
                if got:
                    hit.update(got)
            z = bias + float(table[sorted(hit)].sum()) if hit else bias
            return 0.0 if z == -np.inf else float(1.0 / (1.0 + np.exp(-max(-40.0, min(40.0, z)))))

        return lambda batch: [pa.array([score(t) for t in texts_of(batch, text_col)], pa.float64())]

    return add_columns(df, [T.StructField(out, T.DoubleType())], compute)


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """Learn from labels that aren't held out (crc32 of the id mod 5 is not 0), score every document."""
    model = train(docs, labels.filter(crc_of_id(F.col("doc_id")) % 5 != 0), rows=rows)
    return predict(docs, model)
