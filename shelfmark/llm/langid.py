"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes one space, and 1-, 2- and 3-grams are hashed
to 2^16 buckets. Training counts (language, bucket) on executors; the log-probability matrix
(buckets x languages, float32) is broadcast, and batches are scored as sparse sums of its rows in
numpy, some hundred thousand n-grams at a time whatever a text's length is.

Training rows are bounded: about ``per_lang`` rows of each language (default 6000), taken by a hash
of id and text with a rate that the counts give. Languages of the matrix are those of the training
rows, all with the same prior. The matrix takes a quarter of a MB a language; more than MOST_LANGS (400) of them raise an error.

Beside the language comes, where it is asked for, how far the text is from it: by how many nats an n-gram of the text is less likely than one
of the language's training rows. Texts of languages that weren't learned, and letters without sense, are far from all.

A text that is null or has no letter gets ``und`` with score 0, as does every text where there was
no row to learn from. Ties go to the language that is first by code point. Whole texts are scored, however long.
Repeated rows score alike. Columns of any name pass through, but for those of the results and those that begin with ``__sm_``. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, add_columns, crc_of_id, texts_of

BUCKETS = 1 << 16
PER_LANG = 6000
#: More languages than this raise an error; it bounds the matrix and the table of rates.
MOST_LANGS = 400
UNDETERMINED = "und"
SMOOTHING = 0.5
#: n-grams scored at a time, over all languages of the matrix.
BLOCK = 1 << 21


def _letters() -> np.ndarray:
    """Code point below 2^16 to its lower-case letter, anything else to a space (those above: see ``_high``)."""
    table = np.full(1 << 16, 32, dtype=np.uint16)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_TABLE: list[np.ndarray] = []


def _high(codes: np.ndarray) -> np.ndarray:
    """Code points above 2^16 to their lower-case letters, anything else to a space."""
    some, where = np.unique(codes, return_inverse=True)
    low = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in map(chr, some.tolist())]
    return np.array(low, dtype=np.uint32)[where]


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed n-grams of the texts one after the other, by order; and where each text starts.

    An array's item k is the bucket of the n-gram at position k, or BUCKETS where that runs over
    the text's end.
    """
    if not _TABLE:
        _TABLE.append(_letters())
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts), dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=starts[1:])
    codes = np.concatenate([np.array([32], dtype=np.uint32), codes, np.array([32], dtype=np.uint32)])  # text k now has a space before it at starts[k]
    letters = _TABLE[0][np.minimum(codes, 0xFFFF)].astype(np.uint32)
    high = codes > 0xFFFF
    if high.any():
        letters[high] = _high(codes[high])
    space = letters == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[starts] = True
    where = np.cumsum(keep) - 1
    c, s = letters[keep], space[keep]
    starts = where[starts]
    end = np.zeros(len(c), dtype=bool)  # a space that the next text's space follows
    end[:-1] = s[:-1] & s[1:]
    one = ((c * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
    two = np.full(len(c), BUCKETS, dtype=np.int32)
    three = np.full(len(c), BUCKETS, dtype=np.int32)
    two[:-1] = (((c[:-1] * np.uint32(2246822519)) ^ (c[1:] * np.uint32(3266489917)) ^ np.uint32(0x9E3779B9)) * np.uint32(668265263)) >> np.uint32(16)
    three[:-2] = (((c[:-2] * np.uint32(374761393)) ^ ((c[1:-1] * np.uint32(2654435761)) + (c[2:] * np.uint32(3266489917)))) * np.uint32(2246822519)) >> np.uint32(16)
    one[s] = BUCKETS
    two[end] = BUCKETS
    three[end] = BUCKETS
    three[:-1][end[1:]] = BUCKETS
    three[starts[1:] - 1] = BUCKETS  # it would run into the next text
    return [one, two, three], starts


def blocks(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``chars`` characters each."""
    begin = have = 0
    for k, text in enumerate(texts):
        have += len(text) + 1
        if have >= chars:
            yield begin, k + 1
            begin, have = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


class Model:
    """Languages and the log-probability matrix (BUCKETS + 1 rows; the last is zero)."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self._fill({lang: _logs(c) for lang, c in zip(langs, counts, strict=True)})

    @classmethod
    def of(cls, logs: dict[str, tuple[np.ndarray, float]]) -> Model:
        """From each language's log-probabilities and the mean of them over its training rows."""
        out = cls.__new__(cls)
        out._fill(logs)
        return out

    def _fill(self, logs: dict[str, tuple[np.ndarray, float]]) -> None:
        self.langs = list(logs)
        self.usual = np.array([mean for _, mean in logs.values()])
        self.matrix = np.zeros((BUCKETS + 1, len(logs)), dtype=np.float32)
        for k, (own, _) in enumerate(logs.values()):
            self.matrix[:BUCKETS, k] = own

    def sums(self, texts: list[str], sizes: np.ndarray | None = None) -> np.ndarray:
        """Log-likelihood of each text in each language; ``sizes`` gets the texts' numbers of n-grams added."""
        out = np.zeros((len(texts), len(self.langs)))
        step = max(1 << 12, BLOCK // max(1, len(self.langs)))
        for begin, end in blocks(texts, 1 << 18):
            orders, starts = grams(texts[begin:end])
            for hashed in orders:
                for a in range(0, len(hashed), step):
                    part = self.matrix[hashed[a : a + step]]
                    first = int(np.searchsorted(starts, a, "right")) - 1
                    last = int(np.searchsorted(starts, a + len(part), "left"))
                    cuts = np.maximum(starts[first:last] - a, 0)
                    out[begin + first : begin + last] += np.add.reduceat(part.astype(np.float64) if len(cuts) < 4 else part, cuts, axis=0)
                    if sizes is not None:
                        sizes[begin + first : begin + last] += np.add.reduceat((hashed[a : a + step] < BUCKETS).astype(np.int64), cuts)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, posterior probabilities, and distances in nats an n-gram."""
        if not self.langs or not texts:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        sizes = np.zeros(len(texts), dtype=np.int64)
        sums = self.sums(texts, sizes)
        best = sums.argmax(axis=1)
        odds = np.exp(sums - sums.max(axis=1, keepdims=True))
        far = self.usual[best] - sums.max(axis=1) / np.maximum(sizes, 1)
        return [self.langs[k] for k in best], 1.0 / odds.sum(axis=1), far


def _logs(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Smoothed log-probabilities of buckets, and their mean over the n-grams counted."""
    smooth = counts + SMOOTHING
    logs = np.log(smooth) - np.log(smooth.sum())
    return logs.astype(np.float32), float(counts @ logs / max(1.0, counts.sum()))


def _dense(counts: list) -> np.ndarray:
    out = np.zeros(BUCKETS)
    np.add.at(out, np.array([c["bucket"] for c in counts], dtype=np.int64), np.array([c["n"] for c in counts], dtype=np.float64))
    return out


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG) -> Model:
    """A model of the rows with a language and a text."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().withColumnsRenamed({"lang": "of", "count": "n"})
    if sizes.limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages to learn")
    rate = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("n"))
    picked = rows.join(F.broadcast(sizes.select("of", rate.alias("rate"))), F.col("lang") == F.col("of")).filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.col("rate") * float(1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(texts_of(batch, "lang"), texts_of(batch, "text"), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                have = total.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                for a, b in blocks(texts, 1 << 18):
                    for hashed in grams(texts[a:b])[0]:
                        have += np.bincount(hashed, minlength=BUCKETS + 1)
        for lang, have in total.items():
            used = np.nonzero(have[:BUCKETS])[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(have[used], pa.int64())], names=["lang", "bucket", "n"])

    counts = picked.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # a row a language, one after the other: the driver holds one language's counts beside the matrix
    by_lang = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    parts = [(r["lang"], _logs(_dense(r["counts"]))) for r in by_lang.toLocalIterator()]
    return Model.of(dict(sorted(parts)))


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", far_out: str | None = None) -> DataFrame:
    """``df`` with the predicted language, its posterior probability and, if it has a name, the distance."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def compute():
        own = shared.value

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = texts_of(batch, text_col)
            some = [k for k, ok in enumerate(texts_of(batch, f"{OWN}letters")) if ok]
            lang, numbers = [UNDETERMINED] * len(texts), np.zeros((2, len(texts)))
            got, *told = own.predict([texts[k] for k in some])
            numbers[:, some] = told
            for k, x in zip(some, got, strict=True):
                lang[k] = x
            return [pa.array(lang, pa.string()), pa.array(numbers[0], pa.float64()), pa.array(numbers[1], pa.float64())][: 3 if far_out else 2]

        return work

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    fields = [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType()), *([T.StructField(far_out, T.DoubleType())] if far_out else [])]
    return add_columns(df.withColumn(f"{OWN}letters", letters), fields, compute).drop(f"{OWN}letters")


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """Learn from the documents that aren't held out (crc32 of the id mod 4 is not 2), predict all."""
    return predict(docs, train(docs.filter(crc_of_id(F.col("doc_id")) % 4 != 2), per_lang=per_lang))
