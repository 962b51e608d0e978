"""Operators 11 to 13 against brute force, with their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import bpe, merkle, negatives

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx string, hash int, place string"


# --- Merkle manifest


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([_sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def _path(levels, i):
    for level in levels[:-1]:
        b = i // 3 * 3
        yield "".join(level[b:i]), "".join(level[i + 1 : b + 3])
        i //= 3


def plain_manifest(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted(((_sha("".join(map(_enc, (r[0], r[3], r[2], r[4], r[1])))), r) for r in rows if r[3] == s), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees.append((own, _levels([h for h, _ in own])))
    top = _levels([levels[-1][0] for _, levels in trees])
    for k, (own, levels) in enumerate(trees):
        for i, (leaf, (doc_id, text, lang, source, n)) in enumerate(own):
            steps = [*_path(levels, i), *_path(top, k)]
            if text is not None and zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = _sha("".join(map(_enc, (doc_id, source, lang, n, text))))
            for left, right in steps:
                folded = _sha(left + folded + right)
            yield doc_id, leaf, levels[-1][0], top[-1][0], _sha("".join(a + b for a, b in steps)), folded, folded == top[-1][0]


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _manifest(df):
    return sorted(repr(tuple(r[c] for c in NAMES)) for r in merkle.of_documents(df).collect())


def test_manifest_equals_brute_force(spark):
    """Sources of every size around the blocks' edges, nulls, ties, repeated rows, clashing columns."""
    rng, rows = random.Random(3), []
    for s, n in {None: 5, "": 1, "a": 1, "b": 2, "c": 3, "d": 4, "e": 26, "f": 27, "g": 28, "h": 81, "i": 82, "j": 730, "é": 9, "￿": 2, "\U00010000": 2}.items():
        rows += [(rng.choice([None, 7, 7, rng.randrange(10**6)]) if n < 30 else rng.randrange(10**6), rng.choice([None, "", "a\nb", "x" * 5000, "plain", "\n"]), rng.choice([None, "en"]), s, rng.choice([None, 3])) for _ in range(n)]
    rows += rows[:9]
    df = spark.createDataFrame([(*r, "t", "i", 0, "p") for r in rows], DOCS)
    assert _manifest(df) == sorted(map(repr, plain_manifest(rows)))
    assert _manifest(df.repartition(7, "text")) == _manifest(df)


def test_manifest_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([], DOCS)
    assert merkle.of_documents(df).count() == 0
    one = merkle.of_documents(spark.createDataFrame([(1, None, None, None, None, "", "", 0, "")], DOCS)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"] and one["proof_sha256"] == _sha("")


def test_a_changed_sibling_is_seen(spark):
    rows = [(k, f"text {k}", "en", "s", 1, "", "", 0, "") for k in range(100)]
    leaves = spark.createDataFrame(rows, DOCS).select("doc_id", "source", merkle.leaf_of(F.col("doc_id"), F.col("text")).alias("leaf"))
    proofs, root = merkle.manifest(leaves, "source", "doc_id", "leaf", [])
    turned = lambda side: F.translate(side, "0123456789abcdef", "123456789abcdef0")
    other = F.transform("steps", lambda s: F.struct(turned(s["left"]).alias("left"), turned(s["right"]).alias("right")))
    told = proofs.select((merkle.fold(F.col("leaf"), F.col("steps")) == root).alias("good"), (merkle.fold(F.col("leaf"), other) == root).alias("bad")).collect()
    assert all(r["good"] for r in told) and not any(r["bad"] for r in told)


# --- hard negatives


def plain_negatives(rows, every):
    own = []
    for i, vec, label in rows:
        if vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        own.append((i, [max(-negatives.MOST, min(negatives.MOST, math.floor(256 * x))) for x in vec], label))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (i, q, label) in enumerate(own):
        if i is None or i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, p, strict=False)), last(j), j, k == label) for b, (j, p, k) in enumerate(own) if b != a]
        scored.sort(key=lambda x: x[:2])
        for s, _, j, _ in [x for x in scored if x[3]][:5]:
            hard = [(n, -m) for m, _, n, same in scored if not same and 30 * -s <= 100 * -m <= 90 * -s][:10]
            out += [(i, j, r + 1, n, -s, m) for r, (n, m) in enumerate(hard)]
    return sorted(map(repr, out))


def _mined(spark, rows, every, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("row", F.lit("x")).withColumn("q", F.lit("y")).withColumn("id", F.lit("z")).withColumn("n", F.lit(1))
    got = negatives.mine(df, F.col("id") % every == 0, "vec_id", F.col("label"), "embedding")
    return sorted(repr((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])) for r in got.collect())


@pytest.mark.parametrize("spread", [0.02, 0.3, 5.0])
def test_negatives_equal_brute_force(spark, spread):
    rng = np.random.default_rng(5)
    middle = rng.normal(0, spread, (4, 12))
    rows = [(k, [float(x) for x in middle[k % 4] + rng.normal(0, spread, 12)], int(rng.integers(0, 4))) for k in range(700)]
    assert _mined(spark, rows, 10) == plain_negatives(rows, 10)


def test_negatives_with_odd_rows(spark):
    rng = np.random.default_rng(6)
    vec = lambda n=4: [float(x) for x in rng.normal(0, 1, n)]
    same = vec()
    rows = [(k, vec(), k % 2) for k in range(60)] + [(100 + k, same, k % 3) for k in range(300)]
    rows += [(0, None, 1), (10, vec(), None), (20, [1.0, None], 0), (30, [float("nan")], 0), (40, [float("inf"), 1.0], 1), (50, [], 1), (60, vec(2), 0), (70, vec(9), 1), (80, [1e30, -1e30, 3.0], 0), (None, vec(), 1), (None, same, 0), (None, same, 0)]
    rows += [(110, same, 1)] * 12 + [(5, vec(), 0)] * 3
    assert _mined(spark, rows, 10) == plain_negatives(rows, 10)
    assert _mined(spark, [], 10) == [] and _mined(spark, [(0, [1.0], 1)], 10) == []


def test_intervals_hold_their_scores_and_pairs_go_early():
    rng = np.random.default_rng(7)
    q, r = rng.integers(-90, 90, (40, 16)), rng.integers(-90, 90, (500, 16))
    want = q @ r.T
    lo, hi = np.full((40, 1), np.int64(20_000)), np.full((40, 1), np.int64(30_000))
    windows = negatives.Windows(lo, hi, 10)
    i, c, score = negatives.survivors(q, negatives.Planes(r, np.float32), np.ones(want.shape, bool), windows)
    assert (want[i, c] == score).all() and len(i) < want.size / 8
    for a in range(40):
        fit = np.sort(want[a][(want[a] >= 20_000) & (want[a] <= 30_000)])[::-1][:10]
        assert (np.sort(score[(i == a) & (score >= 20_000) & (score <= 30_000)])[::-1][: len(fit)] == fit).all()


# --- BPE


PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  a  ", "Hello world's  end\n\n\t x", "日本語 テキスト", "😀😀 é", "<|endoftext|>", "a<|endoftext|>b <|endoftext|", "12 345 ½ Ⅷ", "\x00\x1c\x85  x", "aaaaaaa" * 700, "ab " * 90_000, "x1" * 9000, "\U00016d40\U0001ccf0 ՘ \U0003ffff"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_bpe_equals_the_library(spark, library):
    rng = random.Random(4)
    pool = [" ", "  ", "\n", "the", " The", "'s", "'LL", "12", " 7", "é", "ß", "日", "😀", "́", "<|endoftext|>", "<|", "\x1c", "\x85", "　", "aaaa", "!!", "…"]
    texts = ODD + ["".join(rng.choices(pool, k=rng.randrange(40))) for _ in range(600)] + ["again", "again"]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, ids string, decoded string")
    content = bpe.read(PATH)
    got = bpe.decode(bpe.encode(df, content), content).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False) == (r["text"] or "")
    assert bpe.encode(df.limit(0), content).count() == 0


def test_bpe_decodes_what_no_text_gave(spark, library):
    rng = random.Random(8)
    lists = [None, [], [50256, 50256], [10**6, -1, 1], *[[rng.randrange(50257) for _ in range(30)] for _ in range(200)], *[[rng.randrange(256) for _ in range(9)] for _ in range(200)]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k long, ids array<int>")
    content = bpe.read(PATH)
    for skip in (False, True):
        got = {r["k"]: r["decoded"] for r in bpe.decode(df, content, skip_special_tokens=skip).collect()}
        assert got[0] is None and got[1] == ""
        for k, x in enumerate(lists[4:], 4):
            assert got[k] == library.decode(x, skip_special_tokens=skip)


def test_tree_gives_the_leftmost_lowest_rank():
    rng = random.Random(9)
    for _ in range(300):
        ranks, products = [{} for _ in range(40)], []
        for new in range(6, 40):
            a, b = rng.randrange(new), rng.randrange(new)
            if b not in ranks[a]:
                ranks[a][b] = len(products)
                products.append(new)
        word = [rng.randrange(6) for _ in range(rng.choice([1, 2, 3, 17, 64, 65]))]
        want = list(word)
        while True:
            pairs = [(ranks[a][b], i) for i, (a, b) in enumerate(zip(want, want[1:], strict=False)) if b in ranks[a]]
            if not pairs:
                break
            rank, i = min(pairs)
            want[i : i + 2] = [products[rank]]
        assert list(bpe.merge_all(word, ranks, products)) == want


def test_pieces_are_cut_where_words_end():
    words = bpe.Words()
    text = "".join(random.Random(2).choices(["word", " ", "  ", "\n", "\n\n", "12", "!", "é"], k=400_000))
    parts = list(words.pieces(text))
    assert len(parts) > 2 and "".join(parts) == text
    assert [w for p in parts for w in words(p)] == words(text)


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.Vocabulary(bpe.read(public_tokenizers.path("word_bpe_49k.json")))
