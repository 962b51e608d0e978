"""Byte-level BPE: whole texts to token ids and back, with any vocabulary file of the ``tokenizers`` library's format.

A text is cut at the vocabulary's special tokens, then into words by the byte-level pattern; a word's UTF-8 bytes are
its first symbols. A segment tree over the ranks of adjacent pairs holds, in its root, the leftmost pair of the lowest
rank. Merging it changes three leaves (the pair itself, its left neighbour, the pair that began at the symbol that is
gone), each an update along one path to the root, until the root says that no pair can be merged: O(n log n) for a word of n bytes, however
long. Words that a task met before come from a bounded table.

The vocabulary's content goes to the tasks with the function that they run (files above MOST_BYTES are refused), so
executors need no file. Special tokens' strings in a text are special tokens, as in the library.

Null texts count as empty (no ids). Empty texts have no ids and decode to the empty text. Very long texts are read whole, a part after the other;
a single word of n bytes needs about 60 n bytes. Ties between pairs of one rank go to the leftmost. Repeated rows and equal texts get equal
ids. Columns pass through whatever their names, but for the output's name, which is replaced. Ids that the vocabulary lacks, and null ids, are left out
when decoding; null lists decode to null. Bytes that aren't UTF-8 become U+FFFD. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, bytes_of

#: A vocabulary file is sent with every task's function.
MOST_BYTES = 64 << 20
#: Words that a task remembers, and the characters of the longest of them.
REMEMBERED, LONGEST = 1 << 19, 64
#: Characters of a text that are cut into words at a time.
PIECE = 1 << 18
#: From this many symbols on a word's tree lies in flat arrays instead of lists.
FLAT = 1 << 12

# Letters and numbers that Unicode 16 has beyond Unicode 15.1 (hexadecimal ranges).
UNICODE_16 = (
    "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d40-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 116d0-116e3 "
    "11bc0-11be0 11bf0-11bf9 13460-143fa 16100-1611d 16130-16139 16d40-16d6c 16d70-16d79 18cff 1ccf0-1ccf9 1e5d0-1e5ed 1e5f0-1e5fa"
)
# Fixed value: the words of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranges(points: list[int]) -> str:
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Words:
    """Cuts texts into words, with letters and numbers as of Unicode 16, whatever version the regex module knows."""

    def __init__(self) -> None:
        known = regex.compile(r"[\p{L}\p{N}]")
        added = {c for part in UNICODE_16.split() for a, _, b in [part.partition("-")] for c in range(int(a, 16), int(b or a, 16) + 1)}
        later = [ord(m[0]) for m in known.finditer("".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))) if unicodedata.category(m[0]) == "Cn" and ord(m[0]) not in added]
        self.plain = regex.compile(WORDS)
        self.later = self.exact = None
        self.first = later[0] if later else 0x110000
        if later:
            x = _ranges(later)
            self.high = re.compile(f"[\\U{later[0]:08x}-\\U0010ffff]")
            self.later = regex.compile(f"[{x}]")
            self.exact = regex.compile(WORDS.replace(r"[^\s\p{L}\p{N}]", rf"[^\s[\p{{L}}\p{{N}}--[{x}]]]").replace(r"?\p{L}", rf"?[\p{{L}}--[{x}]]").replace(r"?\p{N}", rf"?[\p{{N}}--[{x}]]"), regex.V1)
        self.cut = re.compile(r"(?<=[^\s])(?=[ \n\r\t])")

    def pieces(self, text: str) -> Iterator[str]:
        """``text`` in parts that end where a word ends: a white space after another character begins a word, whatever came before."""
        at = 0
        while len(text) - at > PIECE:
            found = self.cut.search(text, at + PIECE)
            if found is None:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def __call__(self, text: str) -> list[str]:
        odd = self.later is not None and not text.isascii() and self.high.search(text) and self.later.search(text)
        return (self.exact if odd else self.plain).findall(text)


def merge_all(symbols: list[int], ranks: list[dict[int, int]], products: list[int]) -> tuple[int, ...]:
    """A word's symbols after all merges; ``ranks`` has, by a pair's first symbol, the ranks by its second one.

    The leaf of a pair holds rank * n + position, so the least value is the leftmost of the lowest rank; ``none`` is above all of them.
    """
    n = len(symbols)
    if n < 2:
        return tuple(symbols)
    none, size = len(products) * n, 1 << (n - 2).bit_length()
    make = list if n < FLAT else (lambda values: array("q", values))
    symbols, after, before, tree = make(symbols), make(range(1, n + 1)), make(range(-1, n - 1)), make([none]) * (2 * size)
    for i in range(n - 1):
        rank = ranks[symbols[i]].get(symbols[i + 1])
        if rank is not None:
            tree[size + i] = rank * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    while (best := tree[1]) < none:
        rank, i = divmod(best, n)
        symbols[i] = symbol = products[rank]
        j = after[i]
        after[i] = right = after[j]
        tree[size + i] = none
        if right < n:
            before[right] = i
            tree[size + j] = none
            rank = ranks[symbol].get(symbols[right])
            if rank is not None:
                tree[size + i] = rank * n + i
        left = before[i]
        if left >= 0:
            rank = ranks[symbols[left]].get(symbol)
            tree[size + left] = none if rank is None else rank * n + left
        for k in (j, i, left):
            if 0 <= k < n - 1:
                k = (size + k) >> 1
                while k:
                    a, b = tree[2 * k], tree[2 * k + 1]
                    if b < a:
                        a = b
                    if tree[k] == a:
                        break
                    tree[k] = a
                    k >>= 1
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return tuple(out)


class Remembered(dict):
    """Word to ids; what is asked for the first time is computed, and the table starts anew when it is full."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.compute(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Vocabulary:
    """Token ids, merges and special tokens of a byte-level BPE file."""

    def __init__(self, content: bytes) -> None:
        told = json.loads(content)
        model, before = told["model"], told.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or model.get("byte_fallback") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("not a plain BPE model")
        if told.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("not byte-level words without a prefix")
        if any(t.get(k) for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens that take in what stands beside them aren't known")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        back = {c: b for b, c in letters.items()}
        ids: dict[str, int] = model["vocab"]
        self.first = [ids[letters[b]] for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        nothing: dict[int, int] = {}
        self.ranks = [nothing] * (1 + max(ids.values()))
        for rank, (a, b) in enumerate(merges):
            if not self.ranks[ids[a]]:
                self.ranks[ids[a]] = {}
            self.ranks[ids[a]][ids[b]] = rank
        self.products = [ids[a + b] for a, b in merges]
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.special = special
        self.at_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.bytes: list[bytes | None] = [None] * (1 + max([*ids.values(), *special.values()]))
        for token, i in ids.items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in special.items():
            self.bytes[i] = token.encode()
        self.words = Words()
        self.remembered = Remembered(self.word)

    def word(self, word: str) -> tuple[int, ...]:
        return merge_all([self.first[b] for b in word.encode()], self.ranks, self.products)

    def encode(self, text: str) -> array:
        out, get = array("i"), self.remembered.__getitem__
        for part in self.at_special.split(text) if self.at_special and any(s in text for s in self.special) else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for piece in self.words.pieces(part):
                out.extend(chain.from_iterable(map(get, self.words(piece))))
        return out


@lru_cache(maxsize=2)
def _vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary(content)


def read(path: str) -> bytes:
    """The content of a vocabulary file, which the driver reads once."""
    with open(path, "rb") as f:
        content = f.read(MOST_BYTES + 1)
    if len(content) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return content


def encode(df: DataFrame, content: bytes, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the token ids (array<int>) of each whole text."""

    def compute():
        vocabulary = _vocabulary(content)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            ids, ends = array("i"), [0]
            for data in bytes_of(batch, text_col):
                ids.extend(vocabulary.encode((data or b"").decode("utf-8", "replace")))
                ends.append(len(ids))
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, dtype=np.int32) if ids else [], pa.int32()))]

        return work

    return add_columns(df, [T.StructField(out, T.ArrayType(T.IntegerType()))], compute)


def decode(df: DataFrame, content: bytes, ids_col: str = "ids", out: str = "decoded", skip_special_tokens: bool = False) -> DataFrame:
    """``df`` with the text of each list of ids."""

    def compute():
        vocabulary = _vocabulary(content)
        skipped = set(vocabulary.special.values()) if skip_special_tokens else set()
        known = pa.array([b"" if b is None or i in skipped else b for i, b in enumerate(vocabulary.bytes)], pa.binary())

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            ids = lists.flatten().cast(pa.int64())
            ids = pc.if_else(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(known))), ids, pa.scalar(None, pa.int64()))
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            joined = pc.binary_join(pa.ListArray.from_arrays(ends, pc.fill_null(known.take(ids), b"")), b"")
            texts = [None if data is None else data.decode("utf-8", "replace") for data in pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.binary())).to_pylist()]
            return [pa.array(texts, pa.string())]

        return work

    return add_columns(df, [T.StructField(out, T.StringType())], compute)
