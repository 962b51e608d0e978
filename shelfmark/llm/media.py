"""Media columns: interleaved document sequences.

``parse`` turns HTML into one ordered array of structs per document: text runs and media references,
each with its position, a reference with its digest, its alternative text and its caption (the
figure's caption, wherever in the figure it stands). ``interleave`` joins references to a media table by
digest and puts what it finds back at the same positions. Only references travel to the join, never
a document's text, and only those columns of the media table that the caller asks for: a store's
payloads move if they are asked for, descriptors otherwise.

``encode`` makes the media table: digest, and the payload as PNG (8-bit RGB, 64 pixels or 192 bytes a row, no
filter). A task stores a digest once, so a text with thousands of copies is encoded once a task, and payloads aren't shuffled.
The table is written to the shared folder; ``decode`` reads the stored bytes back from it and describes them.

Null HTML gives an empty sequence, as does empty HTML. Script, style and template contents are
dropped. Very long documents are parsed whole. A reference without a digest stays in the sequence, unresolved, as does one whose digest
the media table lacks. Rows of the media table with one digest count as copies of each other.
Repeated documents, null ids and equal ids each get a row: rows are told apart by their place in a table that is written. Columns of any name
pass through ``parse`` and ``interleave``, but for the items and those that begin with ``__sm_``. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, add_columns, bytes_of, checkpoint, heavy_keys, salted_join, slices, texts_of, written

ROW = 192
SCHEME = "sha256:"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_IDAT = 1 << 20
#: Digests that a task remembers to have stored.
REMEMBERED = 100_000

_BREAKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split())
_SKIPPED = frozenset(("script", "style", "template", "noscript"))
_MEDIA = frozenset(("img", "audio", "video", "source", "embed"))

ITEM = T.StructType([T.StructField("pos", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("kind", "text", "digest", "caption")]])


class _Sequence(HTMLParser):
    """Collects the items of a document in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.skip = 0
        self.figures: list[dict] = []  # open figures: their references and their caption's text

    def _close_run(self) -> None:
        text = "".join(self.run)
        self.run = []
        if text.strip():
            self.items.append({"kind": "text", "text": text.strip(), "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SKIPPED:
            self.skip += 1
        elif not self.skip and tag in _MEDIA:
            own = dict(attrs)
            source = own.get("src") or ""
            if not source and tag in ("audio", "video"):
                return  # its sources follow
            self._close_run()
            item = {"kind": tag, "text": own.get("alt"), "digest": source[len(SCHEME) :].lower() if source.startswith(SCHEME) else None, "caption": None}
            self.items.append(item)
            if self.figures:
                self.figures[-1]["items"].append(item)
        elif not self.skip and tag in _BREAKS:
            if not (self.figures and self.figures[-1]["open"]):
                self._close_run()
            if tag == "figure":
                self.figures.append({"items": [], "caption": [], "open": False})
            elif tag == "figcaption" and self.figures:
                self.figures[-1]["open"] = True

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and tag in _BREAKS:
            if tag == "figcaption" and self.figures:
                self.figures[-1]["open"] = False
            elif tag == "figure" and self.figures:
                self._close_figure()
            elif not (self.figures and self.figures[-1]["open"]):
                self._close_run()

    def _close_figure(self) -> None:
        self._close_run()
        figure = self.figures.pop()
        caption = " ".join("".join(figure["caption"]).split()) or None
        for item in figure["items"]:
            item["caption"] = caption

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.figures[-1]["caption"] if self.figures and self.figures[-1]["open"] else self.run).append(data)

    def done(self) -> list[dict]:
        self.close()
        while self.figures:
            self._close_figure()
        self._close_run()
        return [{"pos": k, **item} for k, item in enumerate(self.items)]


def sequence(html: str | None) -> list[dict]:
    if not html:
        return []
    parser = _Sequence()
    parser.feed(html)
    return parser.done()


def parse(df: DataFrame, html_col: str = "html", out: str = "items", drop: tuple[str, ...] = ()) -> DataFrame:
    """Append the ordered items of each document, without the columns in ``drop``."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), *[(n, pa.string()) for n in ITEM.names[1:]]]))

    def compute():
        return lambda batch: [pa.array([sequence(h) for h in texts_of(batch, html_col)], kind)]

    return add_columns(df, [T.StructField(out, T.ArrayType(ITEM))], compute, drop)


def references(parsed: DataFrame, id_col: str = "doc_id", items: str = "items") -> DataFrame:
    """(id, pos, digest, caption) of each reference that has a digest."""
    some = F.filter(F.col(items), lambda x: (x["kind"] != "text") & x["digest"].isNotNull())
    return parsed.select(id_col, F.explode(some).alias("x")).select(id_col, F.col("x.pos"), F.col("x.digest"), F.col("x.caption"))


def resolve(refs: DataFrame, media: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """References with ``columns`` of the media rows that have their digest, null where none has."""
    refs = checkpoint(refs)
    found = media.groupBy("digest").agg(*[F.first(c).alias(c) for c in columns])
    counts = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return salted_join(refs, found, "digest", heavy_keys(counts, "digest", "n", refs.count()), F.concat_ws(",", id_col, "pos"))


def interleave(parsed: DataFrame, media: DataFrame, columns: list[str], items: str = "items") -> DataFrame:
    """``parsed`` with ``columns`` of the media row in each item, under ``media`` (null where there is none)."""
    row, hits = f"{OWN}row", f"{OWN}hits"
    rows = written(parsed.withColumn(row, F.monotonically_increasing_id()))
    refs = resolve(references(rows, row, items), media, columns, row)
    found = refs.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct(*columns)))).alias(hits))
    whole = F.transform(F.col(items), lambda x: x.withField("media", F.try_element_at(F.col(hits), x["pos"])))
    return rows.join(found, row, "left").withColumn(items, whole).drop(row, hits)


def padded(text: Column) -> Column:
    """A text's UTF-8 bytes with spaces up to a positive multiple of ROW."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(data)
    return F.rpad(data, (F.greatest(F.ceil(size / ROW), F.lit(1)) * ROW).cast("int"), F.lit(" ").cast("binary"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes) -> bytes:
    """A payload whose length is a positive multiple of ROW, as a PNG."""
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(height, ROW)
    data = zlib.compress(rows.tobytes(), 1)
    out = [_SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, height, 8, 2, 0, 0, 0))]
    out += [_chunk(b"IDAT", data[k : k + _IDAT]) for k in range(0, len(data), _IDAT)]
    return b"".join([*out, _chunk(b"IEND", b"")])


def decode_png(media: bytes) -> bytes:
    """The samples of a PNG that ``encode_png`` wrote; raises on a damaged one."""
    if media[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, data, size = 8, [], (0, 0)
    while at < len(media):
        (length,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + length]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + length)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(size[1], size[0] * 3 + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def describe(payload: bytes) -> str:
    """Size, mean and spread of the samples and their entropy in bits, as a short text."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    n, values = counts.sum(), np.arange(256)
    mean = float((counts * values).sum() / n)
    spread = float(np.sqrt(max(0.0, (counts * values * values).sum() / n - mean * mean)))
    share = counts[counts > 0] / n
    return f"64x{len(payload) // ROW} mean={mean:.4f} std={spread:.4f} entropy={float(-(share * np.log2(share)).sum()):.4f}"


def encode(payloads: DataFrame, payload_col: str = "payload", digest_col: str = "digest") -> DataFrame:
    """(digest, media): the stored form of each payload, a digest at most once a task as long as it is remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for whole in batches:
            for batch in slices(whole):
                digests, media = [], []
                for digest, payload in zip(texts_of(batch, digest_col), bytes_of(batch, payload_col), strict=True):
                    if digest not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(digest)
                        digests.append(digest)
                        media.append(encode_png(payload))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    return payloads.select(digest_col, payload_col).mapInArrow(run, "digest string, media binary")


_READ = [("payload_bytes", pa.int64(), T.LongType()), ("payload_sha256", pa.string(), T.StringType()), ("tail_crc32", pa.int64(), T.LongType()), ("media_bytes", pa.int64(), T.LongType()), ("media_sha256", pa.string(), T.StringType()), ("feature", pa.string(), T.StringType())]


def _read_back(stored: bytes) -> tuple:
    payload = decode_png(stored)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(payload)


def decode(media: DataFrame, media_col: str = "media") -> DataFrame:
    """``media`` with what the stored bytes hold, read back, in their place: sizes, hashes and the feature."""

    def compute():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [_read_back(data) for data in bytes_of(batch, media_col)]
            return [pa.array([r[k] for r in found], kind) for k, (_, kind, _) in enumerate(_READ)]

        return work

    return add_columns(media, [T.StructField(name, kind) for name, _, kind in _READ], compute, (media_col,))


def of_texts(docs: DataFrame) -> DataFrame:
    """Documents rendered as HTML with their own bytes as the picture, parsed, stored and interleaved.

    (doc_id, n_bytes, what ``decode`` gives, and how the sequence lies: its items, the picture's position and caption.) The text runs
    themselves aren't needed here; their MD5 stands for them.
    """
    thin = docs.select("doc_id", "text").withColumn("payload", padded(F.col("text"))).withColumn("digest", F.sha2("payload", 256))
    store = written(encode(thin))
    html = F.concat(F.lit("<article><p>"), escaped(F.col("text")), F.lit(f'</p><figure><img src="{SCHEME}'), F.col("digest"), F.lit('"><figcaption>'), F.octet_length(F.coalesce("text", F.lit(""))).cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    parsed = parse(thin.select("doc_id", html.alias("html")), "html", drop=("html",))
    parsed = parsed.withColumn("items", F.transform("items", lambda x: x.withField("text", F.md5(x["text"].cast("binary")))))
    names = [n for n, _, _ in _READ]
    whole = interleave(parsed, decode(store), names).withColumn("x", F.element_at(F.filter("items", lambda x: x["kind"] == "img"), 1))
    runs = F.array_join(F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"]), ",")
    return whole.select(
        "doc_id", F.regexp_extract("x.caption", "^([0-9]+) bytes$", 1).cast("long").alias("n_bytes"), *[F.col(f"x.media.{n}").alias(n) for n in names],
        F.size("items").cast("long").alias("n_items"), F.col("x.pos").alias("media_pos"), F.col("x.caption").alias("caption"), runs.alias("text_md5"), (F.col("x.digest") == F.col("x.media.payload_sha256")).alias("digest_matches"),
    )
