"""Cards and links of landed pages as table functions: a page is read in pieces, its rows go out as their elements end.

Neither the page's tree nor a list of its rows is ever held, only the open elements and the one being read, so a page with a
million links costs no more than its text. The functions take a table and give Arrow batches as they read: Spark's lateral joins
don't take Arrow table functions, and others collect the rows of a page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pages import Node, _Builder, card_of, card_rows, index_entries, pager_numbers

#: Characters of a page that the parser gets at a time, and rows of a batch that goes out.
PIECE, ROWS = 1 << 18, 1 << 12


class _Passing(_Builder):
    """Builds the subtrees of wanted elements and forgets everything else as soon as it ends."""

    def __init__(self, wanted: Callable[[Node], bool]) -> None:
        super().__init__()
        self.wanted, self.count = wanted, 0
        self.open: dict[Node, int] = {}
        self.ended: list[tuple[int, Node]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._added(lambda: super(_Passing, self).handle_starttag(tag, attrs))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._added(lambda: super(_Passing, self).handle_startendtag(tag, attrs))

    def _added(self, add: Callable[[], None]) -> None:
        before = self.at
        add()
        # the parser may have ended one element, and the new one stands last in its parent
        parent = self.at if self.at is before or self.at is before.parent else self.at.parent
        node = parent.children[-1]
        if parent is not before:
            kept = parent.children.pop()
            self._left(before)
            parent.children.append(kept)
        if self.wanted(node):
            self.open[node] = self.count
            self.count += 1
        if self.at is not node:
            self._left(node)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        super().handle_endtag(tag)
        while node is not self.at:
            self._left(node)
            node = node.parent

    def handle_data(self, data: str) -> None:
        if self.open:
            super().handle_data(data)

    def _left(self, node: Node) -> None:
        if node in self.open:
            self.ended.append((self.open.pop(node), node))
        if not self.open and node.parent is not None:
            node.parent.children.clear()

    def taken(self) -> list[tuple[int, Node]]:
        ended, self.ended = self.ended, []
        return ended


def elements(html: str | None, wanted: Callable[[Node], bool], piece: int = PIECE) -> Iterator[tuple[int, Node]]:
    """(number, element) of the wanted elements as they end, numbered as they begin; inner ones come before outer ones."""
    parser = _Passing(wanted)
    for a in range(0, len(html or ""), piece):
        parser.feed(html[a : a + piece])
        yield from parser.taken()
    parser.close()
    yield from parser.taken()
    while parser.at is not parser.root:  # what the page never ends
        node, parser.at = parser.at, parser.at.parent
        parser._left(node)
        yield from parser.taken()


def _in_grid(node: Node) -> bool:
    while (node := node.parent) is not None:
        if node.has_class("grid-items"):
            return True
    return False


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _listing_rows(html: str | None) -> Iterator[dict]:
    """A row a card, and one a page number of the pager."""
    for pos, node in elements(html, lambda n: n.has_class("pagination") or (n.has_class("poster") and _in_grid(n))):
        if node.has_class("pagination"):
            yield from ({"page": number} for number in pager_numbers(node))
        if node.has_class("poster") and _in_grid(node):
            yield {"pos": pos, **card_of(node)}


def _link_rows(html: str | None) -> Iterator[dict]:
    for pos, node in elements(html, lambda n: n.tag == "a"):
        yield {"pos": pos, "href": node.attrs.get("href"), "label": node.text()}


_CARDS = "page_id string, pos int, page string, href string, title string, author string, duration string, votes string, ratings string, cover string"
_LINKS = "page_id string, pos int, href string, label string"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _rows_of(batch: pa.RecordBatch, rows: Callable[[str | None], Iterator[dict]], ddl: str) -> Iterator[pa.RecordBatch]:
    pages = batch.column(0) if pa.types.is_struct(batch.schema.field(0).type) else batch.to_struct_array()
    ids, texts = pages.flatten()[:2]
    for k in range(len(pages)):
        page_id = ids[k].as_py()
        page = None if page_id is None else str(page_id)
        yield from _batches(({"page_id": page, **row} for row in rows(texts[k].as_py())), _schema(ddl))


class _Cards:
    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return _rows_of(batch, _listing_rows, _CARDS)


class _Links:
    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return _rows_of(batch, _link_rows, _LINKS)


#: Table functions of landed pages, a table of (page id, html): cards and pager numbers of listings; links.
page_cards = F.arrow_udtf(_Cards, returnType=_CARDS)
page_links = F.arrow_udtf(_Links, returnType=_LINKS)


def register(spark: SparkSession) -> None:
    """The table functions for SQL: ``page_cards(TABLE(SELECT page_id, html FROM ...))`` and ``page_links``. Ids come back as text."""
    spark.udtf.register("page_cards", page_cards)
    spark.udtf.register("page_links", page_links)


def _through(function: Callable, pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    rows = function(pages.select(id_col, html_col).asTable())
    return rows.withColumn("page_id", F.col("page_id").cast(pages.schema[id_col].dataType)).withColumnRenamed("page_id", id_col)


def listings(pages: DataFrame, base: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The rows of ``pages.parse_listings``, of pages of any size.

    Page ids are the pages' keys; pages with a null id count as one page. A page without cards gives no row, nor does a null one.
    """
    rows = _through(page_cards, pages, id_col, html_col)
    last = rows.groupBy(id_col).agg(F.greatest(F.lit(1), F.max(F.col("page").try_cast("int"))).alias("last_page"))
    names = [c for c in rows.columns if c not in (id_col, "pos", "page")]
    cards = rows.filter("pos is not null").select(id_col, "pos", F.struct(*names).alias("card"))
    return card_rows(cards, base, id_col).join(last.withColumnRenamed(id_col, "__of"), F.col(id_col).eqNullSafe(F.col("__of"))).drop("__of")


def entries(pages: DataFrame, kind: str, base: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The rows of ``pages.parse_index``, of pages of any size."""
    return index_entries(_through(page_links, pages, id_col, html_col), kind, base, id_col)
