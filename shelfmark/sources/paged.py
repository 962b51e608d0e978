"""Result pages of libraries as a data source: ``library_pages``.

Landed responses lie as <root>/library=<id>/page=<n>/<file>, a response a file. A partition is a library and a range of pages; filters on the library are pushed
down, so other libraries' folders aren't listed. A library ends with its first page that is short or missing, and after page ``lastPage`` if that is given.

``load`` reads a library in two passes: where each range has its first short page, then the pages up to a library's first one; so every page is read twice
at most. A bare load of the format doesn't know the ends, so a range first counts the pages before it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .library import PAGE_SIZE

#: Pages of a partition.
RANGE = 64
SCHEMA = "library string, page int, json string"


@dataclass
class PageRange(InputPartition):
    library: str
    first: int
    end: int


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.size, self.range = (int(options.get(k, d)) for k, d in (("size", PAGE_SIZE), ("range", RANGE)))
        self.last = int(options["lastpage"]) if "lastpage" in options else None
        # the first short page of each library that has one before its last, where they are known already
        self.ends: dict[str, int] | None = json.loads(options["ends"]) if "ends" in options else None
        self.scan = options.get("scan") == "ends"
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            named = {str(f.value)} if isinstance(f, EqualTo) and f.attribute == ("library",) else {str(v) for v in f.value} if isinstance(f, In) and f.attribute == ("library",) else None
            if named is None:
                yield f
            else:
                self.wanted = named if self.wanted is None else self.wanted & named

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def _names(self, folder: str, prefix: str) -> list[str]:
        from pyarrow import fs

        system, _ = self._files()
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [unquote(f.base_name.removeprefix(prefix)) for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(prefix)]

    def partitions(self) -> list[PageRange]:
        _, root = self._files()
        libraries = sorted(self.wanted) if self.wanted is not None else sorted(self._names(root, "library="))
        out = []
        for library in libraries:
            pages = [int(p) for p in self._names(f"{root}/library={quote(library)}", "page=")]
            last = min([max(pages, default=-1), *([] if self.last is None else [self.last]), *([self.ends[library]] if library in (self.ends or {}) else [])])
            out += [PageRange(library, a, min(a + self.range, last + 1)) for a in range(0, last + 1, self.range)]
        return out or [PageRange("", 0, 0)]

    def _results(self, library: str, page: int) -> list:
        """The items of one landed response; none where it is missing or malformed."""
        from pyarrow import fs

        system, root = self._files()
        for f in system.get_file_info(fs.FileSelector(f"{root}/library={quote(library)}/page={page}", allow_not_found=True)):
            if f.is_file and not f.base_name.startswith((".", "_")):
                with system.open_input_stream(f.path) as data:
                    try:
                        told = json.loads(data.read())
                    except ValueError:
                        return []
                    return (told.get("results") if isinstance(told, dict) else None) or []
        return []

    def read(self, partition: PageRange) -> Iterator[tuple]:
        if self.scan:
            short = next((p for p in range(partition.first, partition.end) if len(self._results(partition.library, p)) < self.size), None)
            if short is not None:
                yield partition.library, short, None
            return
        if self.ends is None and any(len(self._results(partition.library, p)) < self.size for p in range(partition.first)):
            return
        for page in range(partition.first, partition.end):
            results = self._results(partition.library, page)
            for item in results:
                yield partition.library, page, json.dumps(item, ensure_ascii=False)
            if len(results) < self.size:
                return


class LibraryPages(DataSource):
    """``spark.read.format("library_pages").load(root)``; options size, lastPage and range; see ``load`` for ends and scan."""

    @classmethod
    def name(cls) -> str:
        return "library_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with push-down of its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LibraryPages)


def load(spark: SparkSession, root: str, libraries: Sequence[str] | None = None, **options: str) -> DataFrame:
    """The items of libraries (all, if none are named), each up to its first short page; what reaches the driver is one page number a library."""
    register(spark)

    def read(**more: str) -> DataFrame:
        rows = spark.read.format("library_pages").options(**options, **more).load(root)
        return rows if libraries is None else rows.filter(F.col("library").isin(*libraries))

    ends = read(scan="ends").groupBy("library").agg(F.min("page").alias("end")).collect()
    return read(ends=json.dumps({r["library"]: r["end"] for r in ends}))
