"""Paged files as a data source, in batch and as a stream: pages are parsed where and when they are asked for.

    spark.dataSource.register(PagedFiles)
    spark.read.format("paged").option("path", "/data/*.pdf").option("parser", "package.module:function").load()

The parser is any importable function (path, first, last) -> pairs of a page number and its text, for the pages first..last of a file, last being None
for the end; it should not touch other pages. One partition reads one file, or part of its pages where `pages_per_task` is given and a function
named by `counter` (path -> number of pages) tells their number.

Filters on page_no and doc_id are pushed down: files whose doc_id can't match are never opened, and the parser is only asked for pages in the
wanted range. A stream takes each file once, in the order of its name, among those that are there when a batch begins; its offset is the number of
names seen so far and the last of them, so files must arrive under names that sort after the earlier ones (as dated names do).

Paths are globs on a file system that the driver and all executors mount; for other stores read with binaryFile and readers.binary_pages.
"""

from __future__ import annotations

import glob
import importlib
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "doc_id string, page_no int, text string, token_count int"


def load(name: str) -> Callable:
    """The function named module:function."""
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"{name!r} is no module:function")
    return getattr(importlib.import_module(module), function)


def document_id(path: str) -> str:
    """A file's id: its path without the last suffix, so that equal names in two folders stay two documents."""
    return os.path.splitext(path)[0]


@dataclass
class Pages(InputPartition):
    """Pages first..last of a file; last None: to its end."""

    path: str
    first: int
    last: int | None

    def __post_init__(self) -> None:
        super().__init__(self.path)


class _Files:
    """What batch and stream share: options, files and the parsing of one partition."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options or "parser" not in options:
            raise ValueError("a paged source needs the options path and parser")
        self.pattern, self.parser, self.counter = options["path"], options["parser"], options.get("counter")
        self.each = int(options.get("pages_per_task", "0"))
        if self.each and not self.counter:
            raise ValueError("pages_per_task needs a counter")
        self.first, self.last, self.ids = 1, None, None

    def files(self) -> list[str]:
        return sorted(p for p in glob.glob(self.pattern, recursive=True) if os.path.isfile(p))

    def pieces(self, paths: Iterable[str]) -> list[Pages]:
        out = []
        for path in paths:
            if self.ids is not None and document_id(path) not in self.ids:
                continue
            if not self.each:
                out.append(Pages(path, self.first, self.last))
                continue
            end = load(self.counter)(path)
            end = end if self.last is None else min(end, self.last)
            out += [Pages(path, a, min(a + self.each - 1, end)) for a in range(self.first, end + 1, self.each)]
        return out

    def narrow(self, f: Filter) -> bool:
        """Take a filter over into the range of pages or the set of documents; whether nothing of it is left to check."""
        column = getattr(f, "attribute", None)
        if column == ("page_no",) and not isinstance(f, In) and getattr(f, "value", None) is not None:
            low = {EqualTo: 0, EqualNullSafe: 0, GreaterThan: 1, GreaterThanOrEqual: 0}.get(type(f))
            high = {EqualTo: 0, EqualNullSafe: 0, LessThan: -1, LessThanOrEqual: 0}.get(type(f))
            if low is not None:
                self.first = max(self.first, int(f.value) + low)
            if high is not None:
                top = int(f.value) + high
                self.last = top if self.last is None else min(self.last, top)
            return low is not None or high is not None
        if column == ("doc_id",) and isinstance(f, (EqualTo, EqualNullSafe, In)):
            wanted = set(f.value) if isinstance(f, In) else {f.value}
            self.ids = wanted if self.ids is None else self.ids & wanted
            return True
        return False

    def rows(self, part: Pages) -> Iterator[tuple]:
        if part.last is not None and part.last < part.first:
            return
        doc_id = document_id(part.path)
        for page, text in load(self.parser)(part.path, part.first, part.last):
            if page >= part.first and (part.last is None or page <= part.last):
                yield doc_id, page, text, len(text or "") // 4


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.held = _Files(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.held.narrow(f)]

    def partitions(self) -> list[Pages]:
        return self.held.pieces(self.held.files())

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.held.rows(partition)


class PagedStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.held = _Files(options)

    def initialOffset(self) -> dict:
        return {"n": 0, "last": ""}

    def latestOffset(self) -> dict:
        files = self.held.files()
        return {"n": len(files), "last": files[-1] if files else ""}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.held.pieces(p for p in self.held.files() if start["last"] < p <= end["last"])

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.held.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(dict(self.options))


def register(spark) -> None:
    """Make the format `paged` known, with filters pushed down to it."""
    spark.dataSource.register(PagedFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
