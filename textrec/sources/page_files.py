"""Pages of document files as a Python data source: a partition for a range of files, pages handed on as they are read."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textrec.shared import file_place
from textrec.sources.files import PAGES_PER_FRAME, glob_pattern

# Bytes of files that one task reads; a larger file is a task of its own.
BYTES_PER_TASK = 64 << 20

# Characters of pages handed back to Spark at a time.
CHARS_AT_ONCE = 4 << 20

PAGES = "doc string, page int, text string, error string"
NAMES = [field.split()[0] for field in PAGES.split(", ")]
KINDS = [pa.string(), pa.int32(), pa.string(), pa.string()]

Extractor = Callable[[pa.NativeFile], Iterable[str]]


class FileRange(InputPartition):
    """Files that follow each other in order of path."""

    def __init__(self, root: str, names: list[str]):
        super().__init__(None)
        self.root, self.names = root, names


class PageReader(DataSourceReader):
    """Lists the files once, in the planner, and reads a range of them in each task."""

    def __init__(self, folder: str, glob: str, bytes_per_task: int, extractor: Extractor, first: int | None = None):
        self.folder, self.glob, self.bytes_per_task, self.extractor, self.first = folder, glob, bytes_per_task, extractor, first

    def partitions(self) -> list[FileRange]:
        system, root = file_place(self.folder.rstrip("/"))
        every = system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
        wanted = re.compile(glob_pattern(self.glob))
        files = sorted((f.path[len(root) :].lstrip("/"), f.size or 0) for f in every if f.is_file)
        named = [(name, size) for name, size in files if wanted.fullmatch(name)]
        ranges: list[list[str]] = []
        room = 0
        for name, size in named[: self.first]:
            if not ranges or size > room:
                ranges.append([])
                room = self.bytes_per_task
            ranges[-1].append(name)
            room -= size
        return [FileRange(self.folder, names) for names in ranges] or [FileRange(self.folder, [])]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        system, root = file_place(partition.root.rstrip("/"))
        for name in partition.names:
            for row in self._pages(system, root, name):
                rows.append(row)
                size += len(row[2] or "")
                if len(rows) == PAGES_PER_FRAME or size >= CHARS_AT_ONCE:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _pages(self, system: pyarrow.fs.FileSystem, root: str, name: str) -> Iterator[tuple]:
        page = 0
        try:
            with system.open_input_file(f"{root}/{name}") as file:
                for text in self.extractor(file):
                    page += 1
                    yield name, page, text, None
        except Exception as error:
            yield name, page + 1, None, f"{type(error).__name__}: {error}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), KINDS)], NAMES)


def page_source(extractor: Extractor) -> type[DataSource]:
    """A data source of ``(doc, page, text, error)`` that takes files apart with ``extractor``.

    ``extractor`` gets an open file, which it may read in pieces and move about
    in, and yields the texts of the pages. Options: ``path``, a folder; ``glob``,
    a pattern for paths below it in which ``*`` stays within a level;
    ``bytesPerTask``; and ``first``, to read only so many files, in order of path.
    """
    kind = f"textrec_pages_{uuid.uuid4().hex}"

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return PAGES

        def reader(self, schema) -> DataSourceReader:
            size = int(self.options.get("bytesPerTask", BYTES_PER_TASK))
            first = self.options.get("first")
            return PageReader(self.options["path"], self.options.get("glob", "*"), size, extractor, int(first) if first else None)

    return Pages


def read_pages(spark: SparkSession, folder: str, glob: str, extractor: Extractor, bytes_per_task: int = BYTES_PER_TASK, first: int | None = None) -> DataFrame:
    """``(doc, page, text, error)`` of the files below ``folder`` that match ``glob``, or the ``first`` of them; ``doc`` is the path from there.

    No file is ever one row: a task opens one file of its range after the other
    and hands pages on some at a time. If the extractor fails, the pages read so
    far stay and one more row carries the error and no text. Pages are read anew
    each time the table is used; a missing folder has none. Files are opened with
    ``pyarrow.fs``; ``extract_pages`` is for stores that only Spark reads.
    """
    source = page_source(extractor)
    spark.dataSource.register(source)
    options = {"glob": glob, "bytesPerTask": str(bytes_per_task), **({"first": str(first)} if first else {})}
    return spark.read.format(source.name()).options(**options).load(folder)
