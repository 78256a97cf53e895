"""Files as tables: listings, decoded texts, byte profiles, document pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrec.functions.replies import is_json
from textrec.operators.tables import concat_tables

# Encodings in the order they are tried, and the bytes a profile shows.
UTF8, LATIN1 = "utf-8", "latin-1"
PROFILE_BYTES = 100

# Pages handed back to Spark at a time.
PAGES_PER_FRAME = 64

PAGE_SCHEMA = "doc string, page int, text string, error string"


def glob_pattern(glob: str) -> str:
    """The regular expression of a pattern whose ``*`` stays within a level of folders."""
    parts = {"*": "[^/]*", "?": "[^/]"}
    return "".join(parts.get(c, re.escape(c)) for c in glob)


def binary_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Files below ``folder`` whose relative path matches ``glob``; none if the folder is missing.

    ``*`` stays within one folder level, so ``*.pdf`` gives no files of
    sub-folders and lists only ``folder`` itself. Folder names like ``a=b`` are not taken for partitions.
    """
    root = folder.rstrip("/")
    plain = "".join(f"\\{c}" if c in "[]{}" else c for c in glob)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        files = reader.load(f"{root}/{plain}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    # A folder that matches the pattern is listed too; its files lie deeper than the pattern says.
    store = "([A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?)?"
    named = re.sub(f"^{store}", "", root)
    start = f"^{store}" if named.startswith("/") else "/"
    return files.where(F.col("path").rlike(f"{start}{re.escape(named)}/{glob_pattern(glob)}$"))


def list_files(spark: SparkSession, folder: str, *globs: str) -> DataFrame:
    """``(glob_no, path, name, length)`` of matching files; contents are not read.

    Several patterns give their lists one after the other; ``glob_no`` tells
    them apart and a file that matches two of them is listed twice.
    """
    lists = [
        binary_files(spark, folder, g).select(
            F.lit(i).alias("glob_no"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), "length"
        )
        for i, g in enumerate(globs)
    ]
    return concat_tables(*lists)


def decode_text(df: DataFrame, col: str = "content") -> DataFrame:
    """Adds ``text`` and ``encoding``: UTF-8 if the bytes are valid, else Latin-1.

    ``encoding`` is null when the text is not JSON in either.
    """
    raw = F.col(col)
    valid = F.is_valid_utf8(raw)
    text = F.when(valid, F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))
    decoded = df.withColumn("text", text)
    name = F.when(valid, F.lit(UTF8)).otherwise(F.lit(LATIN1))
    return decoded.withColumn("encoding", F.when(is_json("text"), name))


def binary_profile(df: DataFrame, n: int = PROFILE_BYTES, col: str = "content") -> DataFrame:
    """Size and first ``n`` bytes, as hex, of the files no encoding turned into JSON."""
    unread = df.where(F.col("encoding").isNull())
    start = F.substring(col, 1, n)
    return unread.select(
        "path",
        F.length(col).cast("bigint").alias("size"),
        F.length(start).alias("shown"),
        F.lower(F.hex(start)).alias("first_hex"),
    )


def extract_pages(files: DataFrame, extractor: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """``(doc, page, text, error)`` from ``(path, content)``.

    ``extractor`` yields the page texts of one document. If it fails, the pages
    read so far stay and one more row carries the error and no text.
    """

    def pages_of(name: str, content: bytes) -> Iterator[tuple]:
        page = 0
        try:
            for text in extractor(content):
                page += 1
                yield name, page, text, None
        except Exception as error:
            yield name, page + 1, None, f"{type(error).__name__}: {error}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in PAGE_SCHEMA.split(", ")]
        for frame in frames:
            rows: list[tuple] = []
            for name, content in zip(frame["doc"], frame["content"]):
                for row in pages_of(name, content):
                    rows.append(row)
                    if len(rows) == PAGES_PER_FRAME:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    named = files.select(F.element_at(F.split("path", "/"), -1).alias("doc"), "content")
    return named.mapInPandas(run, PAGE_SCHEMA)
