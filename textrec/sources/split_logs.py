"""JSON documents of any size read by many tasks: the elements of one list in them, a row each."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textrec.session import stored
from textrec.sources.logs import RESULTS

# Bytes of elements handed back to Spark at a time.
BYTES_AT_ONCE = 4 << 20

QUOTE, BACKSLASH, COMMA = ord('"'), ord("\\"), ord(",")
STEP = np.zeros(256, np.int64)
for _c, _step in (("{", 1), ("[", 1), ("}", -1), ("]", -1)):
    STEP[ord(_c)] = _step

# What a split does to a reader that begins outside a string (0) or within one (1).
SUMMARY = "file string, split long, size long, bytes long, odd int, " + ", ".join(f"delta{s} long, least{s} long, opens{s} array<struct<depth: long, least: long>>" for s in (0, 1))
STATE = "file string, split long, inside int, depth long, within boolean, error string"
FRAGMENT = "file string, split long, place long, begins boolean, ends boolean, fragment binary"

OPENS = pa.list_(pa.struct([("depth", pa.int64()), ("least", pa.int64())]))
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<struct<depth: long, least: long>>": OPENS}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(field.split(" ", 1)[0], ARROW[field.split(" ", 1)[1]]) for field in re.split(r", (?![^<]*>)", schema)])


def _pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The files cut after every ``}``, which Spark can do from any place of a file on: ``(file, split, size, piece)``.

    A split is known by the byte it begins at; its rows come in order.
    """
    cut = spark.read.option("lineSep", "}").text(paths)
    at = [F.col(f"_metadata.{n}").alias(a) for n, a in (("file_path", "file"), ("file_block_start", "split"), ("file_size", "size"))]
    return cut.select(*at, F.col("value").cast("binary").alias("piece"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray]]:
    """The rows of each split in a batch: what they share, and their bytes."""
    files, splits = batch.column("file").to_pylist(), batch.column("split").to_pylist()
    begin = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or (files[i], splits[i]) != (files[begin], splits[begin]):
            shared = {name: batch.column(name)[begin].as_py() for name in batch.schema.names if name != "piece"}
            pieces = batch.column("piece").slice(begin, i - begin).to_pylist()
            yield shared, np.frombuffer(b"}".join([*pieces, b""]), np.uint8)
            begin = i


def _quotes(text: np.ndarray) -> np.ndarray:
    """How many quotes that are not escaped stand before or at each byte. A split begins after ``}``, so no escape reaches into it."""
    at = np.arange(len(text))
    plain = np.maximum.accumulate(np.where(text != BACKSLASH, at, -1))
    before = np.r_[-1, plain[:-1]]  # the last byte before this one that is no backslash
    return np.cumsum((text == QUOTE) & ((at - 1 - before) % 2 == 0))


def _opens(text: np.ndarray, field: str, quotes: np.ndarray) -> list[tuple[int, int]]:
    """``(bracket, parity)`` of each place where a list begins under the field's name: readable if the string state there is even with it."""
    name = re.escape(json.dumps(field).encode())
    return [(m.end() - 1, int(quotes[m.start()] - 1) % 2) for m in re.finditer(name + rb"[ \t\r\n]*:[ \t\r\n]*\[", text.tobytes())]


class _Summary:
    """Sums over a split, for both states that it may begin in."""

    def __init__(self, shared: dict):
        self.shared, self.bytes, self.odd = shared, 0, 0
        self.delta, self.least, self.opens = [0, 0], [0, 0], ([], [])

    def add(self, text: np.ndarray, field: str) -> None:
        quotes = _quotes(text)
        opens = _opens(text, field, quotes)
        for s in (0, 1):
            outside = (quotes + self.odd + s) % 2 == 0
            depth = self.delta[s] + np.cumsum(np.where(outside, STEP[text], 0))
            lowest = int(depth.min(initial=self.delta[s]))
            self.opens[s][:] = [(d, min(low, lowest)) for d, low in self.opens[s]]
            self.opens[s].extend((int(depth[i]), int(depth[i:].min())) for i, parity in opens if (parity + self.odd + s) % 2 == 0)
            self.least[s] = min(self.least[s], lowest)
            self.delta[s] = int(depth[-1]) if len(depth) else self.delta[s]
        self.bytes += len(text)
        self.odd = (self.odd + int(quotes[-1]) if len(quotes) else self.odd) % 2

    def row(self) -> dict:
        out = {**self.shared, "bytes": self.bytes, "odd": self.odd}
        for s in (0, 1):
            out |= {f"delta{s}": self.delta[s], f"least{s}": self.least[s], f"opens{s}": [{"depth": d, "least": low} for d, low in self.opens[s]]}
        return out


def _summaries(pieces: DataFrame, field: str) -> DataFrame:
    kinds = _arrow(SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for shared, text in _runs(batch):
                if now is not None and now.shared != shared:
                    yield pa.RecordBatch.from_pylist([now.row()], kinds)
                    now = None
                now = now or _Summary(shared)
                now.add(text, field)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], kinds)

    return pieces.mapInArrow(run, SUMMARY)


def _states(table: pa.Table) -> pa.Table:
    """From the summaries of a file's splits the state that each of them begins in; the first has the error of the whole, if any."""
    inside, depth, within, read, rows = 0, 0, False, 0, []
    for x in sorted(table.to_pylist(), key=lambda r: r["split"]):
        rows.append({"file": x["file"], "split": x["split"], "inside": inside, "depth": depth, "within": within, "error": None})
        if within:
            within = depth + x[f"least{inside}"] >= 2
        for o in x[f"opens{inside}"]:
            if depth + o["depth"] == 2:
                within = depth + o["least"] >= 2
        depth, inside, read = depth + x[f"delta{inside}"], (inside + x["odd"]) % 2, read + x["bytes"]
    # After the last piece of a file that does not end there, a brace was counted that it does not have.
    depth += read > x["size"]
    if inside or depth:
        rows[0]["error"] = "the file ends within a text" if inside else f"the file ends {depth} levels deep"
    return pa.Table.from_pylist(rows, _arrow(STATE))


class _Elements:
    """Cuts the list's elements out of a split that begins in a known state."""

    def __init__(self, shared: dict):
        self.at = {"file": shared["file"], "split": shared["split"]}
        self.inside, self.depth, self.within = shared["inside"], shared["depth"], shared["within"]
        self.left: list[bytes] = []
        self.begins, self.place = False, 0

    def _row(self, last: bytes, ends: bool) -> dict:
        row = {**self.at, "place": self.place if self.begins else -1, "begins": self.begins, "ends": ends, "fragment": b"".join([*self.left, last])}
        self.place += self.begins
        self.left, self.begins = [], True
        return row

    def add(self, text: np.ndarray, field: str) -> Iterator[dict]:
        quotes = _quotes(text)
        outside = (quotes + self.inside) % 2 == 0
        depth = self.depth + np.cumsum(np.where(outside, STEP[text], 0))
        opens = {i for i, parity in _opens(text, field, quotes) if (parity + self.inside) % 2 == 0 and depth[i] == 2}
        ends = np.flatnonzero(outside & (((text == COMMA) & (depth == 2)) | ((text == ord("]")) & (depth == 1))))
        whole, start = text.tobytes(), 0
        for i in sorted([*ends.tolist(), *opens]):
            if i in opens:
                self.within, self.begins, self.left, start = True, True, [], i + 1
            elif self.within:
                yield self._row(whole[start:i], True)
                self.within, start = whole[i] == COMMA, i + 1
        if self.within:
            self.left.append(whole[start:])
        if len(text):
            self.inside, self.depth = int(self.inside + quotes[-1]) % 2, int(depth[-1])

    def finish(self) -> Iterator[dict]:
        if self.within:
            yield self._row(b"", False)


def _fragments(pieces: DataFrame, field: str) -> DataFrame:
    kinds = _arrow(FRAGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, rows, size = None, None, [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, kinds)

        for batch in batches:
            for shared, text in _runs(batch):
                if key != (shared["file"], shared["split"]):
                    rows += now.finish() if now else ()
                    now, key = _Elements(shared), (shared["file"], shared["split"])
                for row in now.add(text, field):
                    rows.append(row)
                    size += len(row["fragment"])
                    if size >= BYTES_AT_ONCE:
                        yield made()
                        rows, size = [], 0
        rows += now.finish() if now else ()
        if rows:
            yield made()

    return pieces.mapInArrow(run, FRAGMENT)


def split_elements(spark: SparkSession, paths: str | list[str], field: str = "results") -> tuple[DataFrame, DataFrame]:
    """``(file_path, number, element)``, the elements of the list under ``field`` of each file's object; and ``(file_path, error)``.

    ``element`` is JSON, numbers count from 1. Files are read in Spark's splits,
    so a large one is read by many tasks, twice: first every split tells what it
    does to a reader's state (within a text or not, how deep, whether the list
    begins or ends) for both states it may begin in, one row each; put together
    file by file, these say how each split begins. Then every split cuts out its
    elements, and the fragments of those that reach over its ends, two at most,
    are joined. A file that does not end as a JSON document does gives no
    elements and is listed with the error; what lies between is not checked.
    """
    pieces = _pieces(spark, paths)
    summaries = stored(_summaries(pieces, field), "splits")
    states = stored(summaries.groupBy("file").applyInArrow(_states, STATE), "split-states")
    bad = states.where(F.col("error").isNotNull()).select("file", "error")
    good = states.drop("error").join(bad.select("file"), "file", "left_anti")
    # A row for each split of a file, which are as large as Spark's partitions; pieces stay in order.
    begun = pieces.join(F.broadcast(good), ["file", "split"])
    fragments = stored(_fragments(begun, field), "fragments")
    counts = fragments.groupBy("file", "split").agg(F.count_if("begins").alias("n"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    whole = fragments.where("begins AND ends").select("file", "split", "place", F.col("fragment").cast("string").alias("element"))
    order = Window.partitionBy("file").orderBy("split", F.col("place") >= 0, "place")
    parts = fragments.where("NOT (begins AND ends)").withColumn("chain", F.sum(F.col("begins").cast("int")).over(order))
    listed = F.array_sort(F.collect_list(F.struct("split", "place", F.col("fragment").cast("string").alias("text"))))
    chained = parts.groupBy("file", "chain").agg(listed.alias("parts")).select(
        "file", F.col("parts")[0]["split"].alias("split"), F.col("parts")[0]["place"].alias("place"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("element"),
    )
    every = whole.union(chained).join(before, ["file", "split"])
    found = every.select(F.col("file").alias("file_path"), (F.col("before") + F.col("place") + 1).alias("number"), F.col("element"))
    return found.where(F.regexp_like("element", F.lit(r"\S"))), bad.withColumnRenamed("file", "file_path")


def split_result_logs(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``(file_path, result_no, result)`` of result logs of any size, and ``(file_path, error)`` of those that are broken."""
    found, bad = split_elements(spark, paths)
    result: Column = F.from_json("element", RESULTS.removeprefix("array<").removesuffix(">"))
    return found.select("file_path", F.col("number").alias("result_no"), result.alias("result")), bad
