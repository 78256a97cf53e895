"""Ordered rules held as a table of any length: their keywords in flat arrays, which workers map and search batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrec.session import shared_folder
from textrec.shared import open_arrays, write_arrays

# Rules in one index; a row that a rule of one index matches is not looked for in those after it.
RULES_PER_INDEX = 100_000

# Places of a text that are looked up at a time.
PLACES_AT_ONCE = 1 << 19

WORD = 8
SPREAD = np.uint64(0x9E3779B97F4A7C15)
ARRAYS = ["words", "first", "rule", "back", "length", "start", "bytes", "filter", "classes", "values"]


def _masks() -> np.ndarray:
    """By length in bytes, up to a word's, the bits of a word that count."""
    return np.array([(1 << 8 * min(n, WORD)) - 1 for n in range(WORD + 1)], np.uint64)


def _words(data: np.ndarray) -> np.ndarray:
    """The word that begins at each byte, without a copy; ``data`` has a word of bytes to spare."""
    return np.ndarray((max(0, len(data) - WORD + 1),), "<u8", data, strides=(1,))


def _bits(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys * SPREAD) >> np.uint64(64 - size)).view(np.int64)


def index_arrays(keywords: list[bytes], values: pa.Array) -> dict[str, np.ndarray]:
    """Flat arrays for rules in order: of equal keywords the first counts.

    A keyword of a word (8 bytes) or more is found by one of the words in it, the
    one that fewest others have; ``back`` says how far it lies behind the
    keyword's start. Shorter ones are words of their own, in a class for each
    length. Per class there are the sorted distinct ``words``, for each the rules
    that have it, and a bitmap that tells most places without any at a glance.
    """
    firsts: dict[bytes, int] = {}
    for i, word in enumerate(keywords):
        firsts.setdefault(word, i)
    rules = np.array([i for w, i in firsts.items() if w], np.int64)
    kept = [w for w in firsts if w]
    length = np.array([len(w) for w in kept], np.int64)
    start = np.cumsum(length) - length
    data = np.frombuffer(b"".join(kept) + bytes(WORD), np.uint8)
    at = _words(data)
    sizes = np.minimum(length, WORD)
    # Every word of every keyword: one of a short keyword, otherwise one for each place it may lie at.
    places = length - sizes + 1
    owner = np.repeat(np.arange(len(kept)), places)
    back = np.arange(len(owner)) - np.repeat(np.cumsum(places) - places, places)
    keys = at[start[owner] + back] & _masks()[sizes[owner]]
    _, same, often = np.unique(keys, return_inverse=True, return_counts=True)
    order = np.lexsort((back, often[same], owner))
    chosen = order[np.cumsum(places) - places] if len(kept) else order
    keys, back = keys[chosen], back[chosen]
    words, first, listed, classes, bitmaps = [], [0], [], [], []
    for size in range(1, WORD + 1):
        own = np.flatnonzero(sizes == size)
        if not len(own):
            continue
        own = own[np.lexsort((rules[own], keys[own]))]
        some, counts = np.unique(keys[own], return_counts=True)
        bits = max(12, int(16 * len(some) - 1).bit_length())
        bitmap = np.zeros(1 << bits, bool)
        bitmap[_bits(some, bits)] = True
        classes.append((size, len(words) and sum(map(len, words)), len(some), bits, sum(map(len, bitmaps))))
        words.append(some)
        first += (first[-1] + np.cumsum(counts)).tolist()
        listed.append(own)
        bitmaps.append(bitmap)
    every = np.concatenate([np.zeros(0, np.int64), *listed])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, pa.schema([pa.field("value", values.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([values], ["value"]))
    return {
        "words": np.concatenate([np.zeros(0, np.uint64), *words]),
        "first": np.array(first, np.int64),
        "rule": rules[every],
        "back": back[every],
        "length": length[every],
        "start": start[every],
        "bytes": data,
        "filter": np.concatenate([np.zeros(0, bool), *bitmaps]),
        # The empty keyword, which any text has, comes first: its rule, or -1.
        "classes": np.array([(firsts.get(b"", -1), 0, 0, 0, 0), *classes], np.int64),
        "values": np.frombuffer(sink.getvalue(), np.uint8),
    }


class Searcher:
    """Finds the first rule of an index for many texts at once."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.values = pa.ipc.open_file(pa.py_buffer(np.asarray(arrays["values"]))).read_all().column("value").combine_chunks()
        self.none = len(self.values)

    def first_rules(self, texts: pa.Array) -> np.ndarray:
        """By text, which may be null, the place of its first rule, or ``none``."""
        x = self.arrays
        best = np.full(len(texts), self.none, np.int64)
        if x["classes"][0, 0] >= 0:
            best[texts.is_valid().to_numpy(zero_copy_only=False)] = x["classes"][0, 0]
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        low, high = int(ends[0]), int(ends[-1])
        if data is None or high == low:
            return best
        text = np.concatenate([np.frombuffer(data, np.uint8)[low:high], np.zeros(WORD, np.uint8)])
        ends = ends - low
        words, own, masks = _words(text), _words(np.asarray(x["bytes"])), _masks()
        least = x["rule"][x["first"][:-1]]  # by word, its first rule
        for at in range(0, high - low, PLACES_AT_ONCE):
            some = words[at : min(high - low, at + PLACES_AT_ONCE)]
            a, b = np.searchsorted(ends, [at, at + len(some) - 1], "right") - 1
            rows = np.repeat(np.arange(a, b + 1), np.diff(np.r_[at, ends[a + 1 : b + 1], at + len(some)]))
            # Long keywords first: a row that has a rule already needs no later one.
            for size, base, n, bits, bitmap in x["classes"][:0:-1]:
                base, n, bits = int(base), int(n), int(bits)
                first = least[base : base + n].min()
                if (best[a : b + 1] <= first).all():
                    continue
                keys, filter = x["words"][base : base + n], x["filter"][bitmap : bitmap + (1 << bits)]
                found = some & masks[size]
                there = np.flatnonzero(filter[_bits(found, bits)])
                there = there[best[rows[there]] > first]
                found = found[there]
                key = np.searchsorted(keys, found)
                key[key == n] = 0
                useful = (keys[key] == found) & (least[base + key] < best[rows[there]])
                self._count(best, there[useful] + at, rows[there[useful]], key[useful] + base, ends, words, own, masks)
        return best

    def _count(self, best: np.ndarray, place: np.ndarray, rows: np.ndarray, key: np.ndarray, ends: np.ndarray, words: np.ndarray, own: np.ndarray, masks: np.ndarray) -> None:
        """Takes the rules of the keys at these places into account, where the whole keyword is there, within one text."""
        x = self.arrays
        counts = x["first"][key + 1] - x["first"][key]
        for low in range(0, len(place), 1 << 16):  # a word may have many rules
            some = slice(low, low + (1 << 16))
            many = counts[some]
            which = np.repeat(x["first"][key[some]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            begin, row = np.repeat(place[some], many) - x["back"][which], np.repeat(rows[some], many)
            length, rule = x["length"][which], x["rule"][which]
            fits = (begin >= ends[row]) & (begin + length <= ends[row + 1]) & (rule < best[row])
            begin, row, length, rule, start = begin[fits], row[fits], length[fits], rule[fits], x["start"][which[fits]]
            done = 0
            while len(begin) and done < length.max():
                step = np.minimum(done, np.maximum(length - WORD, 0))  # the last word ends where the keyword ends
                same = ((words[begin + step] ^ own[start + step]) & masks[np.minimum(length, WORD)]) == 0
                begin, row, length, rule, start = begin[same], row[same], length[same], rule[same], start[same]
                done += WORD
            np.minimum.at(best, row, rule)


@dataclass(frozen=True)
class RuleIndex:
    """Folders of the indexes in the order of their rules, and the type of the rules' values."""

    folders: tuple[str, ...]
    value: T.DataType


def build_index(rules: DataFrame, rules_per_index: int = RULES_PER_INDEX) -> RuleIndex:
    """Indexes of a table ``(priority, keyword, value)``, in the shared folder.

    Rules are sorted by range; each task writes an index for every
    ``rules_per_index`` rules it has, so no task and no index grows with the
    table. Only the folders' names reach the driver. Keywords are lower-cased; a
    null one matches nothing. Of rules with one priority the first by keyword counts.
    """
    spark = rules.sparkSession
    base = f"{shared_folder(spark)}/textrec/rules-{uuid.uuid4().hex}"
    named = rules.select("priority", F.lower("keyword").alias("keyword"), "value").where(F.col("keyword").isNotNull())
    ordered = named.repartitionByRange("priority", "keyword").sortWithinPartitions("priority", "keyword")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).slice(0, rules_per_index).combine_chunks()
            folder = f"{base}/{uuid.uuid4().hex}"  # a repeated task writes a folder of its own
            keywords = [w.as_py() for w in table.column("keyword").cast(pa.binary())]
            values = pa.concat_arrays(table.column("value").chunks) if table.num_rows else pa.nulls(0)
            write_arrays(folder, index_arrays(keywords, values))
            return pa.RecordBatch.from_arrays([pa.array([folder])], ["folder"])

        for batch in batches:
            held, size = [*held, batch] if batch.num_rows else held, size + batch.num_rows
            while size >= rules_per_index:
                yield made()
                rest = pa.Table.from_batches(held).slice(rules_per_index).combine_chunks()
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield made()

    folders = ordered.mapInArrow(build, "folder string").select(F.monotonically_increasing_id().alias("place"), "folder")
    names = sorted((r["place"], r["folder"]) for r in folders.collect())
    return RuleIndex(tuple(f for _, f in names), rules.schema["value"].dataType)


def with_first_match(df: DataFrame, index: RuleIndex, text: str, name: str, default) -> DataFrame:
    """``df`` with the value of the first rule whose keyword occurs in the lower-cased text, in any place; else ``default``.

    The first rule that matches counts, be its value null. Only the text goes to
    the workers, a batch at a time; every worker maps the indexes.
    """
    found = T.StructType([T.StructField("hit", T.BooleanType()), T.StructField("value", index.value)])
    folders = index.folders

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        searchers = [Searcher(open_arrays(folder, ARRAYS)) for folder in folders]
        for texts in batches:
            texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
            left, values = np.arange(len(texts)), pa.nulls(0) if not searchers else None
            places, tables = np.full(len(texts), -1, np.int64), []
            base = 0
            for searcher in searchers:
                if not len(left):
                    break
                some = texts if len(left) == len(texts) else texts.take(pa.array(left))
                first = searcher.first_rules(some)
                hit = first < searcher.none
                places[left[hit]] = base + first[hit]
                tables.append(searcher.values)
                base += searcher.none
                left = left[~hit]
            at = pa.array(np.maximum(places, 0), mask=places < 0)
            values = pa.chunked_array(tables).take(at).combine_chunks() if tables else pa.nulls(len(texts), pa.int32())
            yield pa.StructArray.from_arrays([pa.array(places >= 0), values], ["hit", "value"])

    if not folders:
        return df.withColumn(name, F.lit(default).cast(index.value))
    column = f"_{uuid.uuid4().hex}"
    rows = df.withColumn(column, F.arrow_udf(_typed(search), found)(F.lower(text)))
    hit = F.col(column)
    return rows.withColumn(name, F.when(hit["hit"], hit["value"]).otherwise(F.lit(default))).drop(column)


def _typed(search):
    """The hints that tell Spark of a function over an iterator of arrays; hints kept as text would not."""
    search.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return search


def first_match_table(
    df: DataFrame, rules: DataFrame, text: str, name: str, default, rules_per_index: int = RULES_PER_INDEX
) -> DataFrame:
    """``first_match`` with the rules in a table ``(priority, keyword, value)`` of any length."""
    return with_first_match(df, build_index(rules, rules_per_index), text, name, default)
