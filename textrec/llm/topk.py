"""Exact top-k by inner product over a bit-sliced index."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrec.llm.common import open_array, save_arrays, scratch
from textrec.session import stored

# Rows of one index, and queries of a task.
INDEX_ROWS = 32_768
BLOCK_QUERIES = 128

# Scores are sums in 64 bits: no vector may be so long that they could leave them.
LONGEST = float(1 << 30)


def quantised(vector: str, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` of every component; null for vectors that are null or hold a null or non-finite one.

    A vector of ``LONGEST`` or more in length, as long as ``scale`` makes it, is an error.
    """
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") * F.lit(scale), F.lit(2.0))))
    numbers = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    error = F.raise_error(F.lit(f"a vector is {LONGEST:.0f} or longer, times its scale")).cast("array<bigint>")
    return F.when(fits, F.when(length < F.lit(LONGEST), numbers).otherwise(error))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; missing components are 0."""
    out = np.zeros((len(lists), width), np.int64)
    lengths = np.diff(lists.offsets.to_numpy())
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


class BitSlicedIndex:
    """One bitmap for every bit of every attribute, over rows in the order of their ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.order, self.values = order, values[order]
        self.rows, self.words = len(ids), -(-len(ids) // 64)
        self.least = int(values.min(initial=0))
        shifted = (self.values - self.least).astype(np.uint64)
        self.bits = max(1, int(shifted.max(initial=0)).bit_length())
        self.slices = np.stack([self._pack((shifted >> np.uint64(b)) & np.uint64(1)) for b in range(self.bits)], axis=1)
        self.every = self._pack(np.ones((self.rows, 1), np.uint64))[0]
        self.opposite = ~self.slices & self.every

    PARTS = ["order", "values", "slices", "every", "opposite"]

    def arrays(self) -> dict[str, np.ndarray]:
        return {name: getattr(self, name) for name in self.PARTS} | {"least": np.array([self.least])}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> BitSlicedIndex:
        """The index that has these arrays."""
        index = cls.__new__(cls)
        index.__dict__.update({name: arrays[name] for name in cls.PARTS})
        index.rows, index.words = len(index.order), len(index.every)
        index.bits, index.least = index.slices.shape[1], int(arrays["least"][0])
        return index

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """A score for each query that no row exceeds."""
        low, high = self.values.min(axis=0, initial=0), self.values.max(axis=0, initial=0)
        return np.where(queries > 0, queries * high, queries * low).sum(axis=1)

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits.astype(np.uint8).T, axis=1, bitorder="little")
        out = np.zeros((bits.shape[1], self.words * 8), np.uint8)
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the rows' scores, least significant first, less a constant.

        Each set bit of a query component adds the attribute's slices, moved up
        by that bit; for a negative component the opposite slices. Bitmaps of
        equal weight are added three at a time by carry-save adders.
        """
        columns: list[list[np.ndarray]] = [[]]
        for d in np.flatnonzero(query):
            own, weight = (self.slices if query[d] > 0 else self.opposite)[d], abs(int(query[d]))
            for up in range(weight.bit_length()):
                if weight >> up & 1:
                    while len(columns) < up + self.bits:
                        columns.append([])
                    for b in range(self.bits):
                        columns[up + b].append(own[b])
        out, w = [], 0
        while w < len(columns):
            now = columns[w]
            if len(now) > 1 and w + 1 == len(columns):
                columns.append([])
            while len(now) > 2:
                a, b, c = now.pop(), now.pop(), now.pop()
                half = a ^ b
                now.append(half ^ c)
                columns[w + 1].append((a & b) | (half & c))
            if len(now) == 2:
                a, b = now
                now = [a ^ b]
                columns[w + 1].append(a & b)
            out.append(now[0] if now else np.zeros(self.words, np.uint64))
            w += 1
        return out

    def top(self, query: np.ndarray, k: int, own: int = -1) -> np.ndarray:
        """The ``k`` best rows but ``own``: higher score, then smaller id.

        From the most significant slice downward rows are taken as long as no
        more than ``k`` have the bit; what is left at the end are rows of one
        score, of which the first ids fill the places.
        """
        sure, maybe = np.zeros(self.words, np.uint64), self.every.copy()
        if own >= 0:
            maybe[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        for bitmap in reversed(self.score_slices(query)):
            upper = maybe & bitmap
            if int(np.bitwise_count(sure | upper).sum()) > k:
                maybe = upper
            else:
                sure, maybe = sure | upper, maybe & ~bitmap
        rows = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little", count=self.rows))
        taken = rows(sure)
        return np.append(taken, rows(maybe)[: k - len(taken)])


def _written(folder: str, width: int):
    """Function that builds the index of one block, writes it to the shared folder and gives its name."""

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        index = BitSlicedIndex(ids, _matrix(table.column("v").combine_chunks(), width))
        name = f"{folder}/{uuid.uuid4().hex}"  # a repeated task writes a folder of its own
        rows = table.column("row").to_numpy()[index.order]
        save_arrays(name, index.arrays() | {"ids": ids[index.order], "rows": rows})
        return pa.table({"block": table.column("block")[:1], "folder": [name]})

    return build


def _search(folders: list[str], width: int, k: int):
    """Function that looks for the best rows of each query in one index after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, own_rows = _matrix(batch.column("v"), width), batch.column("row").to_numpy()
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own_rows]  # scores and ids, in order
            for folder in folders:
                arrays = {name: open_array(folder, name) for name in [*BitSlicedIndex.PARTS, "least", "ids", "rows"]}
                index = BitSlicedIndex.of(arrays)
                place = {int(r): i for i, r in enumerate(arrays["rows"])}
                bounds = index.bounds(asked)
                for i, row in enumerate(own_rows.tolist()):
                    scores, ids = best[i]
                    if len(scores) == k and bounds[i] < scores[-1]:
                        continue
                    top = index.top(asked[i], k, place.get(row, -1))
                    scores, ids = np.r_[scores, index.values[top] @ asked[i]], np.r_[ids, arrays["ids"][top]]
                    order = np.lexsort((ids, -scores))[:k]
                    best[i] = scores[order], ids[order]
            counts = [len(scores) for scores, _ in best]
            columns = [
                np.repeat(batch.column("id").to_numpy(), counts),
                np.concatenate([np.zeros(0, np.int64), *[np.arange(1, n + 1) for n in counts]]),
                np.concatenate([np.zeros(0, np.int64), *[ids for _, ids in best]]),
                np.concatenate([np.zeros(0, np.int64), *[scores for scores, _ in best]]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if i == 1 else c) for i, c in enumerate(columns)], ["query_id", "rank", "id", "score"])

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    index_rows: int = INDEX_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``(query_id, rank, id_col, score)``: the ``k`` rows of highest integer inner product for each query.

    ``is_query`` chooses the queries among the rows; a query's own row is no
    candidate, but another row with its id is. Ties go to the smaller id; fewer
    rows than ``k`` are all returned. Rows take no part if their id is null or
    their vector is null or holds a null or non-finite component. A shorter
    vector counts as filled with zeros. A query id that comes twice gets two
    rankings. Other columns are not looked at; an empty table gives no rows.

    Rows are dealt evenly, whatever their values, to blocks of about
    ``index_rows``, and each block's index is built once and written to the
    shared folder. Tasks of about ``block_queries`` queries map one index after
    the other; an index none of whose rows can score as high as the ``k`` found so
    far is passed over.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    valid = named.where(F.col("id").isNotNull() & F.col("v").isNotNull()).withColumn("row", F.monotonically_increasing_id())
    kept = stored(valid, "vectors")
    n_rows, n_queries, width = kept.agg(F.count("*"), F.count_if("q"), F.max(F.size("v"))).first()
    blocks, tasks, width = -(-n_rows // index_rows) or 1, -(-n_queries // block_queries) or 1, width or 0
    dealt = kept.select("id", "v", "row", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    built = dealt.repartitionByRange(blocks, "block").groupBy("block").applyInArrow(_written(scratch(spark, "slices"), width), "block int, folder string")
    folders = [r["folder"] for r in stored(built, "indexes").orderBy("block").collect()]
    asked = kept.where("q").select("id", "v", "row").repartition(tasks)
    found = asked.mapInArrow(_search(folders, width, k), "query_id long, rank int, id long, score long")
    return found.withColumnRenamed("id", id_col)
