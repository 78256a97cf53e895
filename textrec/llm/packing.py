"""Documents packed into fixed-length token sequences by linear grouping, configurations and best fit."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textrec.llm.common import giving_back, scratch

CAPACITY = 2_048
END_ID = 0
VOCABULARY = "byte_bpe_50k"

# Lengths above this share of the capacity are grouped; the rest fill gaps.
LARGE_SHARE = 0.4
GROUPS = 128

# Bytes of token ids handed back to Spark at a time.
BATCH_BYTES = 4 << 20

PIECES = "piece int, start long, length long, ids binary, slot int, place long"


def special_tokens(vocabulary: str) -> list[str]:
    """The special tokens of the vocabulary's tokenizer file."""
    return [t.content for t in _tokenizer(vocabulary).get_added_tokens_decoder().values()]


def _tokenizer(vocabulary: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


class Encoder:
    """Token ids of whole texts by a public vocabulary, which comes as a tokenizer file and as ranks.

    Both give the same ids, the ranks several times faster. A text that spells
    out one of the file's special tokens goes through the file, which knows them.
    The file takes several times the memory of the ranks, so it is loaded for the
    first such text, and to list its special tokens where they are not given.
    """

    def __init__(self, vocabulary: str, special: list[str] | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.vocabulary = vocabulary
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = special_tokens(vocabulary) if special is None else special

    @cached_property
    def file(self):
        return _tokenizer(self.vocabulary)

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.file.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: all full but the first."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    vocabulary: str = VOCABULARY,
    derived: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``(id_col, piece, start, length, ids, slot, place)``: every document's tokens and an end token, in pieces.

    ``ids`` are unsigned 32-bit numbers, little-endian. ``slot`` and ``place``
    number the pieces of each length within a task. Written to the shared folder,
    so documents are encoded once. A null text is an empty one and has the end token only.
    ``derived`` are columns made of these and written beside them, so that those
    who need no more of ``ids`` need not read them again.
    """
    rows, special = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), special_tokens(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, slot, seen = Encoder(vocabulary, special), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            size, names = 0, ["id", "piece", "start", "length", "ids", "slot", "place"]

            def made() -> pa.RecordBatch:
                arrays = [pa.array(c, t) for c, t in zip(out, kinds)]
                return pa.RecordBatch.from_arrays(arrays, names)

            kinds = [batch.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            for doc, text in zip(batch.column("id"), batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    values = (doc.as_py(), piece, start, length, ids[start : start + length].tobytes(), slot, int(seen[length]))
                    for column, value in zip(out, values):
                        column.append(value)
                    seen[length] += 1
                    size += 4 * length
                if size >= BATCH_BYTES:
                    yield made()
                    out, size = [[] for _ in range(7)], 0
            yield made()

    kind = rows.schema["id"].dataType.simpleString()
    path = scratch(docs.sparkSession, "pieces")
    made = rows.mapInArrow(giving_back(run), f"id {kind}, {PIECES}").withColumns(dict(derived or {}))
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path).withColumnRenamed("id", id_col)


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits, by the number of members."""
    best, came = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        after, item = best.copy(), np.full(capacity + 1, -1)
        for g in np.flatnonzero(worth > 1e-12):
            gain = best[: capacity + 1 - sizes[g]] + worth[g]
            better = gain > after[sizes[g] :] + 1e-12
            after[sizes[g] :][better] = gain[better]
            item[sizes[g] :][better] = g
        came.append(item)
        best = after
    out, room = np.zeros(len(sizes), np.int64), capacity
    for item in reversed(came):
        if item[room] >= 0:
            out[item[room]] += 1
            room -= int(sizes[item[room]])
    return float((worth * out).sum()), out


# Exchanges of a column after which the basis' inverse is made exact again.
REFINE_AFTER = 64


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Their product by plain sums: the driver calls no threaded BLAS or LAPACK, which may wait for ever beside Spark."""
    return (matrix * vector).sum(axis=1)


def _refined(inverse: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The inverse after a Newton step, which squares what rounding has left of ``1 - basis * inverse``."""
    error = -np.einsum("ij,jk->ik", basis, inverse)
    error[np.diag_indices_from(error)] += 1
    return inverse + np.einsum("ij,jk->ik", inverse, error)


def configurations(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each, so that few bins hold the ``wanted`` numbers of ``sizes``.

    The linear program over all configurations is solved by column generation,
    with a knapsack for the next column; the solution is rounded down, so a few
    of each size may be left over. The basis' inverse is kept in product form:
    a new column changes it by a matrix of rank one.
    """
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    for turn in range(1, 20 * len(sizes) + 200):
        worth, column = _best_configuration(sizes, inverse.sum(axis=0), capacity)
        if worth <= 1 + 1e-7:
            break
        used, step = _times(inverse, wanted), _times(inverse, column)
        ratio = np.where(step > 1e-9, np.maximum(used, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= step[:, None] * row
        inverse[out] = row
        if turn % REFINE_AFTER == 0:
            inverse = _refined(inverse, basis)
    used = np.floor(_times(_refined(inverse, basis), wanted) + 1e-6).astype(np.int64)
    left, out = wanted.astype(np.int64).copy(), []
    for j in np.argsort(-used):
        column = np.rint(basis[:, j]).astype(np.int64)
        some = min([int(used[j]), *[int(left[g] // column[g]) for g in np.flatnonzero(column)]])
        if some > 0:
            out.append((column, some))
            left -= some * column
    return out


def pack_lengths(counts: Mapping[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[dict[int, int], int]]:
    """Contents of bins ``({length: pieces}, bins)`` for so many pieces of each length.

    Lengths above ``LARGE_SHARE`` of the capacity are sorted and cut into
    ``groups`` groups of equal numbers, each rounded up to its longest. After the
    configurations of the rounded lengths are optimised, true lengths take their
    places, and what is left, longest first, goes to the bins with the least
    room that holds it. Works on numbers per length only, so its cost depends on
    the capacity and not on the number of documents.
    """
    left = {n: c for n, c in counts.items() if c}
    large = sorted((n for n in left if n > capacity * LARGE_SHARE), reverse=True)
    total = sum(left[n] for n in large)
    room: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]
    if total:
        members: list[list[list[int]]] = [[] for _ in range(groups)]
        at = 0
        for n in large:
            more = left.pop(n)
            while more:  # a group ends after its share of all pieces
                g = at * groups // total
                some = min(more, -(-(g + 1) * total // groups) - at)
                members[g].append([n, some])
                at, more = at + some, more - some
        members = [m for m in members if m]
        sizes: dict[int, list[list[int]]] = {}
        for m in members:  # groups with the same longest length are one size
            sizes.setdefault(m[0][0], []).extend(m)
        order = list(sizes)
        wanted = np.array([sum(c for _, c in sizes[s]) for s in order])
        for column, bins in configurations(np.array(order), wanted, capacity):
            slots = [sizes[order[g]] for g in np.flatnonzero(column) for _ in range(column[g])]
            while bins:
                # As many bins as have the same true lengths; a size may fill several places of a bin.
                need: dict[int, int] = {}
                for slot in slots:
                    need[id(slot)] = need.get(id(slot), 0) + 1
                some = min([bins, *[max(1, slot[0][1] // need[id(slot)]) for slot in slots]])
                content: dict[int, int] = {}
                for slot in slots:
                    n = slot[0][0]
                    content[n] = content.get(n, 0) + 1
                    if slot[0][1] < some:
                        raise AssertionError("a size was used up")
                    slot[0][1] -= some
                    if not slot[0][1]:
                        slot.pop(0)
                room[capacity - sum(n * c for n, c in content.items())].append((content, some))
                bins -= some
        for rest in sizes.values():
            for n, c in rest:
                left[n] = left.get(n, 0) + c
    for n in sorted(left, reverse=True):
        more = left[n]
        for r in range(n, capacity + 1):
            while more and room[r]:
                content, bins = room[r].pop()
                fit = r // n
                whole = min(bins, more // fit)
                if whole:
                    room[r - fit * n].append(({**content, n: content.get(n, 0) + fit}, whole))
                    bins, more = bins - whole, more - whole * fit
                if bins and 0 < more < fit:
                    room[r - more * n].append(({**content, n: content.get(n, 0) + more}, 1))
                    bins, more = bins - 1, 0
                if bins:
                    room[r].append((content, bins))
        if more:
            fit = capacity // n
            if more // fit:
                room[capacity - fit * n].append(({n: fit}, more // fit))
            if more % fit:
                room[capacity - more % fit * n].append(({n: more % fit}, 1))
    return [bin for r in room for bin in r]


def placement(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows ``(length, first, sequence, offset, each)``, sorted: where the pieces of a length go, by their rank.

    From rank ``first`` on, each sequence from ``sequence`` on takes ``each`` pieces, from ``offset`` on.
    """
    rows, ranks, sequence = [], {}, 0
    for content, n in bins:
        offset = 0
        for length, each in sorted(content.items(), reverse=True):
            first = ranks.get(length, 0)
            rows.append((length, first, sequence, offset, each))
            ranks[length] = first + n * each
            offset += length * each
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` in place of ``slot`` and ``place``.

    Only the number of pieces of each length, at most ``capacity`` numbers, goes
    to the driver, and only the placement by length and rank comes back, whose
    size depends on the capacity alone. Ranks are the places within a task plus
    the pieces of that length in earlier tasks.
    """
    lengths = pieces.groupBy("slot", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    path = scratch(pieces.sparkSession, "ranks")
    lengths.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).write.parquet(path)
    earlier = pieces.sparkSession.read.parquet(path)
    counts = {int(r["length"]): int(r["n"]) for r in earlier.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = placement(pack_lengths(counts, capacity, groups))
    plan = pieces.sparkSession.sparkContext.broadcast(table)
    ranked = pieces.join(earlier.select("slot", "length", "before"), ["slot", "length"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place")).drop("slot", "place", "before")

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length, rank):
        import pandas as pd

        rows = plan.value
        keys = rows[:, 0] * (1 << 44) + rows[:, 1]
        own, at = length.to_numpy(), rank.to_numpy()
        run = rows[np.searchsorted(keys, own * (1 << 44) + at, "right") - 1]
        bin, slot = np.divmod(at - run[:, 1], run[:, 4])
        return pd.DataFrame({"sequence_id": run[:, 2] + bin, "offset": run[:, 3] + slot * own})

    out = ranked.withColumn("_to", placed("length", "rank"))
    kept = [c for c in pieces.columns if c not in ("slot", "place")]
    return out.select(*kept, "_to.sequence_id", "_to.offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **options) -> DataFrame:
    """``(id_col, piece, start, length, ids, sequence_id, offset)``: all documents in sequences of at most ``capacity`` tokens.

    Only documents longer than a sequence are cut. Sequences have no gaps. Null
    and empty texts are their end token; null ids are kept; repeated rows are
    packed each; other columns are not looked at; an empty table gives no rows.
    """
    return pack_pieces(token_pieces(docs, id_col, text_col, capacity, **options), capacity)
