"""Repeated byte strings across a corpus, found in suffix order and removed but for the first."""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrec.llm.common import giving_back, parts
from textrec.llm.suffixes import MEMORY_BYTES, Files, sorted_suffixes

# Bytes of a repeated string, bytes of the anchors that strings are dealt out by, and text bytes of a chunk of documents.
WINDOW = 100
ANCHOR = 32
CHUNK_BYTES = 1 << 20

# Strings are sorted a bucket at a time; several buckets a task even out its load and keep each small.
BUCKETS_PER_TASK = 4

# How hard chunks and strings are compressed on their way.
LEVEL = 3

# Odd, so it has an inverse among 64-bit numbers.
BASE = 0x9E3779B97F4A7C15
HASH_BITS = np.uint64((1 << 47) - 1)
FLAG = np.uint64(1 << 47)

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` among 64-bit numbers; kept for the next call."""
    had = _powers.get(str(base))
    if had is None or len(had) < n:
        row = np.full(1 << max(n, 2).bit_length(), base, np.uint64)
        row[0] = 1
        had = _powers[str(base)] = np.multiply.accumulate(row)
    return had[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """Runs of windows of one anchor, in the concatenated texts of a chunk.

    Each window of ``window`` bytes has an anchor: of its strings of ``anchor``
    bytes the one with the least hash, the leftmost if there are several. Equal
    windows have equal anchors at equal places. ``first`` and ``last`` are the
    starts of the first and last window of a run, ``key`` hashes its anchor.
    """

    def __init__(self, text: np.ndarray, lengths: np.ndarray, window: int, anchor: int):
        n, span = len(text), window - anchor + 1
        ends = np.cumsum(lengths)
        self.first = self.last = self.doc = np.zeros(0, np.int64)
        self.key = np.zeros(0, np.uint64)
        self.begin = ends - lengths
        if n < window:
            return
        weighted = text.astype(np.uint64) * _power(BASE, n)
        summed = np.zeros(n + 1, np.uint64)
        np.cumsum(weighted, out=summed[1:])
        inverse = pow(BASE, -1, 1 << 64)
        hashes = _mixed((summed[anchor:] - summed[:-anchor]) * _power(inverse, n - anchor + 1))
        low = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of each window's anchor
        inside = np.zeros(len(place), bool)
        for a, b in zip(self.begin, ends):
            if b - a >= window:
                inside[a : b - window + 1] = True
        starts = np.flatnonzero(inside)
        if not len(starts):
            return
        at = place[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        heads = np.flatnonzero(new)
        self.first = starts[heads]
        self.last = starts[np.append(heads[1:], len(starts)) - 1]
        self.key = hashes[at[heads]]
        self.doc = np.searchsorted(ends, self.first, "right")


def _dealt(pieces: Pieces, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct anchors by bucket: ``(bucket, key, how often, which of them each run has)``."""
    keys, which, times = np.unique(pieces.key, return_inverse=True, return_counts=True)
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return bucket[order], keys[order], times[order], back[which]


def _by_value(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else []
    for a, b in zip(starts, np.append(starts[1:], len(values)) if len(values) else []):
        yield int(values[a]), slice(int(a), int(b))


def _numbered(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows of a partition, about ``chunk_bytes`` of text each, numbered by partition and place.

    Reading the same table again makes the same chunks.
    """
    number, held, size = TaskContext.get().partitionId() << 33, [], 0
    for batch in batches:
        weight = np.cumsum(pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        done = 0
        while done < batch.num_rows:
            before = int(weight[done - 1]) if done else 0
            end = min(batch.num_rows, int(np.searchsorted(weight, before + chunk_bytes - size)) + 1)
            held.append(batch.slice(done, end - done))
            size += int(weight[end - 1]) - before
            done = end
            if size >= chunk_bytes:
                yield number, pa.Table.from_batches(held).combine_chunks()
                number, held, size = number + 1, [], 0
    if held:
        yield number, pa.Table.from_batches(held).combine_chunks()


def _chunks(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """``(chunk, rows)``: chunks of ``rows`` as compressed Arrow data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _numbered(batches, chunk_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

    return rows.mapInArrow(giving_back(run), "chunk long, rows binary")


def _opened(rows: bytes) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    with pa.ipc.open_stream(rows) as source:
        return _content(source.read_all().combine_chunks())


def _content(table: pa.Table) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's rows, their ids (null: the least), their bytes put together and their lengths."""
    batch = table.to_batches()[0]
    texts = [x.as_py() or b"" for x in batch.column("_text")]
    lengths = np.array([len(x) for x in texts], np.int64)
    ids = pc.fill_null(batch.column("_id"), -(2**63)).to_numpy(zero_copy_only=False).astype(np.int64)
    return batch, ids, np.frombuffer(b"".join(texts), np.uint8), lengths


def _frame(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


def _anchors(window: int, anchor: int, buckets: int, chunk_bytes: int):
    """Per chunk and bucket the distinct anchors, six bytes each, with a flag for those it has twice.

    Cuts the chunks itself: a function upon that of ``_chunks`` would run in a second Python worker a core,
    and workers stay for the stages that follow.
    """
    schema = [("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in _numbered(batches, chunk_bytes):
            _, _, text, lengths = _content(table)
            bucket, keys, times, _ = _dealt(Pieces(text, lengths, window, anchor), buckets)
            short = (keys >> np.uint64(17)) | np.where(times > 1, FLAG, np.uint64(0))
            six = short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            out = [(b, chunk, six[at].tobytes()) for b, at in _by_value(bucket)]
            if out:
                yield _frame(schema, out)

    return run


def _six(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """The rows of one key after the other, of batches sorted by it."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != now and held:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk and bucket which of its anchors are found a second time anywhere, as bits."""
    schema = [("chunk", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())]
    for bucket, rows in _grouped(batches, "bucket"):
        own = [_six(r["keys"]) for r in rows]
        every = np.concatenate(own)
        _, which, times = np.unique(every & HASH_BITS, return_inverse=True, return_counts=True)
        more = times > 1
        more[which[(every & FLAG) > 0]] = True
        hit, at = more[which], 0
        out = []
        for row, keys in zip(rows, own):
            some = hit[at : at + len(keys)]
            at += len(keys)
            if some.any():
                out.append((row["chunk"], bucket, np.packbits(some).tobytes()))
        if out:
            yield _frame(schema, out)


MARKS = [("chunk", pa.int64()), ("marks", pa.binary())]


def _marks(chunk: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Byte ranges to remove, a row for each chunk."""
    order = np.argsort(chunk, kind="stable")
    ranges = np.stack([doc, start, end], axis=1)[order].astype("<i8")
    packed = zstandard.ZstdCompressor(1)
    out = [(c, packed.compress(ranges[at].tobytes())) for c, at in _by_value(chunk[order])]
    if out:
        yield _frame(MARKS, out)


HEAD = "<q"


def _strings(window: int, anchor: int, buckets: int):
    """The strings of repeated anchors, to their buckets.

    A row holds strings of one chunk: their lengths, anchors, owners (id,
    document in the chunk, start) and bytes. Of equal strings in a chunk only the first is
    sent; the marks of the others go out as rows of the bucket -1.
    """
    schema = [("bucket", pa.int32()), ("chunk", pa.int64()), ("strings", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = zstandard.ZstdCompressor(LEVEL)
        for batch in batches:
            for chunk, rows, hits in zip(batch.column("chunk"), batch.column("rows"), batch.column("hits")):
                _, ids, text, lengths = _opened(rows.as_py())
                pieces = Pieces(text, lengths, window, anchor)
                bucket, keys, _, which = _dealt(pieces, buckets)
                hit = np.zeros(len(keys), bool)
                bits = {h["bucket"]: h["bits"] for h in hits.as_py()}
                for b, at in _by_value(bucket):
                    if b in bits:
                        hit[at] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=at.stop - at.start)
                own = np.flatnonzero(hit[which])
                # In the order of ids, then of rows and starts: the first of equal strings stays.
                own = own[np.lexsort((pieces.first[own], pieces.doc[own], ids[pieces.doc[own]]))]
                whole = text.tobytes()
                seen: set[bytes] = set()
                kept, again, content = [], [], []
                for i, a, b in zip(own.tolist(), pieces.first[own].tolist(), (pieces.last[own] + window).tolist()):
                    string = whole[a:b]
                    if string in seen:
                        again.append(i)
                    else:
                        seen.add(string)
                        kept.append(i)
                        content.append(string)
                start = pieces.first - pieces.begin[pieces.doc]
                end = pieces.last + window - pieces.begin[pieces.doc]
                out = []
                if again:
                    ranges = np.stack([pieces.doc[again], start[again], end[again]], axis=1).astype("<i8")
                    out.append((-1, chunk.as_py(), packed.compress(ranges.tobytes())))
                home = bucket[which[kept]]
                order = np.argsort(home, kind="stable")
                kept, content = np.array(kept, np.int64)[order], [content[i] for i in order]
                for b, at in _by_value(home[order]):
                    some = kept[at]
                    numbers = [end[some] - start[some], (pieces.key[some] >> np.uint64(32)).astype(np.int64), ids[pieces.doc[some]], pieces.doc[some], start[some]]
                    body = b"".join([struct.pack(HEAD, len(some)), *[x.astype("<i8").tobytes() for x in numbers], *content[at]])
                    out.append((b, chunk.as_py(), packed.compress(body)))
                if out:
                    yield _frame(schema, out)

    return run


def _first_of_equal(strings: list[bytes], rank: np.ndarray, files: Files, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the ``strings`` that are also in one of lower ``rank``: ``(string, start)``.

    The strings, one after the other with a mark between, are sorted by suffix;
    windows that share their whole length follow each other in that order.
    """
    lengths = np.array([len(s) for s in strings], np.int64)
    n = int(lengths.sum()) + len(strings) + 1
    text = files.array(n, np.uint16)
    at, begins = 0, np.cumsum(lengths + 1) - lengths - 1
    for a in range(0, len(strings), 4096):
        some = np.frombuffer(b"".join(s + b"\0" for s in strings[a : a + 4096]), np.uint8).astype(np.uint16) + 2
        some[np.cumsum(lengths[a : a + 4096] + 1) - 1] = 1
        text[at : at + len(some)] = some
        at += len(some)
    text[n - 1] = 0
    inside = np.zeros(n + 1, np.int8)  # where a window begins
    np.add.at(inside, begins, 1)
    np.add.at(inside, begins + lengths - window + 1, -1)
    inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
    group, kept = 0, []
    for pos, lcp in sorted_suffixes(files, text, 258, window):
        number = group + np.cumsum(lcp < window)
        group = int(number[-1])
        valid = inside[pos]
        kept.append((number[valid], pos[valid]))
    number, pos = (np.concatenate(x) for x in zip(*kept))
    # A window alone in its group is found nowhere else.
    new = np.r_[True, number[1:] != number[:-1], True]
    shared = ~(new[:-1] & new[1:])
    number, pos = number[shared], pos[shared]
    string = np.searchsorted(begins, pos, "right") - 1
    start = pos - begins[string]
    if not len(number):
        return string, start
    heads = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    least = np.repeat(np.minimum.reduceat(rank[string], heads), np.diff(np.r_[heads, len(number)]))
    later = rank[string] > least
    return string[later], start[later]


def _sorted_shards(window: int, memory: int):
    """Marks of all windows that an earlier one equals, bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = zstandard.ZstdDecompressor()
        own: dict[bytes, tuple] = {}
        now, again, waiting = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if again:
                yield from _marks(*np.array(again, np.int64).T)
                again.clear()

        def finish() -> Iterator[pa.RecordBatch]:
            yield from flush()
            # A window is in strings of one anchor only, so a string that shares its anchor with no other is done.
            held = sorted(own.items(), key=lambda x: x[1][4])
            anchors = np.array([x[1][4] for x in held], np.int64)
            own.clear()
            _, which, times = np.unique(anchors, return_inverse=True, return_counts=True)
            held = [held[i] for i in np.flatnonzero(times[which] > 1)] if len(held) else []
            if not held:
                return
            owners = np.array([x[1][:4] for x in held], np.int64)  # id, chunk, document, start
            rank = np.empty(len(held), np.int64)
            rank[np.lexsort(owners.T[::-1])] = np.arange(len(held))
            with tempfile.TemporaryDirectory() as folder:
                string, start = _first_of_equal([x[0] for x in held], rank, Files(folder, memory), window)
            order = np.lexsort((start, string))
            string, start = string[order], start[order]
            if not len(string):
                return
            heads = np.flatnonzero(np.r_[True, (string[1:] != string[:-1]) | (start[1:] != start[:-1] + 1)])
            last = start[np.append(heads[1:], len(start)) - 1]
            whose = owners[string[heads]]
            yield from _marks(whose[:, 1], whose[:, 2], whose[:, 3] + start[heads], whose[:, 3] + last + window)

        for batch in batches:
            for bucket, chunk, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "strings"))):
                if bucket != now:
                    yield from finish()
                    now = bucket
                if bucket < 0:
                    yield _frame(MARKS, [(chunk, blob)])
                    continue
                body = unpacked.decompress(blob)
                n = struct.unpack_from(HEAD, body)[0]
                lengths, anchors, ids, docs, starts = np.frombuffer(body, "<i8", 5 * n, struct.calcsize(HEAD)).reshape(5, n).tolist()
                at = struct.calcsize(HEAD) + 40 * n
                for length, anchor, id_, doc, start in zip(lengths, anchors, ids, docs, starts):
                    string = body[at : at + length]
                    at += length
                    owner = (id_, chunk, doc, start, anchor)
                    had = own.get(string)
                    if had is None:
                        own[string] = owner
                        continue
                    if owner < had:
                        own[string], owner = owner, had
                    again.append((owner[1], owner[2], owner[3], owner[3] + length))
                if len(again) > 100_000:
                    yield from flush()
        yield from finish()

    return run


def _cut(out_type: str, others: list[str], kinds: dict[str, pa.DataType]):
    """The rows of each chunk without the marked bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = zstandard.ZstdDecompressor()
        for batch in batches:
            for rows, marks in zip(batch.column("rows"), batch.column("marks")):
                table, _, text, lengths = _opened(rows.as_py())
                begin = np.cumsum(lengths) - lengths
                edge = np.zeros(len(text) + 1, np.int32)
                for blob in marks.as_py() or ():
                    doc, start, end = np.frombuffer(unpacked.decompress(blob), "<i8").reshape(-1, 3).T
                    np.add.at(edge, begin[doc] + start, 1)
                    np.add.at(edge, begin[doc] + end, -1)
                gone = np.cumsum(edge[:-1]) > 0
                starts, ends = [], []
                kept = []
                for a, n in zip(begin.tolist(), lengths.tolist()):
                    some = gone[a : a + n]
                    turns = np.flatnonzero(np.diff(np.r_[False, some, False].astype(np.int8)))
                    starts.append(turns[::2])
                    ends.append(turns[1::2])
                    kept.append(text[a : a + n][~some].tobytes() if len(turns) else text[a : a + n].tobytes())
                if out_type == "string":
                    kept = [k.decode("utf-8", "ignore") for k in kept]
                columns = [table.column("_id"), pa.array(lengths)]
                columns += [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]
                columns += [pa.array(kept, pa.string() if out_type == "string" else pa.binary())]
                columns += [table.column(c) for c in others]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_bytes", "_starts", "_ends", "_kept", *others])

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    chunk_bytes: int = CHUNK_BYTES,
    memory: int = MEMORY_BYTES,
    as_text: bool = False,
) -> DataFrame:
    """``docs`` without every byte that lies in a ``window`` of bytes that also starts earlier.

    Earlier is: in a row with a smaller id (an integer; null is least), or in an earlier
    row with that id, or earlier in the same text. Matches never cross rows,
    overlaps count, and strings are judged on the input. Added are ``n_bytes``
    and the removed ranges ``starts`` and ``ends``; ``kept`` holds the remaining
    bytes, or, with ``as_text``, the text column itself does, less the parts of
    characters cut through. All other columns stay, whatever their names (but
    these four). Null and empty texts are empty; rows that repeat are all
    returned; an empty table gives no rows. ``docs`` must be a table or another
    input that gives the same rows in the same order when read again.

    Every window goes to the bucket of its anchor, so equal windows meet. First
    only anchors travel, each once per chunk of documents, to tell which occur
    again; then the strings around those, each once per chunk. In its bucket each
    different string is held once, whatever the number of its copies. The suffixes of
    these strings are put in order by external induced sorting within ``memory``
    bytes and the task's disk, and windows that follow each other with
    a common prefix of their whole length are equal.
    """
    if not 0 < anchor <= window <= 200:
        raise ValueError("0 < anchor <= window <= 200 is needed")
    spark = docs.sparkSession
    tasks = parts(spark)
    buckets = BUCKETS_PER_TASK * tasks
    # Other columns travel under numbers, so that no name of theirs is one of those used here.
    passed = {f"c{i}": c for i, c in enumerate(c for c in docs.columns if c not in (id_col, text_col))}
    others, columns = list(passed), docs.columns
    id_kind = docs.schema[id_col].dataType
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(n) for n, c in passed.items()])
    rows = docs.select(F.col("id").cast("long").alias("_id"), F.col("text").cast("binary").alias("_text"), *others)
    chunks = _chunks(rows, chunk_bytes)

    found = rows.mapInArrow(giving_back(_anchors(window, anchor, buckets, chunk_bytes)), "bucket int, chunk long, keys binary")
    dealt = found.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    again = dealt.mapInArrow(giving_back(_repeated), "chunk long, bucket int, bits binary")
    hits = again.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("hits"))
    asked = chunks.join(hits, "chunk").select("chunk", "rows", "hits")
    strings = asked.mapInArrow(giving_back(_strings(window, anchor, buckets)), "bucket int, chunk long, strings binary")
    spread = F.when(F.col("bucket") < 0, F.xxhash64("chunk")).otherwise(0)
    shards = strings.repartition(tasks, "bucket", spread).sortWithinPartitions("bucket")
    marks = shards.mapInArrow(giving_back(_sorted_shards(window, memory)), "chunk long, marks binary")
    by_chunk = marks.groupBy("chunk").agg(F.collect_list("marks").alias("marks"))
    whole = chunks.join(by_chunk, "chunk", "left").select("rows", "marks")

    kept = "string" if as_text else "binary"
    fields = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in others]
    schema = ", ".join(["_id long", "_bytes long", "_starts array<long>", "_ends array<long>", f"_kept {kept}", *fields])
    out = whole.mapInArrow(giving_back(_cut(kept, others, {})), schema)
    named = {id_col: F.col("_id").cast(id_kind), text_col: F.col("_kept")} | {c: F.col(n) for n, c in passed.items()}
    if as_text:
        return out.select(*[named[c].alias(c) for c in columns])
    kept = [named[c].alias(c) for c in columns if c != text_col]
    return out.select(*kept, F.col("_bytes").alias("n_bytes"), F.col("_starts").alias("starts"), F.col("_ends").alias("ends"), F.col("_kept").alias("kept"))
