"""Near-duplicates by SimHash fingerprints that meet at the anchors of a covering code."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textrec.llm.common import giving_back, parts
from textrec.llm.components import stars
from textrec.session import stored

BITS = 64

# Shingles counted at a time, so that a very long text needs little memory.
SHINGLES_AT_ONCE = 1 << 15

# Members of a key compared in one go. Larger anchors are divided by pieces of the other blocks, and what is still
# larger is cut into sets that meet two by two.
ANCHOR_MEMBERS = 20_000

# Differing bits at which fingerprints link, and blocks of the fingerprint that have anchors. With 2 blocks two
# fingerprints within 5 bits always meet at an anchor, with 4 blocks two within 11.
THRESHOLD, BLOCKS = 3, 2

# For texts of a similarity of 0.8 or more by five-word shingles: bits in the fingerprints of three and of five words.
SIMILAR_WORDS, SIMILAR_BITS, SIMILAR_BLOCKS = (3, 5), (11, 12), 4


def fingerprint(text: bytes, shingle_words: int = 3, seed: int = 42) -> int:
    """SimHash of the XXH64 values of a text's word shingles, repeats included."""
    words = text.lower().split()  # of bytes: A-Z only, and white space 0x20, 0x09-0x0D only
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle_words + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        end = min(n, at + SHINGLES_AT_ONCE)
        shifted = [words[at + k : end + k] for k in range(shingle_words)]
        shingles = zip(*shifted) if len(words) >= shingle_words else [words]
        hashes = np.array([digest(b" ".join(s), seed) for s in shingles], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: tuple[int, ...] = (3,)) -> DataFrame:
    """``(id_col, print, print1, ...)``: a fingerprint of each whole text for each length of shingles, as signed longs.

    A null text has no words.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    names = print_names(len(shingle_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column("text")]
            made = [np.array([fingerprint(t, n) for t in texts], np.uint64).view(np.int64) for n in shingle_words]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, made)], ["id", *names])

    kind = rows.schema["id"].dataType.simpleString()
    fields = ", ".join(f"{n} long" for n in names)
    return rows.mapInArrow(giving_back(run), f"id {kind}, {fields}").withColumnRenamed("id", id_col)


def print_names(n: int) -> list[str]:
    return ["print", *[f"print{i}" for i in range(1, n)]]


def anchors(prints: np.ndarray, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """For every fingerprint the anchors it is copied to: ``(index, anchor)``.

    The 64 bits are cut into ``blocks`` of 32 or 16. The anchors of a block are
    the words of the Hamming code of 31 or 15 bits with either value of the last
    bit: a covering code of radius 1. A fingerprint goes to all anchors within 2,
    that is the radius plus one differing bit. Two fingerprints that differ in
    at most two bits of a block so meet at an anchor of it; some block is like
    that if all 64 bits differ in less than three a block. In a
    block of 32 bits that makes 17 anchors, in one of 16 nine, or 2 for a code word.
    """
    size = BITS // blocks
    if size not in (16, 32):
        raise ValueError("blocks must be 2 or 4")
    free = np.uint64(1 << (size - 1))
    masks = [sum(1 << i for i in range(size - 1) if (i + 1) >> j & 1) for j in range((size - 1).bit_length())]
    all_at, all_keys = [], []
    index = np.arange(len(prints))
    for block in range(blocks):
        word = (prints >> np.uint64(size * block)) & np.uint64((1 << size) - 1)
        body, last = word & ~free, word & free
        syndrome = np.zeros(len(prints), np.int64)
        for j, mask in enumerate(masks):
            syndrome |= (np.bitwise_count(body & np.uint64(mask)).astype(np.int64) & 1) << j
        off = syndrome > 0
        flip = np.where(off, np.uint64(1) << np.maximum(syndrome - 1, 0).astype(np.uint64), np.uint64(0))
        top = np.uint64(block << 32)
        near = body ^ flip
        for keys in (near | last, near | (last ^ free)):
            all_at.append(index)
            all_keys.append(keys | top)
        for i in range(1, size):  # two bits i < j away: their numbers add up, bit by bit, to the syndrome
            j = syndrome ^ i
            some = off & (j > i)
            bits = (np.uint64(1) << np.uint64(i - 1)) | (np.uint64(1) << np.maximum(j - 1, 0).astype(np.uint64))
            all_at.append(index[some])
            all_keys.append((body ^ bits)[some] | last[some] | top)
    return np.concatenate(all_at), np.concatenate(all_keys)


def _near(prints: np.ndarray, others: np.ndarray, thresholds: tuple[int, ...]) -> np.ndarray:
    """Which pairs are within the thresholds; the last axis holds the fingerprints of one text."""
    out = np.bitwise_count(prints[..., 0] ^ others[..., 0]) <= thresholds[0]
    for k in range(1, len(thresholds)):
        out &= np.bitwise_count(prints[..., k] ^ others[..., k]) <= thresholds[k]
    return out


def near_roots(prints: np.ndarray, thresholds: tuple[int, ...]) -> np.ndarray:
    """For each row of fingerprints the first row it is linked to, over any rows between.

    Rows are compared with those not yet reached, once.
    """
    n = len(prints)
    root = np.arange(n)
    linked = np.zeros(n, bool)
    step = max(1, (1 << 20) // max(n, 1))
    for a in range(0, n, step):  # most rows have no link at all
        near = _near(prints[a : a + step, None], prints[None], thresholds)
        linked[a : a + step] = near.sum(axis=1) > 1
    left = np.flatnonzero(linked)
    while len(left):
        start, left = left[0], left[1:]
        queue = [start]
        while queue and len(left):
            near = _near(prints[left], prints[queue.pop()], thresholds)
            found = left[near]
            root[found] = start
            queue.extend(found.tolist())
            left = left[~near]
    return root


def _links_of(keys: np.ndarray, prints: np.ndarray, thresholds: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within whole groups of equal, sorted keys: each linked row with the first one reached from it."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    linked = sizes > 16
    group = np.repeat(np.arange(len(starts)), sizes)
    for k in range(1, 16):  # which of the smaller groups hold any link
        if k >= len(keys):
            break
        near = (keys[k:] == keys[:-k]) & _near(prints[k:], prints[:-k], thresholds)
        linked[group[:-k][near]] = True
    for g in np.flatnonzero(linked):
        own = prints[starts[g] : starts[g] + sizes[g]]
        root = near_roots(own, thresholds)
        other = root != np.arange(len(own))
        if other.any():
            yield own[other], own[root[other]]


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy() for n in names], axis=1).view(np.uint64)


def _anchor_links(copies: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """``(u..., v...)`` links among the fingerprints that share a ``key``. Holds one key's members at a time."""
    names = print_names(len(thresholds))
    sides = [side + n[5:] for side in ("u", "v") for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, np.int64), np.zeros((0, len(names)), np.uint64)

        def links(upto: int) -> Iterator[pa.RecordBatch]:
            found = list(_links_of(keys[:upto], prints[:upto], thresholds)) if upto > 1 else []
            if found:
                both = np.concatenate([np.concatenate(x) for x in zip(*found)], axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in both.T.copy()], sides)

        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            prints = np.concatenate([prints, _columns(batch, names)])
            border = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            yield from links(border)
            keys, prints = keys[border:], prints[border:]
        yield from links(len(keys))

    dealt = copies.repartition(parts(copies.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(giving_back(run), ", ".join(f"{n} long" for n in sides))


def _piece_keys(threshold: int, blocks: int) -> Column:
    """Keys of a fingerprint at an anchor, by each of ``threshold + 1`` pieces of the blocks that are not the anchor's own."""
    size = BITS // blocks
    ends = [(BITS - size) * i // (threshold + 1) for i in range(threshold + 2)]
    # Turned so that the anchor's own block is on top; shifts by 64 are shifts by 0.
    turn = f"cast({size} * (shiftright(key, 32) + 1) as int)"
    turned = f"(shiftrightunsigned(print, {turn}) | shiftleft(print, {BITS} - {turn}))"
    pieces = [F.expr(f"shiftrightunsigned({turned}, {a}) & {(1 << (b - a)) - 1}L") for a, b in zip(ends, ends[1:])]
    return F.array(*[F.xxhash64("key", F.lit(i), piece) for i, piece in enumerate(pieces)])


def fingerprint_links(prints: DataFrame, thresholds: tuple[int, ...] = (THRESHOLD,), blocks: int = BLOCKS, members: int = ANCHOR_MEMBERS) -> DataFrame:
    """``(u..., v...)`` links that connect all rows of fingerprints (distinct) within as many bits as ``thresholds`` says.

    Rows meet by their first fingerprint. Not every pair is given: the links
    within one anchor are stars, which connect the same fingerprints. An anchor
    with more than ``members`` rows is divided by pieces of the blocks that are
    not its own, one more than the bits that may differ: one piece is then equal
    in any two that link, so no link is lost by that, whatever the table's size.
    Where pieces do not make the comparisons fewer, as among many near copies,
    the anchor stays as it is. A key that still has more than ``members`` rows is
    cut into sets of half as many, and every two sets meet in a key of their own:
    no task holds more than about ``members`` rows of a key. The work on
    such a key grows with the square of its size, over as many keys.
    """
    names = print_names(len(thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _columns(batch, names)
            for at in range(0, len(own), 4096):
                some = own[at : at + 4096]
                index, keys = anchors(some[:, 0], blocks)
                columns = [pa.array(c) for c in some[index].view(np.int64).T.copy()]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *columns], ["key", *names])

    schema = ", ".join(f"{n} long" for n in ["key", *names])
    copies = stored(prints.select(*names).mapInArrow(giving_back(run), schema), "anchors")
    crowded = stored(copies.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > members), "crowded")
    if crowded.isEmpty():
        return _anchor_links(copies, thresholds)
    usual = copies.join(crowded, "key", "left_anti")
    hot = copies.join(crowded, "key")
    pieces = hot.select(F.col("key").alias("anchor"), "n", F.explode(_piece_keys(thresholds[0], blocks)).alias("key"), *names)
    sizes = stored(pieces.groupBy("anchor", "n", "key").agg(F.count("*").alias("size")), "pieces")
    pairs = F.sum(F.col("size").cast("double") * F.col("size"))
    whole = stored(sizes.groupBy("anchor", "n").agg(pairs.alias("pairs")).where(F.col("pairs") >= F.col("n").cast("double") * F.col("n")).select("anchor", "n"), "whole")
    divided = sizes.join(whole, "anchor", "left_anti").select("key", F.col("size").alias("n"))
    large = stored(divided.where(F.col("n") > members).union(whole.select(F.col("anchor").alias("key"), "n")), "large")
    rows = pieces.join(whole, "anchor", "left_anti").select("key", *names)
    rows = rows.union(hot.join(whole.select(F.col("anchor").alias("key")), "key", "left_semi").select("key", *names))
    small = rows.join(large, "key", "left_anti")
    return _anchor_links(usual, thresholds).union(_anchor_links(small, thresholds)).union(_anchor_links(_set_pairs(rows.join(large, "key"), names, members), thresholds))


def _set_pairs(rows: DataFrame, names: list[str], members: int) -> DataFrame:
    """``rows`` of keys with ``n`` members each, under a key for every two sets of half of ``members``."""
    sets = F.ceil(2 * F.col("n") / members).cast("int")
    dealt = rows.withColumn("sets", sets).withColumn("own", F.pmod(F.xxhash64(F.lit("set"), *names), F.col("sets")).cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("sets") - 1)).alias("other")).where(F.col("other") != F.col("own"))
    return met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *names)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: tuple[int, ...] = (3,),
    thresholds: tuple[int, ...] = (THRESHOLD,),
    blocks: int = BLOCKS,
    members: int = ANCHOR_MEMBERS,
) -> DataFrame:
    """``(id_col, print..., component_id, root)`` of every row of ``docs``; ``root`` is one fingerprint of the component.

    ``component_id`` is the smallest id among all documents reachable over links:
    pairs of which the fingerprint for each length of shingles differs in at most
    the bits in ``thresholds``. Equal fingerprints (copies, and all
    texts without words, which have fingerprint 0) are made one before any
    comparison. Null and empty texts count as texts without words; rows with a
    null id belong to their component but cannot name it, so a component of such
    rows only has a null id; repeated rows are all returned. Other columns of
    ``docs`` are not looked at. An empty table gives an empty table.

    All links within 5 bits of the first fingerprint are found with 2 blocks, all
    within 11 with 4; of links at more bits those whose fingerprints meet.
    """
    names = print_names(len(shingle_words))
    made = stored(fingerprints(docs, id_col, text_col, shingle_words), "prints")
    distinct = stored(made.groupBy(*names).agg(F.min(id_col).alias("least")), "distinct")
    node = (lambda side: F.col(side)) if len(names) == 1 else (lambda side: F.struct(*[F.col(side + n[5:]).alias(n) for n in names]))
    links = fingerprint_links(distinct, thresholds, blocks, members).select(node("u").alias("u"), node("v").alias("v"))
    roots = stars(links).select(F.col("u").alias("node"), F.col("v").alias("root"))
    named_node = F.col("print") if len(names) == 1 else F.struct(*names)
    rooted = distinct.withColumn("node", named_node).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # The root is one of its component's fingerprints, so a component's rows meet by aggregation.
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(named, "root").select(*names, "component_id", "root")
    return made.join(by_print, names).select(id_col, *names, "component_id", "root")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays, unchanged.

    ``options`` are those of ``near_duplicates``. Of several rows with that id
    one stays, the first by text. A row without an id goes if its component has
    rows with one; of a component without ids one row stays. Texts without words are one group.
    """
    found = stored(near_duplicates(docs, id_col, text_col, **options), "groups")
    ids, tag, columns = F.col(id_col), uuid.uuid4().hex, [F.col(f"`{c}`") for c in docs.columns]
    # Names that no column of the table has.
    other, own, made, component, root, place = (f"_{n}_{tag}" for n in ("id", "print", "made", "component", "root", "place"))
    repeated = stored(docs.groupBy(id_col).agg(F.count("*").alias(place)).where((F.col(place) > 1) | ids.isNull()).select(ids.alias(other)), "repeated")
    dropped = stored(found.where(ids != F.col("component_id")).select(id_col).distinct(), "dropped")
    same = ids.eqNullSafe(F.col(other))
    usual = docs.join(repeated, same, "left_anti").join(dropped, id_col, "left_anti").select(*columns)
    if repeated.isEmpty():
        return usual
    words = options.get("shingle_words", (3,))[0]

    @F.pandas_udf("long")
    def print_of(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t or b"", words) for t in texts], np.uint64).view(np.int64))

    rare = docs.join(repeated, same, "left_semi").withColumn(made, print_of(F.col(text_col).cast("binary")))
    groups = found.groupBy(ids.alias(other), F.col("print").alias(own)).agg(F.min("component_id").alias(component), F.min("root").alias(root))
    known = rare.join(groups, ids.eqNullSafe(F.col(other)) & (F.col(made) == F.col(own)))
    firsts = known.where(ids.eqNullSafe(F.col(component)))
    one = Window.partitionBy(root).orderBy(text_col)
    kept = firsts.withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).select(*columns)
    return usual.union(kept)
