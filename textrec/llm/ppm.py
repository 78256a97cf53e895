"""Code length of texts under prediction by partial matching, with a trie learned from the corpus."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrec.llm.common import open_array, save_arrays, scratch, stored

# Longest context in bytes; contexts and symbol together fit a long.
ORDER = 5

# Ends a text and stands before it; no word holds it.
END = b"\n"

# Contexts and symbols in one part of the trie, and bytes scored at a time.
PART_GRAMS = 2_000_000
CHUNK = 1 << 19

# What a worker counts before it hands it on.
GRAMS_HELD = 1_500_000
WORDS_HELD = 300_000

# Words whose counts every worker has; the others are joined.
FREQUENT_WORDS = 200_000

# A table with a place for every context and symbol is used up to this size, a hash table beyond.
DENSE_CELLS = 1 << 21

NAMES = ["logs", "total", "left_out", "escape", "chain", "starts", "symbols"]


def normal_words(text: bytes | None) -> list[bytes]:
    """Words without white space 0x20 and 0x09-0x0D, A-Z lower-cased."""
    return (text or b"").lower().split()


def grams(texts: list[bytes], order: int) -> np.ndarray:
    """Each symbol of each text with the ``order`` before it: the symbol in the lowest byte, then backward."""
    joined = np.frombuffer(b"".join(END * order + t for t in texts), np.uint8)
    scored = np.ones(len(joined), bool)
    at = 0
    for t in texts:
        scored[at : at + order] = False
        at += order + len(t)
    code = joined.astype(np.int64)
    for j in range(1, order + 1):
        code[j:] |= joined[:-j].astype(np.int64) << (8 * j)
    return code[scored]


def count_grams(docs: DataFrame, text_col: str, order: int) -> DataFrame:
    """``(gram, word, n)``: how often each gram and each word is in all texts, one of the two being null.

    Counts are added up within a task first, and combined before the shuffle.
    """
    rows = docs.select(F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[bytes] = []
        size = 0

        def add() -> None:
            nonlocal codes, counts, waiting, size
            own, n = np.unique(grams(waiting, order), return_counts=True)
            codes, at = np.unique(np.concatenate([codes, own]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(codes)).astype(np.int64)
            waiting, size = [], 0

        def out() -> pa.RecordBatch:
            empty = len(codes), len(words)
            columns = [
                pa.concat_arrays([pa.array(codes), pa.nulls(empty[1], pa.int64())]),
                pa.concat_arrays([pa.nulls(empty[0], pa.binary()), pa.array(list(words.keys()), pa.binary())]),
                pa.concat_arrays([pa.array(counts), pa.array(list(words.values()), pa.int64())]),
            ]
            return pa.RecordBatch.from_arrays(columns, ["gram", "word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                own = normal_words(text.as_py())
                words.update(own)
                words[END] += 1
                whole = b" ".join(own) + END
                # A very long text in pieces: each but the first begins with the context it follows.
                for at in range(0, len(whole), CHUNK):
                    if at:
                        piece = grams([whole[at - order : at + CHUNK]], order)[order:]
                        extra, n = np.unique(piece, return_counts=True)
                        codes, where = np.unique(np.concatenate([codes, extra]), return_inverse=True)
                        counts = np.bincount(where, np.concatenate([counts, n]), len(codes)).astype(np.int64)
                    else:
                        waiting.append(whole[:CHUNK])
                        size += len(waiting[-1])
                if size >= 4 * CHUNK:
                    add()
                if len(codes) >= GRAMS_HELD or len(words) >= WORDS_HELD:
                    yield out()
                    words.clear()
                    codes, counts = codes[:0], counts[:0]
        add()
        yield out()

    made = rows.mapInArrow(run, "gram long, word binary, n long")
    return made.groupBy("gram", "word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Cut:
    """Which part of the trie a context is in, by as many of its last bytes as keep parts small.

    ``leaves`` has for each number of bytes the endings, sorted, and their parts;
    no ending is the ending of another. ``shared`` has the entries of contexts so
    short that they are cut between parts; every part holds these whole.
    """

    parts: int
    leaves: list[tuple[np.ndarray, np.ndarray]]
    shared: list[tuple[np.ndarray, np.ndarray]]

    @property
    def depth(self) -> int:
        return len(self.leaves)

    def part_of(self, contexts: np.ndarray) -> np.ndarray:
        """Endings that the corpus never had are in the first part: what is known of them is in all."""
        out = np.zeros(len(contexts), np.int32)
        for depth, (endings, numbers) in enumerate(self.leaves, 1):
            if len(endings):
                own = contexts & ((1 << (8 * depth)) - 1)
                at = np.minimum(np.searchsorted(endings, own), len(endings) - 1)
                hit = endings[at] == own
                out[hit] = numbers[at[hit]]
        return out


class Trie:
    """Contexts of up to ``order`` bytes with the logarithms that scoring needs.

    Level L holds the contexts of L bytes and, one byte longer, the symbols seen
    after them. ``children[L]`` leads from a context and the next symbol to that
    symbol's entry, ``context[L]`` from such an entry to the context it makes for
    the symbol after it. Escapes have the chance of method C: a context with n
    symbols, d of them different, escapes with d / (n + d). Below an escape the
    symbols of the longer context are excluded.
    """

    @staticmethod
    def build(
        codes: np.ndarray,
        counts: np.ndarray,
        singles: np.ndarray,
        order: int,
        whole: bool = True,
        shared: list[tuple[np.ndarray, np.ndarray]] | None = None,
    ) -> dict[str, np.ndarray]:
        """Arrays of the trie of these grams; ``singles`` counts each symbol in the whole corpus.

        ``shared`` has for contexts of one byte, two and so on the entries, with
        counts in the whole corpus, of those that are cut between parts.
        """
        out: dict[str, np.ndarray] = {}
        symbols = np.flatnonzero(singles)
        alphabet = np.full(256, -1, np.int64)
        alphabet[symbols] = np.arange(len(symbols))
        entry_code, entry_n = [], []
        for length in range(1, order + 2):
            if length == 1:
                own, n = symbols.astype(np.int64), singles[symbols]
            else:
                own, at = np.unique(codes & ((1 << (8 * length)) - 1), return_inverse=True)
                n = np.bincount(at, counts, len(own)).astype(np.int64)
                if length - 2 < len(shared or []):
                    more, more_n = shared[length - 2]
                    others = ~np.isin(own >> 8, more >> 8)
                    own, n = np.concatenate([own[others], more]), np.concatenate([n[others], more_n])
                    by_code = np.argsort(own)
                    own, n = own[by_code], n[by_code]
            entry_code.append(own)
            entry_n.append(n)
        parents, owner = [], []
        for own in entry_code:
            context, at = np.unique(own >> 8, return_inverse=True)
            parents.append(context)
            owner.append(at)
        if not len(symbols):
            parents[0] = np.zeros(1, np.int64)
        total = [np.bincount(a, n, len(p)) for a, n, p in zip(owner, entry_n, parents)]
        kinds = [np.bincount(a, minlength=len(p)).astype(float) for a, p in zip(owner, parents)]
        left_out, escape, chain = [np.log10(np.maximum(256 - kinds[0], 1))], [np.zeros(1)], [np.zeros(1)]
        for level in range(1, order + 1):
            below = np.searchsorted(parents[level - 1], parents[level] & ((1 << (8 * (level - 1))) - 1))
            shorter = np.searchsorted(entry_code[level - 1], entry_code[level] & ((1 << (8 * level)) - 1))
            excluded = np.bincount(owner[level], entry_n[level - 1][shorter], len(parents[level]))
            kinds_left = kinds[level - 1][below] - kinds[level]
            rest = total[level - 1][below] - excluded + kinds_left
            sure = kinds_left <= 0
            left_out.append(np.log10(np.where(rest > 0, rest, 1)))
            step = np.where(sure, 0, np.log10(np.where(sure, 1, kinds_left)) - left_out[-1])
            escape.append(step)
            chain.append(step + chain[level - 1][below])
        for level in range(order + 1):
            parent, own = parents[level], entry_code[level]
            width = len(symbols)
            place = owner[level] * (width + 1) + alphabet[own & 255]
            # One context and one symbol more, which stand for none.
            if (len(parent) + 1) * (width + 1) <= DENSE_CELLS:
                table = np.full((len(parent) + 1) * (width + 1), -1, np.int32)
                table[place] = np.arange(len(own))
                out[f"children{level}"] = table
            else:
                out[f"keys{level}"], out[f"children{level}"] = place, Trie._hashed(place)
            if level < order:
                deeper = parents[level + 1]
                at = np.minimum(np.searchsorted(deeper, own), max(0, len(deeper) - 1))
                known = deeper[at] == own if len(deeper) else np.zeros(len(own), bool)
                out[f"context{level}"] = np.append(np.where(known, at, len(deeper)), len(deeper)).astype(np.int32)
            if not whole:
                out[f"parents{level}"] = parents[level]
        pads = [sum(END[0] << (8 * j) for j in range(level)) for level in range(order + 1)]
        starts = [int(np.searchsorted(p, c)) if c in p else len(p) for p, c in zip(parents, pads)]
        out["starts"] = np.array(starts, np.int64)
        out["symbols"] = np.append(np.where(alphabet < 0, len(symbols), alphabet), len(symbols)).astype(np.int32)
        # An entry with the logarithm 0 comes first, for symbols never seen.
        out["logs"] = np.concatenate([[0.0], *[np.log10(n) for n in entry_n]])
        out["total"] = np.concatenate([np.log10(np.maximum(t + d, 1)) for t, d in zip(total, kinds)])
        out["escape"] = np.concatenate([np.log10(np.maximum(d, 1)) - np.log10(np.maximum(t + d, 1)) for t, d in zip(total, kinds)])
        out["left_out"], out["chain"] = np.concatenate(left_out), np.concatenate(chain)
        out["entry_base"] = np.cumsum([1, *[len(e) for e in entry_code]])
        out["context_base"] = np.cumsum([0, *[len(p) for p in parents]])
        return out

    @staticmethod
    def _hashed(places: np.ndarray) -> np.ndarray:
        """Open addressing in a table at most two thirds full: the number of the entry in each slot, or -1."""
        bits = max(4, (3 * len(places) // 2).bit_length())
        table = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(places), dtype=np.int32)
        slot = Trie._slots(places, bits)
        while len(left):
            free = left[table[slot[left]] < 0]
            table[slot[free]] = free  # of several for one slot the last stays
            left = left[table[slot[left]] != left]
            slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
        return table

    @staticmethod
    def _slots(places: np.ndarray, bits: int) -> np.ndarray:
        return ((places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def __init__(self, arrays: dict[str, np.ndarray], order: int):
        self.parents = [arrays.get(f"parents{level}") for level in range(order + 1)]
        self.__dict__.update({k: arrays[k] for k in NAMES})
        self.order, self.width = order, int(arrays["symbols"][256])
        self.keys = [arrays.get(f"keys{level}") for level in range(order + 1)]
        self.children = [arrays[f"children{level}"] for level in range(order + 1)]
        self.context = [arrays[f"context{level}"] for level in range(order)]
        self.entry_base, self.context_base = arrays["entry_base"], arrays["context_base"]
        self.none = np.diff(self.context_base).tolist()  # the number after the last context, for none

    def _child(self, level: int, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The entry of each symbol after its context, or -1."""
        keys, children = self.keys[level], self.children[level]
        if keys is None:
            return children[before * (self.width + 1) + own]
        bits = len(children).bit_length() - 1
        found = np.full(len(before), -1, np.int32)
        left = np.flatnonzero((before < self.none[level]) & (own < self.width))
        place = before[left].astype(np.int64) * (self.width + 1) + own[left]
        slot = self._slots(place, bits)
        while len(left):
            there = children[slot]
            hit = (keys[there] == place) & (there >= 0)
            found[left[hit]] = there[hit]
            more = ~hit & (there >= 0)
            left, place, slot = left[more], place[more], (slot[more] + 1) & ((1 << bits) - 1)
        return found

    def _found(self, level: int, codes: np.ndarray) -> np.ndarray:
        """The contexts of ``level`` bytes with these codes; the number after the last for one that is not here."""
        parents = self.parents[level]
        if not len(parents):
            return np.zeros(len(codes), np.int32)
        found = np.minimum(np.searchsorted(parents, codes), len(parents) - 1)
        return np.where(parents[found] == codes, found, len(parents)).astype(np.int32)

    def symbol_logs(self, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log10 of the chance of each symbol by the whole trie. ``begins`` marks places that are no symbol but the begin of a text."""
        own, some = self.symbols[symbols], np.flatnonzero(~begins)
        state = np.zeros(len(symbols), np.int32)  # the context of this level that ends at each place
        levels = []
        for level in range(self.order + 1):
            before = np.empty_like(state)
            before[0], before[1:] = self.none[level], state[:-1]
            child = self._child(level, before, own)
            levels.append((before[some], child[some]))
            if level < self.order:
                state = self.context[level][child]
                state[begins] = self.starts[level + 1]
        return self._logs(levels)

    def chosen_logs(self, symbols: np.ndarray, endings: list[np.ndarray]) -> np.ndarray:
        """log10 of the chance of each symbol after the bytes in ``endings``, one array for each length from 1, by a part that has them."""
        own, levels = self.symbols[symbols], []
        for level in range(self.order + 1):
            before = self._found(level, endings[level - 1]) if level else np.zeros(len(symbols), np.int32)
            levels.append((before, self._child(level, before, own)))
        return self._logs(levels)

    def _logs(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """From the context of each length and the symbol's entry there, or -1."""
        entry, top, above = (np.full(len(levels[0][0]), x, np.int32) for x in (0, 0, -1))
        for level, (before, child) in enumerate(levels):
            np.add(child, self.entry_base[level], out=entry, where=child >= 0, casting="unsafe")
            np.add(before, self.context_base[level], out=top, where=before < self.none[level], casting="unsafe")
        for level in range(self.order, -1, -1):  # the shortest context that has not seen the symbol stays
            before, child = levels[level]
            np.add(before, self.context_base[level], out=above, where=(before < self.none[level]) & (child < 0), casting="unsafe")
        out = self.logs[entry]
        whole = above < 0
        out[whole] -= self.total[top[whole]]
        cut = np.flatnonzero(~whole)
        top, above = top[cut], above[cut]
        out[cut] += self.chain[top] - self.chain[above] + self.escape[top] - self.left_out[above]
        return out


def _endings(symbols: np.ndarray, begins: np.ndarray, most: int) -> list[np.ndarray]:
    """The 1, 2 and so on bytes, ``most`` at last, that end at each place, backward; before a text lie end symbols."""
    at = np.arange(len(symbols))
    since = at - np.maximum.accumulate(np.where(begins, at, 0))
    out, code = [], np.zeros(len(symbols), np.int64)
    for j in range(most):
        code = code | np.where(since > j, symbols[at - np.minimum(j, since)], END[0]).astype(np.int64) << (8 * j)
        out.append(code)
    return out


def _pieces(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(symbols, begins, owner, counted)`` of some texts, or pieces of long ones, at a time; the last two without the begins."""
    waiting: list[tuple[int, bytes, int]] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        symbols = np.frombuffer(b"".join(END + piece for _, piece, _ in waiting), np.uint8)
        lengths = np.array([len(piece) + 1 for _, piece, _ in waiting])
        begins = np.zeros(len(symbols), bool)
        begins[np.cumsum(lengths) - lengths] = True
        owner = np.repeat([i for i, *_ in waiting], lengths - 1)
        return symbols, begins, owner, np.concatenate([np.arange(len(piece)) >= skip for _, piece, skip in waiting])

    for i, text in enumerate(texts):
        for at in range(0, len(text), CHUNK):
            # The context of a later piece is read once more and not counted again.
            skip = order if at else 0
            waiting.append((i, text[at - skip : at + CHUNK], skip))
            size += len(waiting[-1][1]) + 1
            if size >= CHUNK:
                yield joined()
                waiting, size = [], 0
    if waiting:
        yield joined()


def scores(texts: list[bytes], tries: list[tuple[Trie, int]], cut: Cut) -> np.ndarray:
    """log10 of the chance of each text, by the parts of a trie and their numbers in the ``cut``.

    The bytes before a symbol say which part has its context, so each symbol is
    looked up in one part, however many there are.
    """
    out = np.zeros(len(texts))
    for symbols, begins, owner, counted in _pieces(texts, tries[0][0].order):
        if cut.parts == 1:
            logs = tries[0][0].symbol_logs(symbols, begins)
            out += np.bincount(owner[counted], logs[counted], len(texts))
            continue
        endings = _endings(symbols, begins, tries[0][0].order)
        places = np.flatnonzero(~begins)[counted]
        owner = owner[counted]
        part = cut.part_of(endings[cut.depth - 1][places - 1])
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(cut.parts + 1))
        for trie, number in tries:
            own = order[ends[number] : ends[number + 1]]
            if len(own):
                at = places[own]
                logs = trie.chosen_logs(symbols[at], [codes[at - 1] for codes in endings])
                out += np.bincount(owner[own], logs, len(texts))
    return out


def log_chance(count: Column | float, tokens: float, distinct: float):
    """log10 of a word's smoothed share of the training tokens."""
    share = (count + 0.5) / (tokens + 0.5 * (distinct + 1))
    return F.log10(share) if isinstance(share, Column) else math.log10(share)


def _cut(counts: DataFrame, order: int, part_grams: int) -> Cut:
    """Parts of at most ``part_grams`` grams. The driver gets a count for each ending that is looked at."""
    context = F.shiftright("gram", 8)
    left, found, shared = counts, [], []
    for depth in range(1, order + 1):
        ending = context.bitwiseAND(F.lit((1 << (8 * depth)) - 1))
        sizes = left.groupBy(ending.alias("ending")).agg(F.count("*").alias("n")).collect()
        crowded = [r["ending"] for r in sizes if r["n"] > part_grams and depth < order]
        found += [(r["ending"].to_bytes(depth, "little"), r["n"]) for r in sizes if r["n"] <= part_grams or depth == order]
        if not crowded:
            break
        left = left.where(ending.isin(crowded))
        code = F.col("gram").bitwiseAND(F.lit((1 << (8 * (depth + 1))) - 1))
        entries = sorted(left.groupBy(code.alias("code")).agg(F.sum("n").alias("n")).collect())
        shared.append((np.array([r["code"] for r in entries], np.int64), np.array([r["n"] for r in entries], np.int64)))
    number = held = 0
    leaves: list[list[tuple[int, int]]] = [[] for _ in range(max((len(e) for e, _ in found), default=0))]
    for i, (ending, n) in enumerate(sorted(found)):
        if i and held + n > part_grams:
            number, held = number + 1, 0
        leaves[len(ending) - 1].append((int.from_bytes(ending, "little"), number))
        held += n
    tables = [tuple(np.array(sorted(x), np.int64).reshape(-1, 2).T) for x in leaves]
    return Cut(number + 1, tables, shared)


def _parts(counts: DataFrame, order: int, cut: Cut) -> list[tuple[int, str]]:
    """The number and the shared folder of each part of the trie, built by tasks."""
    spark = counts.sparkSession
    singles = np.zeros(256, np.int64)
    for row in counts.groupBy(F.col("gram").bitwiseAND(255).cast("int").alias("symbol")).agg(F.sum("n").alias("n")).collect():
        singles[row["symbol"]] = row["n"]
    folder = scratch(spark, "trie")

    def written(codes: np.ndarray, n: np.ndarray) -> str:
        own = f"{folder}/{uuid.uuid4().hex}"  # a repeated task writes another one
        save_arrays(own, Trie.build(codes, n, singles, order, cut.parts == 1, cut.shared))
        return own

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = cut.part_of(batch.column("gram").to_numpy() >> 8)
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], ["part", "gram", "n"])

    def build(table: pa.Table) -> pa.Table:
        own = written(table.column("gram").to_numpy(), table.column("n").to_numpy())
        return pa.table({"part": table.column("part").slice(0, 1), "folder": pa.array([own])})

    dealt = counts.select("gram", "n").mapInArrow(deal, "part int, gram long, n long")
    made = dealt.groupBy("part").applyInArrow(build, "part int, folder string").collect()
    return [(r["part"], r["folder"]) for r in made] or [(0, written(np.zeros(0, np.int64), np.zeros(0, np.int64)))]


def load_trie(folder: str, order: int) -> Trie:
    """A part of the trie on an executor, mapped into memory."""
    levels = range(order + 1)
    arrays = {k: open_array(folder, k) for k in [*NAMES, "entry_base", "context_base", *[f"children{i}" for i in levels], *[f"context{i}" for i in range(order)]]}
    for part in [f"{x}{level}" for level in levels for x in ("keys", "parents")]:
        try:
            arrays[part] = open_array(folder, part)
        except FileNotFoundError:  # dense levels have no keys, and a whole trie needs no parents
            pass
    return Trie(arrays, order)


def score_documents(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    frequent: int = FREQUENT_WORDS,
    part_grams: int = PART_GRAMS,
) -> DataFrame:
    """``(id_col, n_tokens, n_known, train_tokens, base_score, score)`` of every row and whole text.

    The model learns from the rows where ``training`` is true (null: false). A
    text is its lower-cased words, joined by spaces, and an end symbol; ``score``
    is log10 of its chance by prediction by partial matching with contexts of up
    to ``order`` bytes, ``base_score`` that of its words and one end each on its
    own, by their smoothed share of the training tokens. ``n_known`` are tokens
    seen in training. Null and empty texts are the end alone; null ids are kept;
    repeated rows are all scored, and all learned from; other columns are not
    looked at; an empty table gives no rows. Without training rows every symbol
    has the chance 1/256, and every word that of one unseen.

    The trie is built by tasks, in parts of at most ``part_grams`` contexts and
    symbols, cut by as many of a context's last bytes as that takes. Tasks write
    the parts to the shared folder and map them into memory; every symbol is
    looked up in the part that has its context. The driver gets counts and names.
    Counts of at most ``frequent`` words go to every worker; the others are joined.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be from 1 to 6")
    spark = docs.sparkSession
    learned = stored(count_grams(docs.where(training), text_col, order), "counts")
    words = learned.where(F.col("word").isNotNull()).select("word", "n")
    tokens, distinct = (int(x or 0) for x in words.agg(F.sum("n"), F.count("*")).first())
    # Every count that occurs has a word at least, so the first ``frequent`` counts are enough.
    ranks = words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(frequent).collect()
    held, least = 0, None
    for row in ranks:
        held += row["words"]
        if held > frequent:
            break
        least = row["n"]
    common = words.where(F.col("n") >= least) if least is not None else words.limit(0)
    table = common.toArrow()
    sent = spark.sparkContext.broadcast(dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist())))
    unseen = log_chance(0, tokens, distinct)
    known_grams = learned.where(F.col("gram").isNotNull())
    cut = _cut(known_grams, order, part_grams)
    parts = _parts(known_grams, order, cut)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, row long, n_tokens long, n_known long, base_score double, score double, others array<struct<word:binary,n:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, at = sent.value, TaskContext.get().partitionId() << 33
        chances = {w: log_chance(n, tokens, distinct) for w, n in counts.items()}
        tries = [(load_trie(folder, order), number) for number, folder in sorted(parts)]
        kinds = pa.struct([("word", pa.binary()), ("n", pa.int64())])
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                some = batch.slice(begin, 512)
                texts, columns = [], [[], [], [], []]
                for text in some.column("text"):
                    own = normal_words(text.as_py())
                    texts.append(b" ".join(own) + END)
                    own.append(END)
                    known, base, others = 0, 0.0, []
                    for word, n in Counter(own).items():
                        chance = chances.get(word)
                        if chance is None:
                            others.append({"word": word, "n": n})
                        else:
                            known += n
                            base += n * chance
                    for column, value in zip(columns, (len(own), known, base, others)):
                        column.append(value)
                score = scores(texts, tries, cut)
                n_tokens, n_known, base_score, others = columns
                arrays = [
                    some.column("id"),
                    pa.array(range(at, at + len(texts)), pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array(n_known, pa.int64()),
                    pa.array(base_score, pa.float64()),
                    pa.array(score),
                    pa.array(others, pa.list_(kinds)),
                ]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(arrays, ["id", "row", "n_tokens", "n_known", "base_score", "score", "others"])

    path = scratch(spark, "scored")
    rows.mapInArrow(run, schema).write.parquet(path)
    scored = spark.read.schema(schema).parquet(path)
    others = scored.select("row", F.explode("others").alias("o")).select("row", "o.word", F.col("o.n").alias("times"))
    counted = others.join(words, "word", "left")
    chance = F.coalesce(log_chance(F.col("n"), tokens, distinct), F.lit(unseen))
    more = counted.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * chance).alias("more_base"),
    )
    whole = scored.drop("others").join(more, "row", "left")
    return whole.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
