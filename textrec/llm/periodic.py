"""Periodic runs of words, found as matches on the diagonals of a text against itself."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A run has so many words, and so many times its period, at least.
LEAST_WORDS, LEAST_REPEATS = 6, 4

# Words whose diagonals are followed together, bytes of a text that are split at a time, bytes handed back at a time.
WORDS_AT_ONCE = 1 << 18
SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20

WHITE = re.compile(rb"[\x20\x09-\x0D]")
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_slices(text: bytes, size: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``size`` bytes."""
    at = 0
    while at < len(text):
        cut = WHITE.search(text, min(len(text), at + size))
        end = cut.start() if cut else len(text)
        yield text[at:end].split()  # of bytes: at 0x20 and 0x09-0x0D only
        at = end


def find_runs(words: np.ndarray, lengths: np.ndarray, least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS) -> np.ndarray:
    """Rows ``(start, length, period)`` of all runs in texts that lie one after the other; starts count over all texts.

    ``words`` are numbers of words, which no two texts share. Words ``q`` apart
    that are equal lie on diagonal ``q``; a diagonal's match length grows by one
    with every further word that has an earlier occurrence there, and where it
    ends after matches enough it gives a run. Following every earlier occurrence
    of a word would cost the square of its number. So lags are followed by
    level: for those from ``2**k`` on, below ``2**(k+1)``, an occurrence counts
    only with the ``2**(k+1) - 1`` words before it equal too, and only the
    nearest one does: were there one nearer than the period of the run around
    it, both lags would be periods there and so would be their common divisor
    (Fine and Wilf). By the same argument the lags that last are smallest
    periods and their ends are the runs' ends. A level looks only at words whose
    shorter contexts came twice. Costs ``n log n`` at most, in arrays as long as
    the texts. ``least_repeats`` must be 3 or more.
    """
    if least_repeats < 3:
        raise ValueError("a run must repeat its period three times at least")
    n, found = len(words), [np.zeros((0, 3), np.int64)]
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    whole = np.repeat(lengths, lengths)
    name, at, low = words.astype(np.int64), np.arange(n), 1
    while low * least_repeats <= lengths.max(initial=0):
        context = 2 * low
        at = at[(at - context + 1 >= first[at]) & (whole[at] >= low * least_repeats)]
        at = at[name[at - low] >= 0]
        if not len(at):
            break
        keys = name[at] * (int(name.max(initial=0)) + 1) + name[at - low]
        order = np.argsort(keys, kind="stable")
        ranked, places = keys[order], at[order]
        again = ranked[1:] == ranked[:-1]
        lag = np.zeros(len(at), np.int64)
        lag[order[1:][again]] = (places[1:] - places[:-1])[again]
        own = np.flatnonzero((lag >= low) & (lag < 2 * low))
        if len(own):
            ends = (at[own][1:] != at[own][:-1] + 1) | (lag[own][1:] != lag[own][:-1])
            begin, end = own[np.r_[True, ends]], own[np.r_[ends, True]]
            period = lag[begin]
            start = at[begin] - context + 1 - period
            length = at[end] - start + 1
            enough = length >= np.maximum(least_words, least_repeats * period)
            found.append(np.stack([start, length, period], axis=1)[enough])
        twice = np.r_[again, False] | np.r_[False, again]
        name = np.full(n, -1)
        name[places[twice]] = np.cumsum(np.r_[True, ~again])[twice]
        at, low = np.sort(places[twice]), context
    every = np.concatenate(found)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps)[:n] > 0


class _Group:
    """Texts whose diagonals are followed together."""

    def __init__(self) -> None:
        self.ids: list = []
        self.texts: list[bytes] = []
        self.held: list[list[list[bytes]] | None] = []
        self.words: list[np.ndarray] = []
        self.size = 0
        self.names = count()

    def add(self, doc, text: bytes) -> None:
        names = defaultdict(self.names.__next__)
        held, parts = [], [np.zeros(0, np.int64)]
        for words in word_slices(text):
            parts.append(np.fromiter(map(names.__getitem__, words), np.int64, len(words)))
            if len(text) <= SLICE_BYTES:
                held.append(words)
        self.ids.append(doc)
        self.texts.append(text)
        self.held.append(held if len(text) <= SLICE_BYTES else None)
        self.words.append(np.concatenate(parts))
        self.size += len(self.words[-1])

    def results(self, least_words: int, least_repeats: int) -> Iterator[tuple]:
        lengths = np.array([len(w) for w in self.words], np.int64)
        runs = find_runs(np.concatenate([np.zeros(0, np.int64), *self.words]), lengths, least_words, least_repeats)
        ends = np.cumsum(lengths)
        cut = np.searchsorted(runs[:, 0], np.r_[0, ends])
        for i, (doc, text, held) in enumerate(zip(self.ids, self.texts, self.held)):
            own = runs[cut[i] : cut[i + 1]] - [int(ends[i] - lengths[i]), 0, 0]
            slices = word_slices(text) if held is None else held
            if len(own):
                drop, at, kept = _dropped(own, int(lengths[i])), 0, []
                for words in slices:
                    part = [words[j] for j in np.flatnonzero(~drop[at : at + len(words)])]
                    at += len(words)
                    if part:
                        kept.append(b" ".join(part))
            else:
                kept = [b" ".join(words) for words in slices if words]
            yield doc, int(lengths[i]), [dict(zip(("start", "length", "period"), r)) for r in own.tolist()], b" ".join(kept)


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = LEAST_WORDS,
    least_repeats: int = LEAST_REPEATS,
) -> DataFrame:
    """``(id_col, n_words, runs, collapsed)`` of every row: its periodic runs, and its text with one period of each.

    Words are what lies between white space (0x20, 0x09 to 0x0D), numbered from
    0. A run is a stretch of words with smallest period ``q``, so that words
    ``q`` apart are equal, of ``least_words`` words and ``least_repeats`` periods
    or more, which neither neighbouring word extends. ``runs`` has their
    ``start``, ``length`` and ``period``, by start and then period. ``collapsed``
    has the words that no run holds after its first period, joined by one space.

    Null and empty texts have no words, no runs and an empty collapsed text.
    Null ids are kept, repeated rows answered each, other columns not looked at;
    an empty table gives no rows. Texts are taken whole: memory for a very long
    one is about 40 bytes a word beside the text. Narrow: no shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, group, kind = 0, _Group(), None

        def made() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), RUN, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["id", "n_words", "runs", "collapsed"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal out, size, group
            for row in group.results(least_words, least_repeats):
                out.append(row)
                size += len(row[3]) + 64 * len(row[2])
                if size >= BATCH_BYTES:
                    yield made()
                    out, size = [], 0
            group = _Group()

        for batch in batches:
            kind = batch.schema.field("id").type
            for doc, text in zip(batch.column("id"), batch.column("text")):
                group.add(doc.as_py(), text.as_py() or b"")
                if group.size >= WORDS_AT_ONCE or len(group.ids) >= WORDS_AT_ONCE // 16:
                    yield from flush()
        yield from flush()
        if out:
            yield made()

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return made.select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
