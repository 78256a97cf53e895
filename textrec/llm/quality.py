"""Graded quality of documents by ordinal regression on hashed words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrec.llm.common import giving_back

DIMENSIONS = 1 << 18

# Rated documents that a model is fitted on, at most; all documents are scored.
MAX_RATED = 8_000

# Rows handed back to Spark at a time.
ROWS_AT_ONCE = 1_024

STEPS = 150
RATE = 0.1
RIDGE = 3e-4

LETTERS = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalnum())
MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())

# The feature of words that repeat the one before.
REPEATS = xxhash.xxh64_intdigest(b"repeats", 3) % DIMENSIONS

# Values are divided by the number of words to this power.
LENGTH_POWER = 0.35

# Rated documents that must have a feature for it to get a weight.
LEAST_DOCUMENTS = 6

# Features of rated documents that are multiplied at a time while a model is fitted; sums keep their order.
ENTRIES_AT_ONCE = 1 << 18

# Words whose features a task remembers: the first it meets, which the frequent ones are among.
REMEMBERED = 150_000


class Features:
    """Hashed features of texts.

    Of every word: the word without marks around it, its first four, five and
    six bytes, its marks without letters, and whether it is in capitals or
    repeats the word before it.
    """

    def __init__(self):
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _of(self, word: bytes) -> tuple[int, ...]:
        bare, marks = word.strip(MARKS), word.translate(None, LETTERS)
        low = bare.lower()
        own = [(0, low), (4, low[:4]), (5, low[:5]), (6, low[:6]), (1, marks)]
        if len(bare) > 1 and bare != low and not any(97 <= c <= 122 for c in bare):
            own.append((2, b"capitals"))
        at = tuple(xxhash.xxh64_intdigest(x, seed) % DIMENSIONS for seed, x in own if len(x) >= seed - 3 and x)
        if len(self.known) < REMEMBERED:
            self.known[word] = at
        return at

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """``(index, value)``: a feature's value grows with the logarithm of its count and falls with the text's length."""
        counts: Counter[int] = Counter()
        known, words = self.known, (text or b"").split()
        for word, n in Counter(words).items():
            for at in known.get(word) or self._of(word):
                counts[at] += n
        again = sum(map(eq, words, words[1:]))
        if again:
            counts[REPEATS] += again
        index = np.fromiter(counts.keys(), np.int64, len(counts))
        value = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
        return index, value / max(1, len(words)) ** LENGTH_POWER


@dataclass(frozen=True)
class Ordinal:
    """Weights shared by all grades and the ordered thresholds between them."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """The probability of every grade above the lowest, or a higher one."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - np.asarray(score)[:, None], -500, 500)))


def fit(features: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, steps: int = STEPS) -> Ordinal:
    """Cumulative-link regression: ``P(grade <= j) = logistic(threshold j - weights . features)``.

    Maximum likelihood with a ridge penalty, by Adam over all rows at once, from
    zero weights: the same rows give the same model. Thresholds stay in order
    because all but the first are sums of positive gaps.
    """
    if not len(grades):
        return Ordinal(np.zeros(DIMENSIONS), np.arange(n_grades - 1, dtype=float))
    found = np.zeros(DIMENSIONS, np.int64)
    for at, _ in features:
        found[at] += 1
    used = np.flatnonzero(found >= min(LEAST_DOCUMENTS, len(grades)))
    number = np.full(DIMENSIONS, -1, np.int32)
    number[used] = np.arange(len(used))
    # Filled in place, as a list of the kept parts would be a second copy.
    most = sum(len(at) for at, _ in features)
    index, value, sizes, end = np.empty(most, np.int32), np.empty(most, np.float32), [], 0
    for at, own in features:
        known = number[at] >= 0
        sizes.append(int(known.sum()))
        index[end : end + sizes[-1]], value[end : end + sizes[-1]] = number[at][known], own[known]
        end += sizes[-1]
    index, value = index[:end], value[:end]
    row = np.repeat(np.arange(len(features), dtype=np.int32), sizes)
    share = np.array([(grades <= j).mean() for j in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    first, gaps = start[:1], np.log(np.maximum(np.diff(start), 0.1))
    state = np.concatenate([np.zeros(len(used)), first, gaps])
    low, high = np.zeros_like(state), np.zeros_like(state)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    every = np.arange(len(grades))
    blocks = [slice(a, a + ENTRIES_AT_ONCE) for a in range(0, len(index), ENTRIES_AT_ONCE)]
    for step in range(1, steps + 1):
        weights, first, gaps = state[: len(used)], state[len(used)], state[len(used) + 1 :]
        thresholds = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        score = np.zeros(len(grades))
        for at in blocks:
            np.add.at(score, row[at], value[at] * weights[index[at]])
        below = np.column_stack([np.zeros(len(grades)), logistic(thresholds - score[:, None]), np.ones(len(grades))])
        lower, upper = below[every, grades], below[every, grades + 1]
        chance = np.maximum(upper - lower, 1e-12)
        by_score = (1 - upper - lower) / len(grades)
        slope = below * (1 - below) / chance[:, None] / len(grades)
        by_threshold = np.zeros(n_grades + 1)
        np.add.at(by_threshold, grades + 1, -slope[every, grades + 1])
        np.add.at(by_threshold, grades, slope[every, grades])
        by_threshold = by_threshold[1:-1]
        later = np.cumsum(by_threshold[::-1])[::-1]
        by_weight = np.zeros(len(used))
        for at in blocks:
            np.add.at(by_weight, index[at], value[at] * by_score[row[at]])
        gradient = np.concatenate([
            by_weight + RIDGE * weights,
            [by_threshold.sum()],
            later[1:] * np.exp(gaps),
        ])
        low = 0.9 * low + 0.1 * gradient
        high = 0.999 * high + 0.001 * gradient**2
        rate = RATE * min(1.0, 3 * (1 - (step - 1) / steps))  # smaller in the last third, so that the end lies still
        state = state - rate * (low / (1 - 0.9**step)) / (np.sqrt(high / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(DIMENSIONS)
    weights[used] = state[: len(used)]
    return Ordinal(weights, state[len(used)] + np.concatenate([[0], np.cumsum(np.exp(state[len(used) + 1 :]))]))


def fit_graded(
    docs: DataFrame,
    ratings: DataFrame,
    n_grades: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    grade_col: str = "grade",
    max_rated: int = MAX_RATED,
) -> Ordinal:
    """A model of the grades 0 to ``n_grades - 1`` of rated documents.

    At most ``max_rated`` rated ids take part, chosen by a hash of the id, and one
    row for each, the one whose text has the least digest, so the ids that are
    broadcast and the one task that fits the model are bounded, however often an
    id comes. Null ids and null grades take no part; an id with several ratings
    counts by the lowest. Null texts have no features. Without ratings all weights are 0.
    """
    rated = ratings.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull())
    rated = rated.groupBy(F.col(id_col).alias("id")).agg(F.min(grade_col).cast("long").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("id"), "id").limit(max_rated)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())), pa.array([m[1].astype(np.float32) for m in made], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "grade", "digest")], *columns], ["id", "grade", "digest", "at", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, grades = [], []
        for batch in batches:
            at, value = batch.column("at"), batch.column("value")
            ends, indexes, values = at.offsets.to_numpy(), at.values.to_numpy(), value.values.to_numpy()
            features += [(indexes[a:b], values[a:b]) for a, b in zip(ends, ends[1:])]
            grades += batch.column("grade").to_pylist()
        # Rows in one order, whatever order tasks ended in.
        order = sorted(range(len(features)), key=lambda i: (features[i][0].tobytes(), grades[i]))
        model = fit([features[i] for i in order], np.array([grades[i] for i in order], np.int64), n_grades)
        columns = [pa.array([model.weights.astype("<f4").tobytes()]), pa.array([model.thresholds.tolist()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["weights", "thresholds"])

    joined = named.join(F.broadcast(chosen), "id").select("id", "grade", F.xxhash64("text").alias("digest"), "text")
    rows = joined.mapInArrow(giving_back(run), f"id {named.schema['id'].dataType.simpleString()}, grade long, digest long, at array<int>, value array<float>")
    # Of an id's rows one is left, found task by task before any row moves.
    single = rows.groupBy("id").agg(F.min(F.struct("digest", "at", "value", "grade")).alias("row")).select("row.grade", "row.at", "row.value")
    # The rated rows, of which there are few, meet in one task; the driver gets the weights.
    row = single.repartition(1).mapInArrow(giving_back(learn), "weights binary, thresholds array<double>").first()
    if row is None:  # no partition at all
        return fit([], np.zeros(0, np.int64), n_grades)
    return Ordinal(np.frombuffer(row["weights"], "<f4").astype(np.float64), np.array(row["thresholds"]))


def grade_documents(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score, expected_grade, tails)`` of every row and whole text. Narrow.

    ``tails`` holds the probability of each grade above 0, or a higher one, and
    the expected grade is their sum. Null and empty texts have the score 0;
    repeated rows and null ids are graded like any; other columns are not looked
    at; an empty table gives no rows. The model that goes to the tasks has
    ``DIMENSIONS`` weights whatever the data.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = sent.value
        own, features = Ordinal(weights, thresholds), Features()
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column("text")]
            score = np.array([float(weights[at] @ value) for at, value in made], np.float64)
            tails = own.tails(score)
            columns = [batch.column("id"), pa.array(score), pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "score", "expected_grade", "tails"])

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(giving_back(run), f"id {kind}, score double, expected_grade double, tails array<double>")
    return made.withColumnRenamed("id", id_col)


def with_tail(docs: DataFrame, model: Ordinal, grade: int, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the probability ``name`` of ``grade`` or a higher one. Narrow; other columns pass as Arrow data.

    A column of ``docs`` with that name is an error.
    """
    if name in docs.columns:
        raise ValueError(f"column {name} exists already")
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = sent.value
        own, features = Ordinal(weights, thresholds), Features()
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(begin, ROWS_AT_ONCE)
                made = [features((t.as_py() or "").encode()) for t in batch.column(text_col)]
                score = np.array([float(weights[at] @ value) for at, value in made], np.float64)
                chance = pa.array(own.tails(score)[:, grade - 1])
                yield pa.RecordBatch.from_arrays([*batch.columns, chance], [*batch.schema.names, name])

    return docs.mapInArrow(giving_back(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def rated_grades(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)`` from the labels: 0 toxic, 1 low quality, 2 good. Unknown labels give no grade."""
    toxic, quality = F.col("toxic"), F.col("quality")
    grade: Column = F.when(toxic == 1, 0).when((toxic == 0) & (quality == 0), 1).when((toxic == 0) & (quality == 1), 2)
    return labels.select("doc_id", grade.alias("grade"))


GRADES = 3
GOOD = 2
