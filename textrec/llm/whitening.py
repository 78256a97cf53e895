"""Whitening on principal components, which Chebyshev-filtered subspace iteration finds by passes over the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrec.session import stored

# Directions carried beside those asked for, steps that look for the ends of the spectrum, and passes of one filter at most.
GUARDS, LANCZOS_STEPS, MOST_DEGREE = 16, 8, 12

# A pair is certified when its residual is below this share of the largest eigenvalue; the whole takes so many passes at most.
CERTIFIED, MOST_PASSES = 1e-13, 400

# Between the directions of a filtered block growth may differ by this much, so that rounding does not hide the smaller ones.
SPREAD = 1e8

# Components of a vector must be below this in size, as their whole numbers are summed exactly.
LARGEST = float(1 << 31)


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: float, offset: int) -> DataFrame:
    """``(id, x)``: ``floor(scale * c) + offset`` for every component of the vectors without null or non-finite ones."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    valid = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.forall("v", finite))

    def number(c):
        c = c.cast("double")
        fits = F.abs(c) < F.lit(LARGEST)
        return F.when(fits, F.floor(c * F.lit(float(scale))).cast("long") + F.lit(offset).cast("long")).otherwise(F.raise_error(F.lit("a component of a vector is 2^31 or more")).cast("long"))

    return valid.select("id", F.transform("v", number).alias("x"))


@dataclass(frozen=True)
class Centre:
    """Exact sums: ``n`` rows, ``sums`` per dimension. A missing component has the value ``fill``."""

    n: int
    sums: tuple[int, ...]
    fill: int

    @property
    def floors(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rests(self) -> list[int]:
        return [s % self.n for s in self.sums]

    def numbers(self, column: pa.Array) -> np.ndarray:
        """Rows less the whole part of the mean, in whole numbers."""
        lengths = np.diff(column.offsets.to_numpy())
        out = np.full((len(column), len(self.sums)), self.fill, np.int64)
        out[np.arange(len(self.sums)) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        return out - self.floors

    def centred(self, column: pa.Array) -> np.ndarray:
        """Rows less the mean."""
        return self.numbers(column) - np.array([r / self.n for r in self.rests])

    def deviations(self, numbers: np.ndarray) -> list[int]:
        """``sum (n x - S)^2`` of each row, exactly: with ``z`` the row less the floors and ``r`` the rests it is ``n^2 z.z - 2 n r.z + r.r``."""
        rests, n = self.rests, self.n
        most, width = int(np.abs(numbers).max(initial=0)), max(1, len(rests))
        small = max(most, 1) * max(most, max(rests, default=0), 1) * width < 1 << 62
        z = numbers if small else numbers.astype(object)
        r = np.array(rests, np.int64 if small else object)
        squares, crossed, rest = (z * z).sum(axis=1), (z * r).sum(axis=1), sum(x * x for x in rests)
        return [n * n * int(a) - 2 * n * int(b) + rest for a, b in zip(squares, crossed)]


def centre(rows: DataFrame, fill: int) -> Centre:
    """Sums over all rows; only a number per dimension reaches the driver."""
    n, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            column = batch.column("x")
            lengths, own = np.diff(column.offsets.to_numpy()), np.full((len(column), width), fill, np.int64)
            own[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
            total = [a + int(b) for a, b in zip(total, own.sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(map(str, total), pa.string())], ["k", "total"])

    if not n or not width:
        return Centre(n, (), fill)
    sums = rows.mapInArrow(run, "k int, total string").groupBy("k").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return Centre(n, tuple(int(r["total"]) for r in sums.orderBy("k").collect()), fill)


def summed(rows: DataFrame, size: int, part: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """The sum over all batches of rows of ``part``, ``size`` numbers; a task adds up its own before they are shuffled by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += part(batch.column("x"))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["k", "value"])

    made = rows.select("x").mapInArrow(run, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[made.column("k").to_numpy()] = made.column("value").to_numpy()
    return out


# The driver's own algebra is on matrices of a few dozen columns and uses plain sums: threaded BLAS may wait for ever beside Spark.


def _across(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ik->jk", a, b)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,jk->ik", a, b)


def orthonormal(block: np.ndarray, fixed: int = 0) -> np.ndarray:
    """The Q of a QR by Gram-Schmidt, done twice; the first ``fixed`` columns are so already.

    A column that depends on those before it is replaced by a random one.
    """
    out, rng = block.copy(), np.random.default_rng(7)
    for j in range(fixed, out.shape[1]):
        column, before = out[:, j], out[:, :j]
        while True:
            size = np.sqrt((column * column).sum())
            for _ in range(2):
                column = column - (before * (before * column[:, None]).sum(axis=0)).sum(axis=1)
            left = np.sqrt((column * column).sum())
            if left > 1e-12 * size:
                break
            column = rng.normal(size=len(column))
        column = column / left
        column = column - (before * (before * column[:, None]).sum(axis=0)).sum(axis=1)
        out[:, j] = column / np.sqrt((column * column).sum())
    return out


def symmetric_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors by Jacobi's rotations."""
    a, v = (matrix + matrix.T) / 2, np.eye(len(matrix))
    size = np.sqrt((a * a).sum())
    for _ in range(60):
        off = a - np.diag(np.diag(a))
        if np.sqrt((off * off).sum()) <= 1e-16 * size:
            break
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                if abs(a[p, q]) <= 1e-18 * size:
                    continue
                angle = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1 if angle >= 0 else -1) / (abs(angle) + np.sqrt(1 + angle * angle))
                c = 1 / np.sqrt(1 + t * t)
                s = t * c
                a[:, p], a[:, q] = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
                a[p], a[q] = c * a[p] - s * a[q], s * a[p] + c * a[q]
                v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


def spectrum_ends(apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, steps: int = LANCZOS_STEPS) -> tuple[float, float]:
    """Where the unwanted part of the spectrum lies, about: its lower end and the value that ``wanted`` eigenvalues exceed.

    Some Lanczos steps from a random vector; the weights of the Ritz values say
    how many eigenvalues lie about each. Wrong guesses cost passes and no more.
    """
    basis, diagonal, beside = [], [], []
    vector = np.random.default_rng(11).normal(size=d)
    vector /= np.sqrt((vector * vector).sum())
    for _ in range(min(steps, d)):
        basis.append(vector)
        after = apply(vector[:, None])[:, 0]
        diagonal.append(float((after * vector).sum()))
        for _ in range(2):
            for b in basis:
                after = after - (after * b).sum() * b
        beside.append(float(np.sqrt((after * after).sum())))
        if beside[-1] <= 1e-12 * max(map(abs, diagonal)):
            break
        vector = after / beside[-1]
    values, vectors = symmetric_eigen(np.diag(diagonal) + np.diag(beside[: len(diagonal) - 1], 1) + np.diag(beside[: len(diagonal) - 1], -1))
    low = max(0.0, values[-1] - beside[-1] * abs(vectors[-1, -1]))
    share = np.cumsum(vectors[0] ** 2)
    cut = values[min(len(values) - 1, int(np.searchsorted(share, wanted / d)))]
    return low, float(max(cut, low))


def chebyshev(apply: Callable[[np.ndarray], np.ndarray], block: np.ndarray, product: np.ndarray, low: float, cut: float, top: float, degree: int, hold: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``block`` times the Chebyshev polynomial that is small on ``[low, cut]``, scaled to its value at ``top``.

    ``product`` is ``apply(block)``, already known, so ``degree - 1`` passes are
    made. ``hold`` takes the certified directions out after every step.
    """
    middle, half = (low + cut) / 2, (cut - low) / 2
    first = half / (top - middle)
    ratio, before = first, block
    now = hold((product - middle * block) * (first / half))
    for _ in range(degree - 1):
        after = 1 / (2 / first - ratio)
        before, now = now, hold((apply(now) - middle * now) * (2 * after / half) - ratio * after * before)
        ratio = after
    return now


def leading_pairs(apply: Callable[[np.ndarray], np.ndarray], d: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``components`` largest eigenvalues, falling, and their unit eigenvectors, of the symmetric matrix that ``apply`` multiplies by.

    A block with some guard directions is filtered, made orthonormal and rotated
    to its Ritz vectors, in turns, until the residual of every pair asked for is
    certified. Certified pairs are held fixed and are not filtered again. A
    filter's degree follows from what is still missing and from the gap.
    """
    wanted, width = min(components, d), min(d, components + GUARDS)
    block = orthonormal(np.random.default_rng(5).normal(size=(d, width)))
    low, cut = spectrum_ends(apply, d, width) if width < d else (0.0, 0.0)
    passes, locked, worst = 0, 0, np.inf
    while True:
        product = apply(block)
        passes += 1
        values, turn = symmetric_eigen(_across(block, product))
        block, product = _times(block, turn), _times(product, turn)
        left = product - block * values
        size = np.sqrt((left * left).sum(axis=0))
        top = max(values[0], 0.0)
        fine = size <= CERTIFIED * top
        # Rounding sets a floor: when a whole turn no longer helps, pairs near it are as good as they get.
        stuck = width == d or (size[:wanted].max() >= worst / 2 and worst <= 100 * CERTIFIED * top)
        if top == 0 or stuck or fine[:wanted].all():
            return values[:wanted], block[:, :wanted]
        if passes > MOST_PASSES:
            raise RuntimeError(f"{MOST_PASSES} passes left a residual of {size[:wanted].max() / top:.1e} of the largest eigenvalue")
        worst = size[:wanted].max()
        locked = int(np.argmin(fine))
        cut = float(values[-1]) if passes > 1 else min(cut, float(values[-1]))
        low = low if low < cut else 0.0
        cut = max(cut, low + 1e-9 * top)
        middle, half = (low + cut) / 2, (cut - low) / 2
        growth = lambda value: (x := max((value - middle) / half, 1.0)) + np.sqrt(x * x - 1)
        slow, fast = max(np.log(growth(values[wanted - 1])), 1e-3), np.log(growth(values[locked]))
        need = np.ceil(np.log(max(worst / (CERTIFIED * top), 10)) / slow)
        degree = int(np.clip(min(need, np.log(SPREAD) / max(fast - slow, 1e-9)), 2, MOST_DEGREE))
        held = block[:, :locked]
        hold = lambda x: x - _times(held, _across(held, x))
        filtered = chebyshev(apply, block[:, locked:], product[:, locked:], low, cut, float(values[locked]), degree, hold)
        passes += degree - 1
        block = orthonormal(np.concatenate([held, filtered / np.maximum(np.sqrt((filtered * filtered).sum(axis=0)), 1e-300)], axis=1), locked)


def whitened(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = 32,
    scale: float = 64.0,
    offset: int = 1_000_000,
) -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)`` for every row and leading component.

    Vectors are taken as whole numbers ``x = floor(scale * c) + offset``.
    ``whitened`` is a row less the mean, projected on a unit eigenvector of the
    covariance (divisor ``n``) and divided by the root of its eigenvalue;
    components count from 1 by falling eigenvalue and have either sign.
    ``deviation`` is ``sum (n x - S)^2`` over the dimensions, exact, as a
    ``decimal(38,0)``; ``explained`` the eigenvalue's share of the trace;
    ``identity_error`` the largest absolute entry of the whitened rows'
    covariance less the identity.

    The covariance is never formed: each pass multiplies a block of directions
    by the centred rows and their transpose, task by task, and only the block
    itself, as many numbers as dimensions times directions, goes to the driver
    and back. Means are taken off in whole numbers first, so a large offset costs
    no precision.

    Rows whose vector is null or holds a null or non-finite component are left
    out. Missing components of a shorter vector, an empty one too, count as zeros. Rows with null
    or repeated ids are rows of their own. Components without variance (an
    eigenvalue within rounding of zero) are left out, so a single row, equal
    rows and an empty table give no rows. A component of 2^31 or more is an
    error. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = stored(whole_numbers(vectors, id_col, vector_col, scale, offset), "numbers")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation string, whitened double"
    mean = centre(rows, offset)
    d, n = len(mean.sums), mean.n

    def apply(block: np.ndarray) -> np.ndarray:
        def part(column: pa.Array) -> np.ndarray:
            own = mean.centred(column)
            return (own.T @ (own @ block)).ravel()

        return summed(rows, block.size, part).reshape(block.shape) / n

    if d:
        trace = float(summed(rows, 1, lambda column: np.array([(mean.centred(column) ** 2).sum()]))[0]) / n
        values, directions = leading_pairs(apply, d, components)
        real = values > 1e-13 * d * max(values[0], 0.0)
        values, directions = values[real], directions[:, real]
    k = len(values) if d else 0
    if not k:
        none = spark.createDataFrame([], schema)
        return _named(none, id_col, [], 0.0)
    scaled = directions / np.sqrt(values)

    def second(column: pa.Array) -> np.ndarray:
        own = mean.centred(column) @ scaled
        return np.concatenate([(own.T @ own).ravel(), own.sum(axis=0)])

    moments = summed(rows, k * k + k, second) / n
    covariance = moments[: k * k].reshape(k, k) - moments[k * k :, None] * moments[k * k :]
    error = float(np.abs(covariance - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2_048):
                some = batch.slice(at, 2_048)
                column = pa.concat_arrays([some.column("x")])
                numbers = mean.numbers(column)
                own = (numbers - np.array([r / n for r in mean.rests])) @ scaled
                each = np.repeat(np.arange(len(some)), k)
                deviations = pa.array([str(x) for x in mean.deviations(numbers)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(some))),
                        pa.array(np.full(len(each), n)),
                        deviations.take(pa.array(each)),
                        pa.array(own.ravel()),
                    ],
                    ["id", "component", "n", "deviation", "whitened"],
                )

    return _named(rows.mapInArrow(run, schema), id_col, (values / trace).tolist(), error)


def _named(made: DataFrame, id_col: str, explained: list[float], error: float) -> DataFrame:
    share = F.get(F.array(*[F.lit(x) for x in explained]).cast("array<double>"), F.col("component") - 1)
    return made.select(
        F.col("id").alias(id_col),
        "component",
        "n",
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened",
        share.alias("explained"),
        F.lit(error).alias("identity_error"),
    )
