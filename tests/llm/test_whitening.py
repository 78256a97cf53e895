"""Whitening against a full decomposition of the covariance."""

import math

import numpy as np
import pytest

from textrec.llm import whitening
from textrec.llm.query_vectors import op13_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x double"


def slow(rows, components=32, scale=64, offset=1_000_000):
    """Ids, whole numbers, eigenvalues and vectors, whitened rows, from the covariance itself."""
    kept = [(r[0], [float(np.float32(c)) for c in r[1]]) for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    width = max((len(v) for _, v in kept), default=0)
    x = np.array([[math.floor(scale * c) + offset for c in [*v, *[0.0] * (width - len(v))]] for _, v in kept], object).reshape(len(kept), width)
    n, sums = len(kept), x.sum(axis=0)
    deviations = [int(d) for d in ((n * x - sums) ** 2).sum(axis=1)]
    y = ((n * x - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(np.einsum("ij,ik->jk", y, y) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-10 * max(values[0], 0)).sum()))
    return [i for i, _ in kept], deviations, values, np.einsum("ij,jk->ik", y, vectors[:, :k]) / np.sqrt(values[:k])


def check(got, rows, components=32, **options):
    ids, deviations, values, want = slow(rows, components, **options)
    k = want.shape[1]
    table = {}
    for r in got:
        table.setdefault((r[0], int(r.deviation)), {}).setdefault(r.component, []).append(r)
    assert len(got) == len(ids) * k
    found = np.zeros(want.shape)
    for c in range(1, k + 1):
        own = np.array([table[i, d][c][0].whitened for i, d in zip(ids, deviations)])
        found[:, c - 1] = own * (1 if (own * want[:, c - 1]).sum() > 0 else -1)
    assert np.abs(found - want).max() < 1e-7
    assert all(r.n == len(ids) and r.identity_error < 1e-10 for r in got)
    assert all(abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-10 for r in got)


def fixture(d, n=300):
    rng = np.random.default_rng(d)
    spread = np.linspace(0.4, 0.1, d) * np.where(np.arange(d) == 0, 6, 1)
    rows = [(i, (rng.normal(0.2, 1, d) * spread).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[1][1]) for i in range(n // 3)]  # one very common vector
    rows += [(2000, None), (2001, [None] * d), (2002, [float("nan")] * d), (2003, [float("-inf")] * d), (2004, []), (2005, [0.5]), (None, rows[2][1]), rows[3]]
    return [(*r, 1, 2, 3.0) for r in rows]


@pytest.mark.parametrize("d, components", [(6, 32), (70, 32), (70, 5)])
def test_as_the_covariance(spark, d, components):
    table = fixture(d)
    got = whitening.whitened(spark.createDataFrame(table, SCHEMA).repartition(5), components=components).collect()
    check(got, table, components)
    assert {r.component for r in got} == set(range(1, min(d, components) + 1))


def test_query_as_the_covariance(spark, tmp_path):
    table = fixture(60, 120)
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_whitening(spark, str(tmp_path))
    kinds = dict(got.dtypes)
    assert [kinds[c] for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")] == ["int", "bigint", "bigint", "double", "double", "double"]
    check(got.collect(), table)


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(1)
    table = [(i, (rng.normal(0, 1e7, 3) + 1e6 * i).tolist(), 1, 2, 3.0) for i in range(40)]
    got = whitening.whitened(spark.createDataFrame(table, SCHEMA), offset=10**9).collect()
    assert max(int(r.deviation) for r in got) > 1 << 63
    check(got, table, offset=10**9)


def test_no_variance_no_rows(spark):
    make = lambda rows: whitening.whitened(spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], SCHEMA)).collect()
    assert make([]) == [] and make([(1, None)]) == [] and make([(1, [])]) == []
    assert make([(1, [1.0, 2.0])]) == [] and make([(i, [1.0, 2.0]) for i in range(20)]) == []
    line = make([(i, [float(i), 2.0 * i, 5.0]) for i in range(20)])
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    with pytest.raises(Exception, match="2\\^31"):
        make([(1, [1e12])])


def test_equal_eigenvalues():
    """A spectrum with ties, a gap and one that stands out, against the matrix itself."""
    rng = np.random.default_rng(4)
    values = np.array([400.0, 90.0] + [60.0] * 40 + list(np.linspace(59, 50, 48)))
    q = whitening.orthonormal(rng.normal(size=(90, 90)))
    matrix = np.einsum("ij,j,kj->ik", q, values, q)
    calls = []

    def apply(block):
        calls.append(block.shape)
        return np.einsum("ij,jk->ik", matrix, block)

    found, vectors = whitening.leading_pairs(apply, 90, 32)
    assert np.abs(found - values[:32]).max() < 1e-9
    left = np.einsum("ij,jk->ik", matrix, vectors) - vectors * found
    assert np.abs(left).max() < 1e-9 and np.abs(np.einsum("ij,ik->jk", vectors, vectors) - np.eye(32)).max() < 1e-12
    assert len(calls) < 200 and max(s[1] for s in calls) <= 48


def test_eigenvalues_by_rotations():
    a = np.random.default_rng(3).normal(size=(30, 30))
    a = a + a.T
    values, vectors = whitening.symmetric_eigen(a)
    assert np.abs(np.einsum("ij,jk->ik", a, vectors) - vectors * values).max() < 1e-12 and (np.diff(values) <= 0).all()
