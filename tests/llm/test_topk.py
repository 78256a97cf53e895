"""Top-k by bit slices against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textrec.llm.topk import BitSlicedIndex, top_k


def slow(rows, asked, k):
    ok = [(i, r[0], [math.floor(256 * float(np.float32(x))) for x in r[1]]) for i, r in enumerate(rows) if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for i, q, v in ok:
        if asked(q):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), c) for j, c, w in ok if j != i)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(32_768, 1_024), (50, 3)])
def test_as_all_inner_products(spark, sizes):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 16).astype(np.float32).tolist()) for i in range(200)]
    rows += [(200 + i, rows[3][1]) for i in range(150)]  # one very common vector: ties
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 16), (403, [float("inf")] * 16), (404, []), (410, [0.5]), (None, [0.1] * 16), (5, [0.3] * 16), (5, [0.3] * 16)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, row int").repartition(3)
    got = top_k(df, F.col("vec_id") % 5 == 0, 5, index_rows=sizes[0], block_queries=sizes[1])
    assert sorted(tuple(r) for r in got.collect()) == slow(rows, lambda q: q % 5 == 0, 5)


def test_too_long_vectors_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e17]), (1, [1e17])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="or longer"):
        top_k(df, F.lit(True)).collect()
    near = spark.createDataFrame([(0, [4e6]), (1, [-4e6])], "vec_id long, embedding array<double>")
    assert {r.score for r in top_k(near, F.lit(True)).collect()} == {-((256 * 4_000_000) ** 2)}


def test_bounds_and_stored_indexes():
    rng = np.random.default_rng(5)
    values, queries = rng.integers(-50, 60, (200, 5)), rng.integers(-9, 9, (30, 5))
    index = BitSlicedIndex(np.arange(200), values)
    assert (index.bounds(queries) >= (queries[:, None] * values).sum(axis=2).max(axis=1)).all()
    again = BitSlicedIndex.of(index.arrays())
    for q in queries:
        assert sorted(again.top(q, 7).tolist()) == sorted(index.top(q, 7).tolist()) == sorted(np.lexsort((np.arange(200), -(values * q).sum(axis=1)))[:7].tolist())


def test_fewer_rows_than_k_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert [tuple(r) for r in top_k(df, F.lit(True)).collect()] in ([(0, 1, 1, 131072), (1, 1, 0, 131072)], [(1, 1, 0, 131072), (0, 1, 1, 131072)])
    assert top_k(df.limit(0), F.lit(True)).count() == 0
    assert top_k(df, F.lit(None).cast("boolean")).count() == 0


def test_scores_come_out_of_the_slices():
    rng = np.random.default_rng(0)
    values = rng.integers(-200, 200, (130, 7))
    index = BitSlicedIndex(np.arange(130), values)
    query = rng.integers(-200, 200, 7)
    slices = index.score_slices(query)
    bits = np.array([np.unpackbits(s.view(np.uint8), bitorder="little", count=130) for s in slices]).astype(object)
    sums = (bits.T * [2**i for i in range(len(slices))]).sum(axis=1)
    exact = values @ query
    assert len(set((sums - exact).tolist())) == 1
