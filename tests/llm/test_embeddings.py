"""Near-duplicate vectors against all cosines."""

import math

import numpy as np
import pytest

from textrec.llm import embeddings
from textrec.llm.hnsw import Graph
from textrec.llm.query_vectors import op11_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node long, copies int"


def slow(rows, least=0.95):
    """``(id, n_links, component, kept)`` by all pairs of rows."""
    width = max([len(v) for _, v, *_ in rows if v is not None], default=0)
    own = []
    for _, v, *_ in rows:
        ok = v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        own.append(np.array([*np.float32(v).astype(float), *[0.0] * (width - len(v))]) if ok else None)
    n = len(rows)
    links = [[j for j in range(n) if j != i and own[i] is not None and own[j] is not None and (own[i] * own[j]).sum() / math.sqrt((own[i] ** 2).sum()) / math.sqrt((own[j] ** 2).sum()) >= least] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least_id = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), least_id, rows[i][0] == least_id))
    return sorted(out, key=repr)


def near(rng, v, spread):
    return (np.array(v) + rng.normal(0, spread, len(v))).tolist()


def fixture():
    rng = np.random.default_rng(3)
    rows = [rng.normal(size=12).tolist() for _ in range(150)]
    rows += [near(rng, rows[0], 0.03) for _ in range(120)]  # many near copies
    rows += [rows[1]] * 90  # one very common vector
    chain = rows[2]
    for _ in range(25):  # each links to the next, few to all
        chain = near(rng, chain, 0.17)
        rows.append(chain)
    rows += [[7 * x for x in rows[5]], [x * 1e-30 for x in rows[6]], [x * 1e30 for x in rows[7]]]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(rows)), rows)]
    rows += [(900, None), (901, []), (902, [0.0] * 12), (903, [1.0, None]), (904, [float("nan")] * 12), (905, [float("inf"), 1.0]), (906, [1.0]), (907, [2.0] + [0.0] * 11)]
    rows += [(None, rows[0][1]), (None, [0.0, -1.0]), rows[10], (rows[11][0], rows[12][1]), (950, [-0.0, 3.0]), (951, [0.0, 3.0])]
    return [(*r, 1, 2, 3) for r in rows]


def test_as_all_cosines(spark, rows):
    table = fixture()
    got = embeddings.near_vectors(spark.createDataFrame(table, SCHEMA).repartition(5))
    assert rows(got) == slow(table)
    assert rows(embeddings.near_vectors(spark.createDataFrame(table, SCHEMA), least=0.8)) == slow(table, 0.8)


def test_other_names_and_no_rows(spark, rows):
    table = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])]
    got = embeddings.near_vectors(spark.createDataFrame(table, "id long, v array<double>"), "id", "v")
    assert rows(got) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert embeddings.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    assert rows(embeddings.near_vectors(spark.createDataFrame([(4, None), (None, None)], "vec_id long, embedding array<float>"))) == [(4, 0, 4, True), (None, 0, None, True)]


def test_query_as_brute_force(spark, rows, tmp_path):
    table = fixture()
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows(op11_vectors(spark, str(tmp_path))) == slow(table)


def test_beams_widen_until_the_audit_passes(spark):
    table = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(0).normal(size=(40, 3)))]
    classes = spark.createDataFrame([(i, v, 1) for i, v in table], "node long, v array<double>, copies long")
    asked = []

    def search(queries, beam):
        asked.append((beam, queries.count()))
        found = 10_000 if beam >= 8 else 0
        return spark.createDataFrame([(found,)], "n long")

    beam, share = embeddings.audited_beam(classes, search, 3, 0.95, 0.995, 1, 1_000)
    assert beam == 8 and share > 1 and asked == [(b, 80) for b in (1, 2, 4, 8)]
    assert embeddings.audited_beam(classes, lambda q, b: spark.createDataFrame([(0,)], "n long"), 3, 0.95, 0.995, 4, 10)[0] == 10


def test_audit_rows_have_the_least_cosine():
    rng = np.random.default_rng(2)
    some = [{"node": i, "v": rng.normal(size=9).tolist()} for i in range(50)]
    nodes, found = embeddings._audit_rows(some, 9, 0.95)
    assert nodes.tolist() == [*range(50), *range(-1, -51, -1)]
    cosine = (found[:50] * found[50:]).sum(axis=1) / np.sqrt((found[:50] ** 2).sum(axis=1) * (found[50:] ** 2).sum(axis=1))
    assert ((cosine >= 0.95) & (cosine < 0.95001)).all()


@pytest.mark.parametrize("n", [1, 5, 300, 3_000])
def test_graphs_find_what_is_near(n):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n, 24))
    base[: n // 3] = base[0] + 0.05 * rng.normal(size=(n // 3, 24))  # a third is one group
    unit = (base / np.sqrt((base**2).sum(axis=1))[:, None]).astype(np.float32)
    unit = unit[rng.permutation(n)]
    graph = Graph.build(unit)
    assert all(x.shape[0] <= n and x.max(initial=-1) < x.shape[0] for x in graph.links)
    some = unit[:: max(1, n // 100)]
    truth = int((np.einsum("ij,kj->ik", some, unit) >= 0.9).sum())
    a, b = graph.near(some, np.full(len(some), -1, np.int32), 16, 0.9)
    assert len(set(zip(a.tolist(), b.tolist()))) == len(a) and 0.99 * truth <= len(a) <= truth + 2


def test_forests_connect_the_same():
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    a, b = embeddings.forest(u, v)

    def groups(x, y):
        root = list(range(400))
        find = lambda i: i if root[i] == i else find(root[i])
        for i, j in zip(x.tolist(), y.tolist()):
            root[max(find(i), find(j))] = min(find(i), find(j))
        return [find(i) for i in range(400)]

    assert groups(a, b) == groups(u, v) and len(a) < len(u)
