"""Repeated strings against looking up every window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textrec.llm.repeats import Pieces, remove_repeats


def slow(rows, window):
    """Ranges to remove of each row, rows in the order of ids (nulls first), then as given."""
    seen, out = set(), [None] * len(rows)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    for i in order:
        text = (rows[i][1] or "").encode()
        gone = np.zeros(len(text), bool)
        for a in range(len(text) - window + 1):
            string = text[a : a + window]
            if string in seen:
                gone[a : a + window] = True
            seen.add(string)
        turns = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int)))
        out[i] = (rows[i][0], len(text), turns[::2].tolist(), turns[1::2].tolist(), text[:0] if not len(text) else np.frombuffer(text, np.uint8)[~gone].tobytes())
    return out


def texts(seed, alphabet, n):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list(alphabet), rng.integers(1, 6)))
    passage = [" ".join(word() for _ in range(12)) for _ in range(4)]
    out = []
    for i in range(n):
        own = [" ".join(word() for _ in range(rng.integers(0, 15))) for _ in range(4)]
        for _ in range(rng.integers(0, 3)):
            own.insert(rng.integers(len(own)), passage[rng.integers(4)])
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed,window,anchor,alphabet", [(1, 20, 8, "abcdefgh"), (2, 20, 20, "ab"), (3, 30, 4, "é日ñ"), (4, 100, 32, "abcdefgh")])
def test_as_every_window(spark, seed, window, anchor, alphabet):
    own = texts(seed, alphabet, 60)
    own += [None, "", "a", "a" * 300, "ab" * 200, "a" * 300, own[0], own[0], own[5][10:], "xyz" * 1500]
    rows = [(i, t, i * 2, "clash") for i, t in enumerate(own)]
    rows += [(None, own[7], 0, "x"), (None, own[7], 0, "x"), (3, own[9], 1, "y"), (3, own[9], 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk long, bucket string").coalesce(1)
    got = remove_repeats(docs, window=window, anchor=anchor, chunk_bytes=700, memory=4096).collect()
    assert sorted([(r.doc_id, r.n_bytes, list(r.starts), list(r.ends), bytes(r.kept)) for r in got], key=repr) == sorted(slow(rows, window), key=repr)
    assert sorted((r.chunk, r.bucket) for r in got) == sorted((r[2], r[3]) for r in rows)


def test_equal_windows_have_equal_anchors_and_every_window_is_in_one_run():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, 400).astype(np.uint8)
    text[200:300] = text[50:150]
    pieces = Pieces(text, np.array([180, 0, 220]), 30, 7)
    runs = {}
    for k, a, b in zip(pieces.key.tolist(), pieces.first.tolist(), pieces.last.tolist()):
        for s in range(a, b + 1):
            assert s not in runs
            runs[s] = k
    assert sorted(runs) == [*range(151), *range(180, 371)]
    same = {}
    for s, k in runs.items():
        assert same.setdefault(text[s : s + 30].tobytes(), k) == k


def test_order_over_partitions_text_and_no_rows(spark):
    passage = "This passage is over one hundred bytes long, so that it counts as a repeated string in every document that has it. "
    rows = [(9, "B " + passage), (2, passage + "é A"), (5, passage)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    got = {r.doc_id: r.text for r in remove_repeats(docs, as_text=True).collect()}
    assert got == {2: passage + "é A", 5: "", 9: "B "}
    assert remove_repeats(docs, as_text=True).schema == docs.schema
    assert remove_repeats(docs.limit(0)).count() == 0
    assert remove_repeats(docs.where(F.col("doc_id") == 2)).select("kept").first()[0].decode() == passage + "é A"


def test_query_as_every_window(spark, tmp_path):
    import hashlib

    from textrec.llm.query_dedup import op3_suffixes

    own = texts(9, "abcdefgh", 40) + [None, "", "ab" * 200, "é" * 150]
    rows = list(enumerate(own + own[:3]))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in op3_suffixes(spark, str(tmp_path)).collect())
    want = [(i, n, sum(ends) - sum(starts), len(starts), hashlib.sha256(kept).hexdigest()) for i, n, starts, ends, kept in slow(rows, 100)]
    assert got == sorted(want) and sum(r[2] for r in want) > 1000


def test_no_stage_needs_two_python_workers_a_core(spark):
    """Workers stay for the stages that follow, so two in one stage are two in all of them."""

    def widths(node):
        """Python functions on the way down from each node to the next shuffle, the node's own first."""
        below = [widths(node.children().apply(i)) for i in range(node.children().size())]
        under = max([w[0] for w in below], default=0)
        own = 0 if "Exchange" in node.nodeName() else under + (node.nodeName() == "MapInArrow")
        return [own, *[n for w in below for n in w]]

    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        docs = spark.createDataFrame([(1, "a" * 300), (2, "a" * 300)], "doc_id long, text string")
        assert max(widths(remove_repeats(docs)._jdf.queryExecution().executedPlan())) == 1
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
