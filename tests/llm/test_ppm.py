"""PPM scores against a model that walks and excludes symbol by symbol."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from textrec.llm import ppm


def normal(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


def slow_score(text, learned, order):
    after = defaultdict(Counter)
    for t in learned:
        whole = b"\n" * order + normal(t)
        for i in range(order, len(whole)):
            for k in range(order + 1):
                after[whole[i - k : i]][whole[i]] += 1
    total, whole = 0.0, b"\n" * order + normal(text)
    for i in range(order, len(whole)):
        out = set()
        for k in range(order, -1, -1):
            counts = {s: n for s, n in after.get(whole[i - k : i], {}).items() if s not in out}
            if not counts:
                continue
            size = sum(counts.values()) + len(counts)
            if whole[i] in counts:
                total += math.log10(counts[whole[i]] / size)
                break
            total += math.log10(len(counts) / size)
            out |= set(counts)
        else:
            total -= math.log10(256 - len(out))
    return total


def slow_base(text, learned):
    counts = Counter(w for t in learned for w in [*normal(t).split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    own = [*normal(text).split(), b"\n"]
    return len(own), sum(w in counts for w in own), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)


def texts():
    rng = np.random.default_rng(1)
    words = [bytes(rng.choice(list(b"abcde"), rng.integers(1, 6))).decode() for _ in range(60)]
    out = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(60)]
    return out + ["", None, " \n\t", "Ünseen Zeichen ✓", "ABC abc", out[3], out[3]]


@pytest.mark.parametrize("order,part_grams,frequent,dense", [(5, 4_000_000, 200_000, 1 << 24), (3, 200, 5, 1 << 24), (2, 40, 0, 4), (5, 4_000_000, 20, 4)])
def test_as_symbol_by_symbol(spark, monkeypatch, order, part_grams, frequent, dense):
    monkeypatch.setattr(ppm, "DENSE_CELLS", dense)
    own = texts()
    docs = spark.createDataFrame([(i, t, i % 3 != 1, 1, "x") for i, t in enumerate(own)], "doc_id long, text string, use boolean, n long, word string").repartition(3)
    learned = [t for i, t in enumerate(own) if i % 3 != 1]
    got = {r.doc_id: r for r in ppm.score_documents(docs, F.col("use"), order=order, part_grams=part_grams, frequent=frequent).collect()}
    for i, t in enumerate(own):
        n, known, train, base = slow_base(t, learned)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, train)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
        assert got[i].score == pytest.approx(slow_score(t, learned, order), rel=1e-9)


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(2)
    long = " ".join(rng.choice(["one", "three", "fourteen", "a"], 400))
    docs = spark.createDataFrame([(1, long), (2, "one a three")], "doc_id long, text string")
    whole = {r.doc_id: r.score for r in ppm.score_documents(docs, F.lit(True)).collect()}
    monkeypatch.setattr(ppm, "CHUNK", 64)
    cut = {r.doc_id: r.score for r in ppm.score_documents(docs, F.lit(True)).collect()}
    assert cut == pytest.approx(whole) and whole[1] == pytest.approx(slow_score(long, [long, "one a three"], 5))


def test_chances_add_up_to_one():
    learned = [normal(t) for t in texts()]
    codes, counts = np.unique(ppm.grams(learned, 4), return_counts=True)
    singles = np.bincount(codes & 255, counts, 256).astype(np.int64)
    trie = ppm.Trie(ppm.Trie.build(codes, counts, singles, 4), 4)
    for context in (b"", b"a", b"abc ", b"zzz", b"de"):
        each = [np.frombuffer(b"\n" + context + bytes([s]), np.uint8) for s in range(256)]
        begins = np.arange(len(context) + 2) == 0
        assert sum(10 ** trie.symbol_logs(x, begins)[-1] for x in each) == pytest.approx(1)


def test_nothing_learned_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "ab"), (1, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score_documents(docs, F.lit(None).cast("boolean")).collect()}
    assert got[None].score == pytest.approx(-3 * math.log10(256)) and got[1].n_tokens == 1 and got[1].train_tokens == 0
    assert ppm.score_documents(docs.limit(0), F.lit(True)).count() == 0
    assert zlib.crc32(b"7") % 5 == spark.range(1).select(F.crc32(F.lit("7").cast("binary")) % 5).first()[0]


def test_parts_are_bounded_and_built_by_tasks(spark, monkeypatch):
    """A byte that ends nearly every context is cut by the bytes before it."""
    rng = np.random.default_rng(4)
    learned = [" ".join("e" * int(rng.integers(1, 9)) + "".join(rng.choice(list("ex"), 6)) for _ in range(40)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate([*learned, "qe eeq", "xeq"])), "doc_id long, text string").repartition(3)
    use = F.col("doc_id") < 30
    counts = ppm.count_grams(docs.where(use), "text", 5).where("gram IS NOT NULL").persist()
    cut = ppm._cut(counts, 5, 20)
    assert cut.depth > 1 and cut.parts > 3
    codes = np.array([r.gram for r in counts.collect()])
    assert np.bincount(cut.part_of(codes >> 8)).max() <= 20
    scored = {r.doc_id: r.score for r in ppm.score_documents(docs, use, part_grams=20).collect()}
    for i, t in enumerate([*learned, "qe eeq", "xeq"]):
        assert scored[i] == pytest.approx(slow_score(t, learned, 5), rel=1e-9)

    build = ppm.Trie.build

    def in_a_task(*args):
        assert TaskContext.get() is not None, "built on the driver"
        return build(*args)

    monkeypatch.setattr(ppm.Trie, "build", staticmethod(in_a_task))
    assert ppm.score_documents(docs, use, part_grams=20).count() == 32


def test_query_as_symbol_by_symbol(spark, tmp_path):
    from textrec.llm.query_text import op10_ppm

    own = texts()[:40]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(own))]
    learned = [t for t, h in zip(own, held) if not h]
    spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op10_ppm(spark, str(tmp_path)).collect()}
    for i, t in enumerate(own):
        n, known, train, base = slow_base(t, learned)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], n, known, train)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score == pytest.approx(slow_score(t, learned, ppm.ORDER), rel=1e-9)
    assert any(held) and not all(held)
