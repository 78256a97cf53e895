"""Ordinal regression: its likelihood, held-out grades and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textrec.llm import quality
from textrec.llm.common import read


def graded(seed, n):
    """Texts whose grade is the number of kinds of good words in them."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        grade = int(rng.integers(0, 3))
        words = [f"f{w}" for w in rng.integers(0, 300, 40)] + ["good"] * (grade > 0) + ["great"] * (grade > 1) + ["bad"] * (grade == 0)
        rng.shuffle(words)
        rows.append((i, " ".join(words), grade))
    return rows


def test_held_out_grades(spark):
    rows = graded(1, 900)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, score string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows[:600]], "doc_id long, grade int")
    model = quality.fit_graded(docs, ratings, 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality.grade_documents(docs, model).collect()}
    right = [round(got[i].expected_grade) == g for i, _, g in rows[600:]]
    assert np.mean(right) > 0.95
    for r in got.values():
        assert r.tails[0] >= r.tails[1] and r.expected_grade == pytest.approx(sum(r.tails))
    assert quality.fit_graded(docs.repartition(7), ratings, 3).weights == pytest.approx(model.weights, abs=1e-4)


def test_thresholds_and_weights_are_at_a_maximum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = np.digitize(2 * x + rng.logistic(size=400), [-1.0, 0.5, 2.0])
    model = quality.fit([(np.array([7]), np.array([v])) for v in x], y, 4, steps=3000)

    def loss(weight, thresholds):
        below = np.column_stack([np.zeros(400), 1 / (1 + np.exp(-(thresholds - weight * x[:, None]))), np.ones(400)])
        return -np.log(below[np.arange(400), y + 1] - below[np.arange(400), y]).mean() + quality.RIDGE * weight**2 / 2

    best = loss(model.weights[7], model.thresholds)
    for step in (-0.02, 0.02):
        assert loss(model.weights[7] + step, model.thresholds) > best
        for k in range(3):
            assert loss(model.weights[7], model.thresholds + step * (np.arange(3) == k)) > best


def test_odd_rows_and_no_ratings(spark):
    docs = spark.createDataFrame([(None, "x"), (1, None), (2, ""), (2, ""), (3, "é " * 100_000), (4, "  \n")], "doc_id long, text string")
    ratings = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 2), (9, 1)], "doc_id long, grade int")
    model = quality.fit_graded(docs, ratings, 3)
    assert quality.grade_documents(docs, model).count() == 6
    blank = quality.fit_graded(docs, ratings.limit(0), 3)
    assert not blank.weights.any()
    assert {r.score for r in quality.grade_documents(docs, blank).collect()} == {0.0}
    assert quality.grade_documents(docs.limit(0), model).count() == 0
    assert quality.with_tail(docs, model, 2, "p").where(F.col("p").between(0, 1)).count() == 6


def test_features_and_scores_by_hand(spark):
    """Features counted word by word, and scores from a model of random weights."""
    from collections import Counter

    import xxhash

    def slow(text):
        words, counts = (text or "").encode().split(), Counter()
        for i, word in enumerate(words):
            bare, low = word.strip(quality.MARKS), word.strip(quality.MARKS).lower()
            marks = bytes(c for c in word if c in quality.MARKS or c < 0x80 and not chr(c).isalnum())
            named = [(0, low)] + [(n, low[:n]) for n in (4, 5, 6) if len(low) >= n - 3] + [(1, marks)]
            if len(bare) > 1 and bare != low and not any(c in bare for c in b"abcdefghijklmnopqrstuvwxyz"):
                named.append((2, b"capitals"))
            counts.update(xxhash.xxh64_intdigest(x, seed) % quality.DIMENSIONS for seed, x in named if x)
            counts[quality.REPEATS] += i > 0 and words[i - 1] == word
        return {at: (1 + np.log(n)) / max(1, len(words)) ** quality.LENGTH_POWER for at, n in counts.items() if n}

    texts = ["", None, "One two, two two (three) THREE! A", "É été -- 1,5 ABC ABC", "x" * 5000, "a " * 300]
    features = quality.Features()
    for text in texts * 2:
        at, value = features(text.encode() if text is not None else None)
        assert dict(zip(at.tolist(), value.tolist())) == pytest.approx(slow(text))
    rng = np.random.default_rng(3)
    model = quality.Ordinal(rng.normal(size=quality.DIMENSIONS).astype(np.float32).astype(float), np.array([-0.5, 0.7]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.grade_documents(docs, model).collect():
        score = sum(model.weights[at] * v for at, v in slow(texts[r.doc_id]).items())
        tails = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert (r.score, *r.tails, r.expected_grade) == pytest.approx((score, *tails, sum(tails)), abs=1e-4)


def test_an_id_counts_once(spark):
    """A rated id that a third of all rows have weighs as much as any other, by the text with the least digest."""
    rows = graded(2, 200)
    many = [(0, f"great words {i}") for i in range(300)]
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows[1:]] + many, "doc_id long, text string").repartition(6)
    first = docs.where("doc_id = 0").orderBy(F.xxhash64(F.col("text").cast("binary"))).first()
    alone = spark.createDataFrame([(i, t) for i, t, _ in rows[1:]] + [tuple(first)], "doc_id long, text string")
    assert quality.fit_graded(docs, ratings, 3).weights == pytest.approx(quality.fit_graded(alone, ratings, 3).weights, abs=1e-6)
    with pytest.raises(ValueError):
        quality.with_tail(docs.withColumn("p", F.lit(1)), quality.fit_graded(alone, ratings.limit(0), 3), 2, "p")


def test_given_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, grades = read(spark, folder, "documents"), quality.rated_grades(read(spark, folder, "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    model = quality.fit_graded(docs, grades.where(~held), 3)
    scored = quality.grade_documents(docs.join(grades.where(held), "doc_id"), model).join(grades, "doc_id")
    kept = {r.grade: r.kept for r in scored.groupBy("grade").agg(F.avg((F.col("tails")[1] >= 0.5).cast("double")).alias("kept")).collect()}
    assert kept[0] < 0.1 and kept[1] < 0.3 and kept[2] > 0.97


def test_fitting_holds_one_copy_of_the_features(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(0)
    features = [(rng.permutation(20_000)[:5_000].astype(np.int32), rng.random(5_000).astype(np.float32)) for _ in range(400)]
    grades = rng.integers(0, 3, 400)
    tracemalloc.start()
    try:
        model = quality.fit(features, grades, 3, steps=3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # Twelve bytes a feature: its number, value and row.
    assert peak < 12 * 2_000_000 + 24_000_000
    monkeypatch.setattr(quality, "ENTRIES_AT_ONCE", 1 << 30)
    whole = quality.fit(features, grades, 3, steps=3)
    assert np.array_equal(model.weights, whole.weights) and np.array_equal(model.thresholds, whole.thresholds)
