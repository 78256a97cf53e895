"""Rules held as a table, against loops over all of them."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textrec.operators import rules as r
from textrec.operators.rules import first_match_table

RULES = "priority int, keyword string, value string"


def loop_first(text, rules, default):
    """``rules`` sorted by priority and keyword."""
    if text is None:
        return default
    return next((value for _, word, value in rules if word in text.lower()), default)


def searched(words, texts):
    arrays = r.index_arrays([w.encode() for w in words], pa.array(list(range(len(words)))))
    searcher = r.Searcher(arrays)
    return [None if i == searcher.none else int(i) for i in searcher.first_rules(pa.array(texts, pa.string()))]


def slow(words, texts):
    return [None if t is None else next((i for i, w in enumerate(words) if w in t), None) for t in texts]


WORDS = ["abcdefghij", "bcdefgh", "xabcdefgh", "aaaaaaaaaaaaaaaaab", "aaaaaaaa", "é", "éé logue", "日本語テキスト", "q", "zq", "abcdefgh", "end of text", "\n", "zq", "aaaaaaaaa"]
TEXTS = ["abcdefg", "hij", "abcdefghi", "abcdefghij", "xabcdefghij", "a" * 17 + "b", "a" * 8, "a" * 7, None, "", "ééé logue", "日本語テキスト!", "日本語", "z", "q", "zq", "the end of text", "end of tex", "t", "a\nb", "\xa9"]


def test_keywords_of_all_lengths():
    assert searched(WORDS, TEXTS) == slow(WORDS, TEXTS)
    for i in range(len(WORDS)):  # each alone, so that no other hides it
        assert searched([WORDS[i]], TEXTS) == slow([WORDS[i]], TEXTS)
    assert searched(["none", "", "q"], TEXTS) == [None if t is None else 1 for t in TEXTS]
    assert searched([], TEXTS) == [None] * len(TEXTS) and searched(["a"], []) == []


def test_parts_of_an_array():
    arrays = r.index_arrays([w.encode() for w in WORDS], pa.array(list(range(len(WORDS)))))
    searcher = r.Searcher(arrays)
    texts, whole = pa.array(TEXTS * 3), slow(WORDS, TEXTS * 3)
    for a, n in ((0, 5), (3, 30), (20, 1), (40, 23)):
        got = [None if i == searcher.none else int(i) for i in searcher.first_rules(texts.slice(a, n))]
        assert got == whole[a : a + n]


@pytest.mark.parametrize("at_once", [7, 64, 1 << 19])
def test_random_words_and_texts(monkeypatch, at_once):
    monkeypatch.setattr(r, "PLACES_AT_ONCE", at_once)
    pick = random.Random(at_once)
    words = ["".join(pick.choice("abc") for _ in range(pick.choice([1, 3, 5, 7, 8, 9, 12, 20, 40]))) for _ in range(300)]
    words = [w for w in words if len(w) > 4] + ["ab", "cccc"]
    texts = ["".join(pick.choice("abc") if pick.random() < 0.9 else pick.choice(words) for _ in range(pick.randint(0, 60))) for _ in range(200)]
    assert searched(words, texts) == slow(words, texts)


def test_many_keywords_that_begin_alike():
    words = [f"https://example.org/{i:05}/page" for i in range(3000)] + ["https://example.org/"]
    texts = [f"see https://example.org/{i:05}/page there" for i in range(0, 3300, 100)]
    assert searched(words, texts) == slow(words, texts)


@pytest.mark.parametrize("per_index", [1, 2, 1000])
def test_rule_without_a_value_still_wins(spark, per_index):
    rules = spark.createDataFrame([(1, "one", None), (2, "TWO", "second"), (3, None, "never"), (4, "two", "late"), (None, "first", "null priority")], RULES)
    df = spark.createDataFrame([(1, "one two"), (2, "Two"), (3, "else"), (4, None), (5, "one FIRST")], "id int, x string")
    got = {row["id"]: row["label"] for row in first_match_table(df, rules, "x", "label", "default", per_index).collect()}
    assert got == {1: None, 2: "second", 3: "default", 4: "default", 5: "null priority"}


def test_values_of_other_types(spark):
    df = spark.createDataFrame([("one",), ("two",), ("three",)], "x string")
    rules = spark.sql("select 1 as priority, 'one' as keyword, struct(timestamp'2024-01-01 10:00:00' as t, array(1.50D) as a, 1.25 as d) as value union all select 2, 'two', null")
    expected = rules.where("priority = 1").first()["value"]
    got = {row["x"]: row["v"] for row in first_match_table(df, rules, "x", "v", None).collect()}
    assert got == {"one": expected, "two": None, "three": None}


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([("one", 1)], "x string, label int")
    none = spark.createDataFrame([], RULES)
    assert first_match_table(df, none, "x", "v", "d").collect() == [("one", 1, "d")]
    some = spark.createDataFrame([(1, "on", "v")], RULES)
    assert first_match_table(df.limit(0), some, "x", "v", "d").collect() == []
    assert first_match_table(df, some, "x", "label", "d").collect() == [("one", "v")]


def test_a_hundred_thousand_rules(spark):
    pick = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzé "
    words = {"".join(pick.choice(letters) for _ in range(pick.choice([5, 6, 9, 12, 30]))) for _ in range(103_000)}
    words = sorted(words, key=lambda _: pick.random())[:100_000]
    rules = [(i // 3, w, f"v{i}") for i, w in enumerate(words)]
    ordered = sorted(rules, key=lambda x: (x[0], x[1].encode()))
    texts = [(i, "".join(pick.choice(letters) for _ in range(pick.randint(0, 300))) + (pick.choice(words).upper() if i % 3 else "")) for i in range(300)]
    table = spark.createDataFrame(rules, RULES).repartition(5)
    df = spark.createDataFrame(texts, "id int, x string").repartition(4)
    for per_index in (30_000, r.RULES_PER_INDEX):
        index = r.build_index(table, per_index)
        assert len(index.folders) >= 100_000 // per_index
        got = r.with_first_match(df, index, "x", "label", "none")
        assert {row["id"]: row["label"] for row in got.collect()} == {i: loop_first(x, ordered, "none") for i, x in texts}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("ArrowEvalPython")[0] and "ubquery" not in plan and "Join" not in plan


def test_the_table_does_not_reach_the_driver(spark):
    """Only folders are kept by the index, and the query holds no rule."""
    rules = spark.range(1000).select(F.col("id").cast("int").alias("priority"), F.concat(F.lit("keyword"), "id").alias("keyword"), F.col("id").alias("value"))
    index = r.build_index(rules, 100)
    assert all(isinstance(f, str) for f in index.folders) and len(index.folders) >= 10
    df = spark.createDataFrame([("a keyword77 b",), ("no",)], "x string")
    made = r.with_first_match(df, index, "x", "v", -1)
    assert sorted(made.collect()) == [("a keyword77 b", 7), ("no", -1)]
    assert "keyword7" not in made._jdf.queryExecution().toString().replace("a keyword77 b", "")


def test_words_are_read_in_place():
    data = np.frombuffer(b"abcdefghij", np.uint8)
    assert [w.tobytes() for w in r._words(data)] == [b"abcdefgh", b"bcdefghi", b"cdefghij"]
