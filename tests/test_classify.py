"""Classifiers against entries judged by hand."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from textrec.functions import keywords
from textrec.operators.classify import classify_entries
from textrec.operators.rules import first_match_table
from textrec.plans.explorer import consequence_plot, function_plot
from textrec.queries import classify as q

COLUMNS = [
    "Organization",
    "Sector",
    "Agent_Type_Text",
    "Description",
    "Kind_of_Agent",
    "Economic_Value",
    "Proximity_NCF",
    "Full_Description_Tooltip",
]


def loop_first(low, rules, default):
    for words, value in rules:
        for word in words:
            if word.lower() in low:
                return value
    return default


# Entries made by hand: name, description, sector and agent type; kind, value and nearness they should get.
CASES = [
    (("A", "nothing of note", "fr", "src4"), ("Clerk", 25, 10)),
    (("A", "nothing of note", "de", "src4"), ("Clerk", 25, 11)),
    (("A", "a tionre and mente", "fr", "src4"), ("Scout", 25, 10)),
    (("A", "mente before tionre", "fr", "src4"), ("Scout", 25, 10)),
    (("A", "OSDE NDEN", "fr", "src4"), ("Archive", 10, 10)),
    (("A", "nden shth", "fr", "src4"), ("Clerk", 40, 10)),
    (("A", "zu", "fr", "src4"), ("Clerk", 25, 30)),
    (("A", "zu", "de", "SRC7"), ("Clerk", 25, 31)),
    (("* src1 *", "quela", "de", "SRC7"), ("Scout", 25, 33)),
    (("src1", "ntat zu", "de", "SRC1"), ("Clerk", 25, 50)),
    (("src1", "ntat zu", "de", "xsrc1"), ("Clerk", 25, 33)),
    (("A", "osde ertion", "fr", "src4"), ("Courier", 25, 10)),
    (("A", "osde ertion lere", "fr", "src4"), ("Courier", 25, 30)),
    (("A", "osde ertion lere ntat", "fr", "src1"), ("Courier", 25, 50)),
    (("A", "mente ertion lere", "fr", "src4"), ("Courier", 25, 10)),
    (("A", "lesles ertion lere", "fr", "src4"), ("Courier", 25, 90)),
    (("A", "thethe", "fr", "src4"), ("Clerk", 25, 90)),
    (("A", "", "es", ""), ("Clerk", 25, 10)),
]

# Descriptions and the lead that is shown of each.
LEADS = [
    (" One. Two. ", "One."),
    ("No end", "No end"),
    ("Costs 3.5 in all", "Costs 3."),
    ("x" * 151, "x" * 150 + "..."),
    ("? after", "? after"),
]


def made_entries(count):
    pick = random.Random(7)
    words = [w for rules in (q.KIND_RULES, q.VALUE_RULES) for ws, _ in rules for w in ws] + ["plain", "3.5", "X" * 160]
    for i in range(count):
        text = " ".join(pick.choice(words) if pick.random() < 0.5 else "zzz" for _ in range(pick.randint(0, 6)))
        text = pick.choice([text, text.upper(), text + ". End"])
        yield i, "Other", text, pick.choice(["EN", "fr", "it", "De", "es"]), pick.choice(["src0", "SRC1", "src4"])


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(list(made_entries(1500)), "id int, name string, description string, sector string, agent_type string")


@pytest.mark.parametrize("one_pass", [False, True])
def test_classified_by_hand(spark, one_pass):
    rows = [(i, *given) for i, (given, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, name string, description string, sector string, agent_type string")
    got = classify_entries(df, q.RULES, ["id"], one_pass=one_pass).orderBy("id").collect()
    assert [(r["Kind_of_Agent"], r["Economic_Value"], r["Proximity_NCF"]) for r in got] == [expected for _, expected in CASES]
    assert got[8]["Organization"] == "src1" and got[0].asDict().keys() == {"id", *COLUMNS}


def test_leads(spark):
    df = spark.createDataFrame([(i, "A", d, "fr", "x") for i, (d, _) in enumerate(LEADS)], "id int, name string, description string, sector string, agent_type string")
    got = classify_entries(df, q.RULES, ["id"]).orderBy("id").collect()
    assert [r["Description"].strip() for r in got] == [lead.strip() for _, lead in LEADS]


@pytest.mark.parametrize("one_pass", [False, True])
def test_no_shuffle(entries, one_pass):
    plan = classify_entries(entries, q.RULES, ["id"], one_pass=one_pass)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("lower(Full_Description_Tooltip") == 1
    assert plan.count("ArrowEvalPython") == one_pass


def test_searches():
    groups = [["ab", "bc"], ["bcd", "é"], [], ["", "zz"], ["ab"], ["d"]]
    search = keywords._searcher(groups)
    for text in ["", "abcd", "xbcx", "É é", "d"]:
        assert search(text) == [any(w in text for w in words) for words in groups]
    assert keywords._searcher([[], [""]])("x") == [False, True]


def test_one_pass_needs_its_library(monkeypatch):
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    with pytest.raises(ImportError):
        keywords._searcher([["a"]])


def test_rule_without_a_value_still_wins(spark):
    rules = spark.createDataFrame([(1, "one", None), (2, "two", "second")], "priority int, keyword string, value string")
    df = spark.createDataFrame([(1, "one two"), (2, "two"), (3, "else"), (4, None)], "id int, x string")
    for per_index in (1, 1000):
        got = {r["id"]: r["label"] for r in first_match_table(df, rules, "x", "label", "default", per_index).collect()}
        assert got == {1: None, 2: "second", 3: "default", 4: "default"}


def test_hits_of_null_texts(spark):
    df = spark.createDataFrame([(1, "an agent"), (2, None)], "id int, x string")
    got = df.select("id", keywords.keyword_hits("x", [["AGENT"], ["other"]]).alias("h")).orderBy("id").collect()
    assert [r["h"] for r in got] == [[True, False], [False, False]]


@pytest.mark.parametrize("per_index", [1, 2, 1000])
def test_rule_table_like_rules(spark, entries, per_index):
    table = [(i, w.upper(), v) for i, (ws, v) in enumerate(q.VALUE_RULES) for w in ws]
    rules = spark.createDataFrame(table, "priority int, keyword string, value int")
    got = first_match_table(entries, rules, "description", "score", 1, per_index)
    expected = {i: loop_first(d.lower(), q.VALUE_RULES, 1) for i, _, d, _, _ in made_entries(1500)}
    assert {r["id"]: r["score"] for r in got.collect()} == expected
    assert got.columns == [*entries.columns, "score"]


def test_empty_rule_table(spark, entries):
    rules = spark.createDataFrame([], "priority int, keyword string, value int")
    assert {r["score"] for r in first_match_table(entries, rules, "description", "score", 1).collect()} == {1}


def test_plots(spark, entries):
    table = classify_entries(entries, q.RULES, ["id"])
    one = function_plot(table, "fr", q.KINDS, ["src0", "src4"], q.COLOURS, "id").collect()
    assert {r["Sector"] for r in one} == {"fr"} and {r["y_label"] for r in one} == {"Kind of Agent"}
    assert all(r["y"] == r["Kind_of_Agent"] and r["colour"] == q.COLOURS[r["y"]] for r in one)
    assert {(r["x"], r["x_rank"]) for r in one} == {("src0", 1), ("SRC1", None), ("src4", 2)}
    for sector in ["All Sectors", "nowhere"]:
        every = function_plot(table, sector, q.KINDS, ["src0", "src4"], q.COLOURS, "id").collect()
        assert len(every) == 1500 and all(r["y"] == r["Sector"] and r["y_label"] == "Sector" for r in every)
    points = consequence_plot(table, q.COLOURS, "id")
    assert points.where(F.col("x") != F.col("size")).count() == 0 and points.count() == 1500
