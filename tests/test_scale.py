"""Results must not depend on how rows are spread, nor on how many share a key."""

import random

import pytest
from pyspark.sql import functions as F

from textrec.operators import tables as tab
from textrec.operators import texts as t
from textrec.operators.batching import assign_batches, number_rows
from textrec.operators.filters import docs_with_all, docs_with_any, filter_or_all
from textrec.operators.findings import findings_by_question
from textrec.operators.transcripts import first_turns, group_messages, join_message_blocks, join_messages, message_blocks

PAGES = "doc string, page int, text string, error string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot_pages():
    """One document holds a third of all pages."""
    rows = [("hot", i + 1, f"Page {i} {'agent' if i == 640 else ''}", None) for i in range(700)]
    return rows + [(f"d{i // 7:03}", i % 7 + 1, f"text {i} stability", None) for i in range(1400)]


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_hot_document(spark, partitions):
    data = hot_pages()
    random.Random(partitions).shuffle(data)
    pages = spark.createDataFrame(data, PAGES).repartition(partitions)
    whole = {}
    for doc, page, text, _ in sorted(data):
        whole[doc] = whole.get(doc, "") + text + "\n"
    assert {r["doc"]: r["text"] for r in t.full_text(pages).collect()} == whole
    assert {r["doc"]: r["text"] for r in t.full_text(pages, 3000).collect()} == {d: x[:3000] for d, x in whole.items()}
    assert {r["doc"] for r in docs_with_any(pages, ["agent"]).where("matched").collect()} == {"hot"}
    assert docs_with_all(pages, ["agent", "page"]).where("matched").count() == 1


@pytest.mark.parametrize("partitions, chars", [(1, 7), (4, 100), (64, 100_000)])
def test_a_hot_document_in_segments(spark, partitions, chars):
    """A third of all pages is one document; its text comes in rows of a segment, its pages from many tasks."""
    data = hot_pages() + [("odd", None, "no number", None), ("odd", 2, "", None), ("odd", 3, None, "e"), (None, 1, "no name", None)]
    random.Random(partitions).shuffle(data)
    pages = spark.createDataFrame(data, PAGES).repartition(partitions)
    whole = {}
    for doc, _, text, _ in sorted((d for d in data if d[2] is not None), key=lambda d: (d[0] or "", d[1] or 0)):
        whole[doc] = whole.get(doc, "") + text + "\n"
    got = {}
    for r in sorted(t.text_segments(pages, chars).collect(), key=lambda r: r["segment"]):
        assert r["start"] == len(got.get(r["doc"], "")) == r["segment"] * chars and 0 < len(r["text"]) <= chars
        got[r["doc"]] = got.get(r["doc"], "") + r["text"]
    assert got == whole


def test_pages_of_a_hot_document_are_spread(spark):
    """With small tables not put into one task, no task has more than its share of the hot document."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        offsets = t.page_offsets(spark.createDataFrame(hot_pages(), PAGES).repartition(4))
        assert offsets.count() == 2100
        slots = spark.read.parquet(offsets.inputFiles()[0].rsplit("/", 1)[0])
        counts = [r["count"] for r in slots.where("doc = 'hot'").groupBy(F.shiftright("_at", 33)).count().collect()]
        assert len(counts) > 2 and max(counts) < 400
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("partitions, n", [(1, 1), (4, 100), (64, 10_000)])
def test_a_hot_sample_in_blocks(spark, partitions, n):
    data = [("hot", i, "user", f"m{i}") for i in range(1500)] + [(f"s{i // 3}", i % 3, "user", f"n{i}") for i in range(3000)]
    data += [("tie", 0, "b", "2"), ("tie", 0, "a", "1"), ("tie", None, "c", None)]
    random.Random(n).shuffle(data)
    msgs = spark.createDataFrame(data, "sample_id string, turn bigint, role string, content string").repartition(partitions)
    samples = spark.createDataFrame([("hot", "in"), ("s7", "in"), ("absent", "in"), ("tie", "in")], "sample_id string, input string")
    got = {}
    for r in sorted(join_message_blocks(samples, message_blocks(msgs, n)).collect(), key=lambda r: r["block"]):
        assert len(r["messages"]) == r["n_messages"] <= n and (r["block"] == 0 or r["n_messages"])
        got.setdefault(r["sample_id"], []).extend(m["content"] for m in r["messages"])
    assert got == {"hot": [f"m{i}" for i in range(1500)], "s7": ["n21", "n22", "n23"], "absent": [], "tie": [None, "1", "2"]}


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_hot_sample(spark, partitions):
    roles = ["user", "assistant", "system"]
    data = [("hot", i, roles[i % 3], f"m{i}") for i in range(2500)]
    data += [(f"s{i // 5:04}", i % 5, roles[(i + 1) % 3], f"n{i}") for i in range(5000)]
    random.Random(partitions).shuffle(data)
    msgs = spark.createDataFrame(data, "sample_id string, turn bigint, role string, content string").repartition(partitions)
    samples = spark.createDataFrame([("hot", "in"), ("s0001", "in"), ("absent", "in")], "sample_id string, input string")
    joined = join_messages(samples, group_messages(msgs)).collect()
    assert len(joined) == 3
    hot = [m["content"] for r in joined if r["sample_id"] == "hot" for m in r["messages"]]
    assert hot == [f"m{i}" for i in range(2500)]
    firsts = {r["sample_id"]: (r["first_user"], r["reply"]) for r in first_turns(msgs).collect()}
    assert firsts["hot"] == ("m0", "m1") and len(firsts) == 1001


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_hot_question(spark, partitions):
    data = [(i // 10, i % 10, 1 if i % 3 else i % 50, f"q{i}", "s", 1, "m", "{}") for i in range(3000)]
    schema = "batch bigint, pos int, question_num int, quote string, source string, page int, summary string, raw string"
    found = spark.createDataFrame(data, schema).repartition(partitions)
    got = {row["question_num"]: [x["quote"] for x in row["findings"]] for row in findings_by_question(found).collect()}
    expected = {}
    for row in data:
        expected.setdefault(row[2], []).append(row[3])
    assert got == expected


@pytest.mark.parametrize("groups", [2, 15_000])
def test_numbers_in_a_hot_group_and_in_many_groups(spark, groups):
    df = spark.range(30_000).select(F.expr(f"if(id % 3 = 0, 0, id % {groups})").alias("k"), "id").repartition(7)
    got = {r["id"]: (r["k"], r["row_no"]) for r in number_rows(df, ["id"], by=["k"]).collect()}
    seen = {}
    for i in range(30_000):
        k = 0 if i % 3 == 0 else i % groups
        seen[k] = seen.get(k, 0) + 1
        assert got[i] == (k, seen[k])


def test_calls_are_spread_by_rows(spark):
    """Few small prompts go to as many callers as there are cores."""
    from textrec.operators.inference import Backend, ask_model

    df = spark.range(200).select("id", F.lit("p").alias("prompt")).groupBy("id").agg(F.first("prompt").alias("prompt"))
    replies = ask_model(df, "id", Backend(lambda talks, *_: [("r", None)] * len(talks)))
    assert replies.select(F.input_file_name()).distinct().count() == spark.sparkContext.defaultParallelism


def test_one_shuffle_for_grouping_by_document(spark):
    pages = spark.createDataFrame([("a", 1, "x", None)], PAGES)
    for cap in (None, 100):
        assert plan_of(t.full_text(pages, cap)).count("Exchange hashpartitioning") == 1


def test_paragraphs_do_not_shuffle(spark):
    pages = spark.createDataFrame([("a", 1, "x", None)], PAGES)
    assert "Exchange" not in plan_of(t.paragraphs(pages))


def test_numbering_gathers_only_counts_in_one_partition(spark):
    numbered = number_rows(spark.range(1000).withColumn("payload", F.lit("text")), ["id"])
    plan = plan_of(numbered)
    single = plan.index("Exchange SinglePartition")
    assert plan.count("Exchange SinglePartition") == 1
    assert "payload" not in plan[single:]


def test_batches_of_a_table_in_many_partitions(spark):
    df = spark.range(0, 1003, 1, 64).select((1002 - F.col("id")).alias("k"))
    got = {r["k"]: r["batch"] for r in assign_batches(df, ["k"], 10).collect()}
    assert got == {k: k // 10 for k in range(1003)}


def test_fallbacks_need_no_join(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("k"))
    for plan in [plan_of(filter_or_all(df, "k", "3")), plan_of(tab.with_fallback(df, df))]:
        assert "Join" not in plan and "CartesianProduct" not in plan


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("string").alias("k"), F.lit("text").alias("v")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert "EqualTo(k,3)" in plan_of(filter_or_all(df, "k", "3"))
    assert filter_or_all(df, "k", "none") is df
