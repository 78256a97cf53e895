import pytest
from pyspark.sql import functions as F

from textrec.operators.batching import assign_batches, number_rows
from textrec.operators.filters import (
    docs_with_all,
    docs_with_any,
    excerpt,
    filter_or_all,
    non_blank,
    require,
    tag_matches,
)
from textrec.operators import texts as t
from textrec.plans.evidence import evidence_table

PAGES = "doc string, page int, text string, error string"


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(
        [
            ("both", 1, "An Agent here", None),
            ("both", 2, "", None),
            ("both", 3, "and STABILITY there", None),
            ("one", 1, "reagents only", None),
            ("blank", 1, " \n\t", None),
            ("failed", 1, "agent stability", None),
            ("failed", 2, None, "ValueError: bad page"),
            ("none", 1, None, "ValueError: not a document"),
        ],
        PAGES,
    )


def test_any_and_all(pages, rows):
    assert rows(docs_with_any(pages, ["AGENT"])) == [
        ("blank", False),
        ("both", True),
        ("failed", True),
        ("none", False),
        ("one", True),
    ]
    assert [d for d, m in rows(docs_with_all(pages, ["agent", "Stability"])) if m] == ["both", "failed"]


def test_term_across_pages(spark, rows):
    pages = spark.createDataFrame([("d", 1, "end", None), ("d", 2, "start", None), ("e", 1, "end start", None)], PAGES)
    assert rows(docs_with_all(pages, ["end\nstart"])) == [("d", True), ("e", False)]


def test_document_without_pages_is_listed(spark, pages, rows):
    docs = spark.createDataFrame([("both",), ("one",), ("unread",)], "doc string")
    tagged = tag_matches(docs, docs_with_all(pages, ["agent", "stability"]))
    assert rows(tagged) == [("both", True), ("one", False), ("unread", False)]


def test_full_text(pages, rows):
    assert dict(rows(t.full_text(pages))) == {
        "both": "An Agent here\n\nand STABILITY there\n",
        "one": "reagents only\n",
        "blank": " \n\t\n",
        "failed": "agent stability\n",
    }


@pytest.mark.parametrize("cap", [None, 1, 7, 8, 30, 1000])
def test_full_text_caps(spark, rows, cap):
    texts = ["abc", "", "defgh", "i", "jklmnopqrstu", "", "vw"]
    data = [(d, i + 1, x * n, None) for d, n in [("a", 1), ("b", 3)] for i, x in reversed(list(enumerate(texts)))]
    data += [("n", None, "no page", None), ("n", 300, "far", None)]
    whole = {d: "".join(x * n + "\n" for x in texts) for d, n in [("a", 1), ("b", 3)]} | {"n": "no page\nfar\n"}
    pages = spark.createDataFrame(data, PAGES)
    assert dict(rows(t.full_text(pages, cap))) == {d: x if cap is None else x[:cap] for d, x in whole.items()}


def test_evidence(pages, rows):
    assert rows(evidence_table(pages)) == [
        ("both", "both", "An Agent here\nand STABILITY there\n"),
        ("one", "one", "reagents only\n"),
    ]


def test_paragraphs(spark, rows):
    p49, p50, p51 = ("x" * n for n in (49, 50, 51))
    page = f"{p51}\n\n{p50}\n\n\n\t {p51}y \t\n\n{p49}\n\n"
    pages = spark.createDataFrame([("d", 1, page, None), ("d", 2, "", None), ("d", 3, None, "e")], PAGES)
    assert rows(t.paragraphs(pages)) == [("d", 1, 0, p51), ("d", 1, 2, p51 + "y")]
    odd = spark.createDataFrame([("d", 1, r"a\Eb" + r"\E" + "c", None)], PAGES)
    assert rows(t.paragraphs(odd, r"\E", 0)) == [("d", 1, 0, "a"), ("d", 1, 1, "b"), ("d", 1, 2, "c")]


def test_relevant_paragraphs(spark, rows):
    filler = "z" * 60
    pages = spark.createDataFrame(
        [
            ("a", 1, f"agent {filler}\n\nother {filler}", None),
            ("a", 2, "stability", None),
            ("b", 1, f"agent {filler}", None),
        ],
        PAGES,
    )
    flags = docs_with_all(pages, ["agent", "stability"])
    assert rows(t.relevant_paragraphs(pages, flags, ["AGENT"])) == [("a", 1, 0, f"agent {filler}")]


@pytest.mark.parametrize("count", [0, 1, 10, 11])
def test_context_blocks(spark, rows, count):
    paras = spark.createDataFrame(
        [(f"s{i:02}", 1, 0, f"text {i}") for i in range(count)], "source string, page int, para int, text string"
    )
    blocks = rows(t.context_blocks(assign_batches(paras, ["source", "page", "para"], 10)))
    texts = [f"[Source: s{i:02}, Page 1]\ntext {i}" for i in range(count)]
    expected = [(b // 10, len(texts[b : b + 10]), "\n\n".join(texts[b : b + 10])) for b in range(0, count, 10)]
    assert blocks == expected


def test_prompt(spark):
    df = spark.createDataFrame([(1, "a", None)], "n int, x string, y string")
    out = t.render_prompt(df, '{{"n": {n}}} {x} {y} {z}', n=F.col("n"), x=F.col("x"), y=F.col("y"), z="{c}")
    assert out.first()["prompt"] == '{"n": 1} a None {c}'


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_numbers_do_not_depend_on_partitions(spark, rows, partitions):
    data = [(i % 3 if i % 5 else None, f"k{i * 7919 % 1000:04}") for i in range(1000)]
    df = spark.createDataFrame(data, "g int, k string").repartition(partitions)
    ordered = sorted(k for _, k in data)
    got = {r["k"]: r["row_no"] for r in number_rows(df, ["k"]).collect()}
    assert got == {k: i + 1 for i, k in enumerate(ordered)}
    within = {(r["g"], r["k"]): r["row_no"] for r in number_rows(df, ["k"], by=["g"]).collect()}
    for group in [0, 1, 2, None]:
        keys = sorted(k for g, k in data if g == group)
        assert [within[group, k] for k in keys] == list(range(1, len(keys) + 1))


def test_batches(spark):
    df = spark.range(25).withColumnRenamed("id", "k")
    got = {r["k"]: r["batch"] for r in assign_batches(df, ["k"], 10).collect()}
    assert got == {k: k // 10 for k in range(25)}
    assert {r["batch"] for r in assign_batches(df, ["k"]).collect()} == {0}
    assert assign_batches(df.limit(0), ["k"], 10).count() == 0


def test_filters(spark, rows):
    df = spark.createDataFrame([("a", " "), ("b", "x"), ("c", None)], "k string, v string")
    assert rows(non_blank(df, "v")) == [("b", "x")]
    assert rows(require(df, "v")) == [("a", " "), ("b", "x")]
    assert rows(require(df, "absent")) == []
    assert rows(filter_or_all(df, "k", "a")) == [("a", " ")]
    assert len(rows(filter_or_all(df, "k", "zz"))) == 3
    assert len(rows(filter_or_all(df, "k", "All"))) == 3
    assert [r["k"] for r in excerpt(df, ["k"], 2, [F.desc("k")]).collect()] == ["c", "b"]
