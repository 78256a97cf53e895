import json
import uuid

import pytest
from pyspark.sql import functions as F

from textrec.operators import findings as f
from textrec.operators.inference import Backend
from textrec.plans import reports as r
from textrec.plans import screening as s
from textrec.plans import themes as th
from textrec.queries.standins import BACKENDS, answers

FINDINGS = "batch bigint, pos int, question_num int, quote string, source string, page int, summary string, raw string"


@pytest.fixture
def found(spark):
    rows = [(b, p, [1, 2, None, 7][(b + p) % 4], f"quote {b}.{p}", f"doc{b}", b + 1, None, json.dumps({"quote": f"quote {b}.{p}", "page": b + 1, "mood": "calm"})) for b in range(6) for p in range(5)]
    return spark.createDataFrame(rows, FINDINGS)


@pytest.fixture
def titles(spark):
    return spark.createDataFrame([(1, "What?", "First"), (2, "Who?", "Second")], "question_num int, question string, title string")


@pytest.fixture
def totals(spark):
    counts = spark.createDataFrame([(19, 5, 30)], "total_documents bigint, relevant_documents bigint, total_findings bigint")
    return counts.withColumn("analysis_date", F.lit("2025-01-31T00:00:00"))


def expected_groups(found):
    groups = {}
    for row in sorted(found.collect(), key=lambda x: (x["batch"], x["pos"])):
        groups.setdefault(row["question_num"], []).append(row["quote"])
    return groups


def test_all_findings_of_a_question_in_order(found):
    got = {row["question_num"]: [x["quote"] for x in row["findings"]] for row in f.findings_by_question(found).collect()}
    assert got == expected_groups(found)


def test_titles(found, titles):
    got = f.with_titles(found, titles)
    assert got.count() == found.count()
    assert {(x["question_num"], x["title"]) for x in got.collect()} == {(1, "First"), (2, "Second"), (7, "Unknown"), (None, "Unknown")}


def test_questions_for_a_prompt(spark, titles):
    expected = '{\n  "1": "What?",\n  "2": "Who?"\n}'
    assert f.question_list(titles).first()["questions"] == expected
    assert f.question_list(titles.limit(0)).first()["questions"] == "{}"
    for questions in (titles, {2: "Who?", 1: "What?"}):
        assert spark.range(1).select(s.question_json(questions).alias("q")).first()["q"] == expected


def test_totals(spark, found):
    docs = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "doc string, matched boolean")
    assert tuple(f.report_totals(docs, found).first()) == (3, 2, 30)
    assert tuple(f.report_totals(docs.limit(0), found.limit(0)).first()) == (0, 0, 0)


def test_analysis(spark):
    paras = spark.createDataFrame(
        [("a.pdf", p, i, f"text {p} {i} " + "x" * i) for p in range(1, 4) for i in range(9)], "source string, page int, para int, text string"
    )
    got = s.analyse_batches(paras, {0: "Q", 1: "R"}, BACKENDS["find"]).orderBy("batch", "pos").collect()
    ordered = paras.orderBy("source", "page", "para").collect()
    assert [(x["quote"], x["source"], x["page"], x["batch"], x["pos"]) for x in got] == [
        (p["text"], "a.pdf", p["page"], i // 10, i % 10) for i, p in enumerate(ordered)
    ]
    assert [x["question_num"] for x in got] == [len(p["text"]) % 5 for p in ordered]


def test_analysis_prompt(spark):
    seen = Backend(answers(lambda p: json.dumps({"findings": [{"quote": p}]})))
    paras = spark.createDataFrame([("a.pdf", 1, 0, "one"), ("a.pdf", 2, 0, "two")], "source string, page int, para int, text string")
    prompt = s.analyse_batches(paras, {2: "B?", 1: "A?"}, seen).first()["quote"]
    assert '{\n  "1": "A?",\n  "2": "B?"\n}' in prompt
    assert "[Source: a.pdf, Page 1]\none\n\n[Source: a.pdf, Page 2]\ntwo\n" in prompt
    assert '{"findings": [{"question_num": 0,' in prompt


@pytest.mark.parametrize("reply", ["no json", "{broken", '{"findings": []}'])
def test_analysis_without_findings(spark, reply):
    paras = spark.createDataFrame([("a.pdf", 1, 0, "one")], "source string, page int, para int, text string")
    assert s.analyse_batches(paras, {1: "A?"}, Backend(answers(lambda p: reply))).count() == 0


def listed_clusters(themes):
    return {row["question_num"]: row["clusters"] for row in th.nested_clusters(themes).collect()}


def themes_of(found, backend, **options):
    return th.cluster_findings(th.indexed_findings(found), backend, **options)


def test_places_among_the_findings_of_a_question(found):
    got = {}
    for row in sorted(th.indexed_findings(found).collect(), key=lambda x: x["idx"]):
        got.setdefault(row["question_num"], []).append(row["quote"])
    assert got == expected_groups(found)


@pytest.mark.parametrize("per_prompt", [2, 3, 100])
def test_one_set_of_themes_with_indices_into_all_findings(found, per_prompt):
    groups = expected_groups(found)
    clusters = listed_clusters(themes_of(found, BACKENDS["cluster"], per_prompt=per_prompt))
    assert clusters.keys() == groups.keys()
    pages = {row["quote"]: row["page"] for row in found.collect()}
    for question, themes in clusters.items():
        for c in themes:
            assert c["key_quotes"][0] == groups[question][c["finding_indices"][0]]
            assert {f"theme {pages[groups[question][i]] % 3}" for i in c["finding_indices"]} == {c["theme"]}
            assert c["summary"] == f"{len(c['finding_indices'])} findings"
        assert sorted(i for c in themes for i in c["finding_indices"]) == list(range(len(groups[question])))


def test_a_question_with_most_of_the_findings(spark, tmp_path):
    """One question holds nine tenths; no prompt lists more than its share, and all findings get to their themes."""

    def cluster(talks, *rest):
        with open(f"{tmp_path}/{uuid.uuid4().hex}", "w") as out:
            out.writelines(f"{len(json.loads(t[-1]['content'].split(chr(10))[1]))} {len(t[-1]['content'])}\n" for t in talks)
        return BACKENDS["cluster"].call(talks, *rest)

    rows = [(i // 10, i % 10, i % 10 // 9, f"quote {i}", "s", i % 7, None, json.dumps({"quote": f"quote {i}", "page": i % 7})) for i in range(3000)]
    themes = themes_of(spark.createDataFrame(rows, FINDINGS).repartition(7), Backend(cluster), per_prompt=25)
    calls = [tuple(map(int, line.split())) for path in tmp_path.iterdir() for line in path.read_text().splitlines()]
    assert max(n for n, _ in calls) == 25 and max(size for _, size in calls) < 4000
    # Findings, then the themes of 108 and 12 parts, of 13 and 2 parts of them, of 2.
    assert len(calls) == (108 + 12) + (13 + 2) + (2 + 1) + 1
    groups = {q: [r for r in rows if r[2] == q] for q in (0, 1)}
    assert {(m["question_num"], m["idx"]): m["item"] for m in themes.members.collect()} == {(q, i): r[5] % 3 for q, g in groups.items() for i, r in enumerate(g)}
    assert {(t["question_num"], t["item"]): t["n_findings"] for t in themes.themes.collect()} == {(q, k): sum(r[5] % 3 == k for r in g) for q, g in groups.items() for k in range(3)}
    assert sorted(r["question_num"] for r in themes.questions.collect()) == [0, 1] and themes.errors.count() == 0


def test_themes_that_become_no_fewer_are_kept(found):
    """A model that gives every entry a theme of its own would never come to an end."""

    def apart(prompt):
        entries = json.loads(prompt.split("\n")[1])
        return json.dumps({"clusters": [{"theme": f"t{i}", "finding_indices": [i, i, 99, -1, "x"]} for i, _ in enumerate(entries)]})

    groups = expected_groups(found)
    clusters = listed_clusters(themes_of(found, Backend(answers(apart)), per_prompt=2))
    assert {q: [c["finding_indices"] for c in themes] for q, themes in clusters.items()} == {q: [[i] for i in range(len(g))] for q, g in groups.items()}


def test_a_finding_in_two_themes_and_in_none(spark):
    rows = [(0, i, 1, f"q{i}", "s", 1, None, json.dumps({"n": i})) for i in range(4)]
    reply = '{"clusters": [{"theme": "a", "finding_indices": [0, 1]}, {"theme": "b", "finding_indices": [1, 3]}, {"theme": "c"}]}'
    themes = themes_of(spark.createDataFrame(rows, FINDINGS), Backend(answers(lambda p: reply)))
    assert sorted((m["item"], m["idx"]) for m in themes.members.collect()) == [(0, 0), (0, 1), (1, 1), (1, 3)]
    assert [(c["theme"], c["finding_indices"]) for c in listed_clusters(themes)[1]] == [("a", [0, 1]), ("b", [1, 3]), ("c", [])]


def test_failed_clusters_are_left_out(found):
    for reply in ("no json", "{broken", ""):
        themes = themes_of(found, Backend(answers(lambda p: reply)))
        assert themes.questions.count() == themes.themes.count() == themes.members.count() == 0
    failing = themes_of(found, Backend(lambda talks, *_: 1 / 0))
    assert failing.questions.count() == 0 and failing.errors.count() == len(expected_groups(found))


def test_a_failed_part_leaves_the_others(spark):
    rows = [(0, i, 1, f"q{i}", "s", i, None, json.dumps({"quote": f"q{i}", "page": i})) for i in range(9)]

    def cluster(talks, *rest):
        if any('"q4"' in t[-1]["content"] and '"page"' in t[-1]["content"] for t in talks):
            raise ValueError("no")
        return BACKENDS["cluster"].call(talks, *rest)

    themes = themes_of(spark.createDataFrame(rows, FINDINGS), Backend(cluster), per_prompt=3)
    assert sorted(m["idx"] for m in themes.members.collect()) == [0, 1, 2, 6, 7, 8]
    assert [(e["question_num"], e["round"], e["part"]) for e in themes.errors.collect()] == [(1, 0, 1)]


def test_settings_and_errors_of_a_run(spark):
    filler = "z" * 60
    pages = spark.createDataFrame([(f"d{i}", 1, f"agent {i} {filler}", None) for i in range(30)], "doc string, page int, text string, error string")
    docs = pages.select("doc")

    def find(talks, system, max_tokens, temperature):
        if any("agent 7 " in t[-1]["content"] for t in talks):
            raise ValueError("no")
        return [(json.dumps({"findings": [{"question_num": 1, "quote": f"{system} {max_tokens} {temperature}"}]}), None)] * len(talks)

    options = {"n": 1, "system": "Be exact.", "max_tokens": 9, "partitions": 3, "batch_size": 4}
    run = s.screen_documents(docs, pages, ["agent"], ["agent"], {1: "Q"}, Backend(find), Backend(lambda talks, *_: 1 / 0), finder_options=options)
    assert {x["quote"] for x in run.findings.collect()} == {"Be exact. 9 0.0"} and run.findings.count() == 29
    errors = sorted(tuple(r) for r in run.errors.collect())
    assert [(a, c) for a, _, c in errors] == [("findings", "ValueError: no"), ("themes", "ZeroDivisionError: division by zero")]
    assert errors[1][1] == "1/0/0" and run.themes.questions.count() == 0


def text_of(lines):
    return "\n".join(x["line"] for x in lines.orderBy(*r.ORDER).collect())


def test_markdown(spark, totals, titles):
    themes = th.Themes(
        questions=spark.createDataFrame([(7,), (1,), (2,)], "question_num int"),
        themes=spark.createDataFrame([(7, 0, "T3", "S3", [], 1), (1, 0, "T1", "S1", ['say "x"', "y"], 2), (1, 1, "T2", "S2", ["z"], 1)], th.THEME),
        members=spark.createDataFrame([], th.MEMBER),
        errors=spark.createDataFrame([], "question_num int"),
    )
    got = text_of(r.markdown_report(totals, themes, titles, "Risks", "both terms", "Line one.\nLine two."))
    assert got == (
        "# Risks\nGenerated: 2025-01-31T00:00:00\nTotal Documents: 19\nDocuments Analyzed (both terms): 5\n"
        "Total Relevant Findings: 30\n\n## Executive Summary\n\nLine one.\nLine two.\n\n"
        '\n## Question 1: First\n\n### T1\n\nS1\n\n**Key Quotes:**\n- "say "x""\n- "y"\n\n'
        '### T2\n\nS2\n\n**Key Quotes:**\n- "z"\n\n'
        "\n## Question 2: Second\n\n"
        "\n## Question 7: Unknown\n\n### T3\n\nS3\n\n**Key Quotes:**\n"
    )


def test_json_report(found, totals):
    indexed = th.indexed_findings(found)
    for per_prompt in (3, 100):
        themes = th.cluster_findings(indexed, BACKENDS["cluster"], per_prompt=per_prompt)
        lines = r.json_report(totals, themes, indexed, "terms 'a' AND \"b\"")
        report = json.loads(text_of(lines))
        questions = report.pop("questions")
        assert report == {
            "analysis_date": "2025-01-31T00:00:00",
            "total_documents": 19,
            "relevant_documents": 5,
            "total_findings": 30,
            "filter_criteria": "terms 'a' AND \"b\"",
        }
        raw = {q: [x["quote"] for x in entry["raw_findings"]] for q, entry in questions.items()}
        assert raw == {str(q) if q is not None else "null": g for q, g in expected_groups(found).items()}
        assert questions["1"]["raw_findings"][0].keys() == {"quote", "page", "mood"}
        for key, rows in listed_clusters(themes).items():
            expected = [c.asDict() for c in rows]
            assert questions[str(key) if key is not None else "null"]["clusters"]["clusters"] == expected
        assert max(len(x["line"]) for x in lines.collect()) < 100


def test_json_report_without_findings(found, totals):
    indexed = th.indexed_findings(found.limit(0))
    themes = th.cluster_findings(indexed, BACKENDS["cluster"])
    assert json.loads(text_of(r.json_report(totals, themes, indexed, "x")))["questions"] == {}
    assert "## Question" not in text_of(r.markdown_report(totals, themes, found.selectExpr("1 as question_num", "'t' as title"), "H", "c", "s"))


def test_question_without_clusters_in_json(spark, found, totals):
    indexed = th.indexed_findings(found)
    for per_prompt in (3, 100):
        themes = th.cluster_findings(indexed, Backend(answers(lambda p: '{"clusters": []}')), per_prompt=per_prompt)
        report = json.loads(text_of(r.json_report(totals, themes, indexed, "x")))
        assert report["questions"]["2"]["clusters"] == {"clusters": []}
        assert len(report["questions"]["2"]["raw_findings"]) == len(expected_groups(found)[2])
