import pytest

from textrec.operators import transcripts as t
from textrec.plans.transcripts import transcript_report

MESSAGES = "sample_id string, turn bigint, role string, content string"
SAMPLES = "sample_id string, input string, target string, score string"


@pytest.fixture
def msgs(spark):
    return spark.createDataFrame(
        [
            ("a", 3, "assistant", "late"),
            ("a", 2, "assistant", "real"),
            ("a", 1, "user", "second"),
            ("a", 0, "user", None),
            ("b", 0, "system", "be brief"),
            ("c", 0, "system", "other"),
            ("c", 1, "user", "ask c"),
            ("c", 2, "assistant", None),
            ("c", 3, "assistant", ""),
            ("c", 4, "assistant", "answer c"),
            ("z", 0, "user", "no such sample"),
        ],
        MESSAGES,
    )


@pytest.fixture
def samples(spark):
    return spark.createDataFrame(
        [
            ("a", "in a", "ta", "1"),
            ("b", "in b", None, None),
            ("c", None, "tc", "0"),
            ("d", "in d", "td", "1"),
            ("e", "in e", "te", "1"),
        ],
        SAMPLES,
    )


def test_questions(samples, msgs, rows):
    assert rows(t.question(samples, msgs)) == [
        ("a", None),
        ("b", "in b"),
        ("c", "ask c"),
        ("d", "in d"),
        ("e", "in e"),
    ]
    assert dict(rows(t.question(samples.drop("input"), msgs)))["d"] == "No question found"


def test_replies(samples, msgs, rows):
    none = "No response found"
    assert dict(rows(t.first_reply(samples, msgs))) == {"a": "real", "b": none, "c": "answer c", "d": none, "e": none}


def test_system_prompt(msgs, rows):
    assert rows(t.system_prompt(msgs)) == [("be brief",)]
    assert rows(t.system_prompt(msgs.where("role <> 'system'"))) == []


def test_grouped(msgs):
    got = {r["sample_id"]: [m["turn"] for m in r["messages"]] for r in t.group_messages(msgs).collect()}
    assert got == {"a": [0, 1, 2, 3], "b": [0], "c": [0, 1, 2, 3, 4], "z": [0]}


def test_one_list_for_each_sample(samples, msgs):
    joined = {r["sample_id"]: [m["turn"] for m in r["messages"]] for r in t.join_messages(samples, t.group_messages(msgs)).collect()}
    assert joined == {"a": [0, 1, 2, 3], "b": [0], "c": [0, 1, 2, 3, 4], "d": [], "e": []}


def test_report(samples, msgs):
    got = [tuple(r) for r in transcript_report(samples, msgs).orderBy("sample_no").collect()]
    assert got == [
        ("a", None, "ta", "real", "1", 1),
        ("b", "in b", None, "No response found", None, 2),
        ("d", "in d", "td", "No response found", "1", 3),
    ]
    assert [tuple(r) for r in transcript_report(samples, msgs, 1000).orderBy("sample_no").collect()][:3] == got
    bare = transcript_report(samples.select("sample_id", "input"), msgs, 1).first()
    assert (bare["target"], bare["score"]) == ("No target found", "No score found")
    assert transcript_report(samples.drop("input"), msgs).count() == 0
    assert transcript_report(samples.limit(0), msgs).count() == 0
