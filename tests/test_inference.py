import uuid
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textrec.operators import inference as i
from textrec.operators.scoring import accuracy, exact_score, graded_score
from textrec.plans.evaluation import evaluate
from textrec.queries.standins import BACKENDS, answers

echo = i.Backend(answers(lambda p: p[::-1]))
quiet = i.Backend(lambda talks, *_: [("", {"total_tokens": 1})] * len(talks))
unmetered = i.Backend(lambda talks, *_: [("text", None)] * len(talks))
short = i.Backend(lambda talks, *_: [])


def fails_on_bad(talks, system, max_tokens, temperature):
    if any("bad" in t[-1]["content"] for t in talks):
        raise ValueError("bad prompt")
    return [("ok", {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3})] * len(talks)


def counting(talks, system, max_tokens, temperature):
    return [(str(len(talks)), {"total_tokens": 1})] * len(talks)


ALL = {"echo": echo, "quiet": quiet, "unmetered": unmetered, "short": short, "bad": i.Backend(fails_on_bad), "count": i.Backend(counting)}


@pytest.fixture
def prompts(spark):
    return spark.createDataFrame(
        [(1, "abc", "old"), (2, None, "kept"), (3, "bad", None), (4, "", None)], "row_id int, prompt string, response string"
    )


def by_id(df):
    return {r["row_id"]: tuple(r)[1:] for r in df.collect()}


def test_replies_and_tokens(prompts):
    out = i.complete_prompts(prompts, "echo", ALL)
    assert out.columns == ["row_id", "prompt", "response", "prompt_tokens", "completion_tokens", "total_tokens"]
    assert by_id(out) == {
        1: ("abc", "cba", 3, 3, 6),
        2: (None, "kept", None, None, None),
        3: ("bad", "dab", 3, 3, 6),
        4: ("", None, None, None, None),
    }


@pytest.mark.parametrize("name", ["quiet", "unmetered", "short", "no such backend"])
def test_nothing_to_write_back(prompts, name):
    out = by_id(i.complete_prompts(prompts, name, ALL))
    assert {k: v[1:] for k, v in out.items()} == {
        1: ("old", None, None, None),
        2: ("kept", None, None, None),
        3: (None, None, None, None),
        4: (None, None, None, None),
    }


@pytest.mark.parametrize("batch_size", [64, 1, 2])
def test_one_bad_prompt_fails_alone(prompts, batch_size):
    one = prompts.coalesce(1)
    out = by_id(i.complete_prompts(one, "bad", ALL, error_col="error", batch_size=batch_size))
    assert out[1][1:] == ("ok", 1, 2, 3, None)
    assert out[3][1:] == (None, None, None, None, "ValueError: bad prompt")
    assert out[4][1:] == ("ok", 1, 2, 3, None)


def test_calls_hold_at_most_batch_size(spark):
    df = spark.range(0, 25, 1, 1).select(F.col("id").alias("row_id"), F.lit("p").alias("prompt"))
    sizes = lambda n: sorted(r["response"] for r in i.complete_prompts(df, "count", ALL, batch_size=n, partitions=1).collect())
    assert sizes(10) == ["10"] * 20 + ["5"] * 5
    assert sizes(64) == ["25"] * 25
    assert i.complete_prompts(df, "count", ALL, partitions=4, batch_size=1).count() == 25


def test_a_failed_call_is_halved(spark, tmp_path):
    """One bad prompt among 64 costs a call for each halving and two for the last."""

    def call(talks, *_):
        with open(f"{tmp_path}/calls", "a") as out:
            out.write(f"{len(talks)}\n")
        if any("bad" in t[-1]["content"] for t in talks):
            raise ValueError("bad prompt")
        return [("ok", {"total_tokens": 1})] * len(talks)

    df = spark.range(0, 64, 1, 1).select(F.col("id").alias("row_id"), F.when(F.col("id") == 40, "bad").otherwise("p").alias("prompt"))
    out = i.complete_prompts(df, "own", {"own": i.Backend(call)}, error_col="error", partitions=1)
    assert [r["row_id"] for r in out.where("error is not null").collect()] == [40]
    assert len(open(f"{tmp_path}/calls").read().split()) == 13


def test_other_columns_pass_unchanged(spark):
    df = spark.sql(
        "select 1 as row_id, 'ab' as prompt, array(struct(1 as a, 'x' as b)) as list, map('k', 1.5D) as m, "
        "timestamp'2024-01-01 10:00:00' as ts, cast(1.10 as decimal(10, 2)) as d, X'00FF' as raw, date'2024-02-29' as day"
    )
    out = i.complete_prompts(df, "echo", ALL)
    assert out.select(*df.columns).collect() == df.collect()
    assert out.first()["response"] == "ba"


def test_empty_table(prompts):
    assert i.complete_prompts(prompts.limit(0), "echo", ALL).count() == 0


def test_replies_are_kept(prompts):
    replies = i.ask_model(prompts, "row_id", echo)
    assert by_id(i.write_back(i.ensure_columns(prompts, {}, i.TOKENS), replies, "row_id"))[1] == ("abc", "cba", 3, 3, 6)


@pytest.fixture
def recorded(tmp_path):
    """A backend that notes every prompt, and a function that gives the prompts noted so far."""

    def call(talks, system, max_tokens, temperature):
        with open(f"{tmp_path}/asked", "a") as out:
            out.writelines(f"{system}|{t[-1]['content']}\n" for t in talks)
        if any("bad" in t[-1]["content"] for t in talks):
            raise ValueError("bad prompt")
        return [(f"{system} {max_tokens} {t[-1]['content'].upper()}", {"total_tokens": 1}) for t in talks]

    def noted():
        path = tmp_path / "asked"
        lines = sorted(path.read_text().split("\n")[:-1]) if path.exists() else []
        path.unlink(missing_ok=True)
        return lines

    return i.Backend(call), noted


@pytest.fixture
def run_name():
    return f"run-{uuid.uuid4().hex}"


SAY = {"system": "s", "max_tokens": 5, "batch_size": 1}


def test_a_named_run_asks_only_what_is_missing(spark, recorded, run_name):
    backend, noted = recorded
    ask = lambda rows: {r["row_id"]: r["reply"] or r["error"] for r in i.ask_model(spark.createDataFrame(rows, "row_id int, prompt string"), "row_id", backend, run=run_name, **SAY).collect()}
    assert ask([(1, "one"), (2, "bad"), (3, None)]) == {1: "s 5 ONE", 2: "ValueError: bad prompt", 3: None}
    assert noted() == ["s|bad", "s|one"]
    # A failed prompt is asked again, good ones are not, under whatever key.
    assert ask([(7, "one"), (2, "bad"), (4, "two"), (5, "two")]) == {7: "s 5 ONE", 2: "ValueError: bad prompt", 4: "s 5 TWO", 5: "s 5 TWO"}
    assert noted() == ["s|bad", "s|two"]
    assert ask([]) == {} and noted() == []


def test_what_changed_is_asked_again(spark, recorded, run_name):
    backend, noted = recorded
    one = lambda prompt, used=backend, **options: i.ask_model(spark.createDataFrame([(0, prompt)], "row_id int, prompt string"), "row_id", used, run=run_name, **{**SAY, **options}).first()["reply"]
    assert one("old prompt") == "s 5 OLD PROMPT" and one("new prompt") == "s 5 NEW PROMPT"
    assert one("old prompt", system="t") == "t 5 OLD PROMPT" and one("old prompt", max_tokens=6) == "s 6 OLD PROMPT"
    assert one("old prompt", temperature=0.5) == one("old prompt", used=replace(backend, name="other")) == "s 5 OLD PROMPT"
    assert noted() == sorted(["s|old prompt"] * 4 + ["s|new prompt", "t|old prompt"])
    # Sizes of calls and numbers of callers do not make another question.
    assert one("old prompt", batch_size=9, partitions=2) == "s 5 OLD PROMPT" and one("new prompt") == "s 5 NEW PROMPT"
    assert noted() == []
    with pytest.raises(ValueError):
        i.ask_model(spark.range(1).selectExpr("id", "'x' as prompt"), "id", backend, run="a/b")


def test_a_column_is_completed_from_kept_replies(spark, prompts, recorded, run_name):
    backend, noted = recorded
    complete = lambda df: by_id(i.complete_prompts(df, "mine", {"mine": backend}, error_col="error", run=run_name, **SAY))
    first = complete(prompts)
    assert first == by_id(i.complete_prompts(prompts, "mine", {"mine": backend}, error_col="error", **SAY))
    assert noted().count("s|abc") == 2
    more = prompts.union(spark.createDataFrame([(9, "abc", None), (10, "xyz", None)], "row_id int, prompt string, response string"))
    again = complete(more)
    assert noted() == ["s|bad", "s|xyz"]
    assert {k: again[k] for k in first} == first and again[9][1] == first[1][1] and again[10][1] == "s 5 XYZ"


def test_many_rows_with_one_prompt(spark, recorded, run_name):
    """A third of all rows ask the same; it is asked once."""
    backend, noted = recorded
    df = spark.range(900).select("id", F.expr("if(id % 3 = 0, 'same', concat('p', id))").alias("prompt")).repartition(8)
    got = {r["id"]: r["reply"] for r in i.ask_model(df, "id", backend, run=run_name, **{**SAY, "batch_size": 64}).collect()}
    assert got == {k: "s 5 SAME" if k % 3 == 0 else f"s 5 P{k}" for k in range(900)}
    assert len(noted()) == 601


def test_messages(spark):
    turns = "array<struct<user:string,assistant:string>>"
    df = spark.createDataFrame([(1, [("u", None)]), (2, [("u", "a"), ("v", None)]), (3, [(None, "a")]), (4, [])], f"row_id int, turns {turns}")
    plain = lambda ms: [(m["role"], m["content"]) for m in ms]
    apart = {k: plain(v[0]) for k, v in by_id(df.select("row_id", i.build_messages("turns"))).items()}
    assert apart == {1: [("user", "u")], 2: [("user", "u"), ("assistant", "a"), ("user", "v")], 3: [("assistant", "a")], 4: []}
    inline = {k: plain(v[0]) for k, v in by_id(df.select("row_id", i.build_messages("turns", "s", True))).items()}
    assert inline == {k: [("system", "s"), *v] for k, v in apart.items()}


def test_usage(prompts):
    done = i.complete_prompts(prompts, "echo", ALL)
    assert tuple(i.usage_totals(done).first()) == (2, 6, 6, 12)


def test_scores(spark, rows):
    df = spark.createDataFrame(
        [(1, "Yes", "Yes"), (2, " yes", "Yes"), (3, None, "x"), (4, None, None)], "row_id int, response string, target string"
    )
    assert [r[3] for r in rows(exact_score(df))] == [True, False, False, False]
    assert [r[3] for r in rows(exact_score(df, normalise=True))] == [True, True, False, False]
    assert tuple(accuracy(exact_score(df)).first()) == (4, 1, 0.25)


def test_graded(spark):
    df = spark.createDataFrame(
        [(1, "the sky is blue", "blue"), (2, "the sky is grey", "blue")], "row_id int, response string, target string"
    )
    template = "Answer: {answer}\nFact: {fact}"
    graded = graded_score(df, BACKENDS["grade"], template, r"GRADE:\s*(.)", {"answer": "response", "fact": "target"})
    assert {r["row_id"]: r["grade"] for r in graded.collect()} == {1: "C", 2: "I"}
    missing = graded_score(df, echo, template, r"GRADE:\s*(.)", {"answer": "response", "fact": "target"})
    assert {r["grade"] for r in missing.collect()} == {None}


def test_one_sample_run(spark):
    samples = spark.createDataFrame([("Say hello", "olleh yaS"), ("Say bye", "bye")], "input string, target string")
    run = evaluate(samples, "echo", ALL, exact_score)
    assert {r["input"]: r["correct"] for r in run.collect()} == {"Say hello": True, "Say bye": False}


def test_prompts_of_one_call_at_a_time_are_objects():
    """Also with nulls between them and at both ends; calls are as full as they can be."""
    calls = []

    def call(talks, system, max_tokens, temperature):
        calls.append([talk[-1]["content"] for talk in talks])
        return [(content.upper(), {"total_tokens": len(content)}) for content in calls[-1]]

    prompts = [None, *[None if n % 3 == 0 else f"p{n}" for n in range(100)], None, None]
    batch = pa.RecordBatch.from_pydict({"row": list(range(len(prompts))), "prompt": prompts})
    empty = batch.slice(0, 0)
    nulls = pa.RecordBatch.from_pydict({"row": [7, 8], "prompt": pa.array([None, None], pa.string())})
    out = i._caller(i.Backend(call), "prompt", "s", 1, 0.0, 7)(iter([batch, empty, nulls]))
    first = next(out)
    assert len(calls) == 1 and first.num_rows < 20
    rows = pa.Table.from_batches([first, *out]).to_pylist()
    asked = [p for p in prompts if p is not None]
    assert calls == [asked[n : n + 7] for n in range(0, len(asked), 7)]
    assert [r["row"] for r in rows] == [*range(len(prompts)), 7, 8]
    assert [r["_reply"] for r in rows] == [p and p.upper() for p in prompts] + [None, None]
    assert [r["_total_tokens"] for r in rows] == [p and len(p) for p in prompts] + [None, None]
