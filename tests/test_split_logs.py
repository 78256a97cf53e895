"""Large JSON documents read by many tasks, against the whole document parsed at once."""

import json
import random

import numpy as np
import pytest

from textrec.sources import split_logs as s


@pytest.fixture
def small_splits(spark):
    """Spark reads files in splits of some hundred bytes."""

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "8")

    yield use
    for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


def made(rng, depth=0):
    kind = rng.random()
    if depth < 3 and kind < 0.35:
        return {rng.choice(["a", "results", "b}", 'c"', "d\\", "é"]): made(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    if depth < 3 and kind < 0.5:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, -2.5, None, True, "", 'x"y', "}{][", "\\", '\\"', "日本}語", '"results": [', "line\nbreak, " * 3, "}" * 9])


def listed(spark, folder, **options):
    found, bad = s.split_elements(spark, str(folder), **options)
    elements = {}
    for r in sorted(found.collect(), key=lambda r: r["number"]):
        elements.setdefault(r["file_path"].rsplit("/", 1)[-1], []).append((r["number"], json.loads(r["element"])))
    return elements, {r["file_path"].rsplit("/", 1)[-1]: r["error"] for r in bad.collect()}


@pytest.mark.parametrize("size", [150, 1_000, 1 << 20])
def test_as_the_whole_document(spark, tmp_path, small_splits, size):
    rng, expected = random.Random(size), {}
    for i in range(10):
        elements = [{"n": k, **{"v": made(rng)}} if rng.random() < 0.9 else made(rng) for k in range(rng.choice([0, 1, 2, 30]))]
        document = {"first": made(rng), "more": [made(rng)], "results": elements, "after": {"results": [made(rng)]}, "last": [{"results": [1]}]}
        if i % 5 == 4:
            del document["results"]
        text = json.dumps(document, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n", " \n\n"])
        (tmp_path / f"{i}.json").write_text(text)
        if i % 5 < 4 and elements:
            expected[f"{i}.json"] = [(k + 1, e) for k, e in enumerate(elements)]
    small_splits(size)
    elements, errors = listed(spark, tmp_path)
    assert elements == expected and errors == {}


def test_files_that_break_off(spark, tmp_path, small_splits):
    whole = json.dumps({"results": [{"a": "x" * 50, "b": {"c": [1, 2]}} for _ in range(20)]})
    cases = {"whole": whole, "text": whole[:200], "deep": whole[:-40], "one": whole[:-1], "line": whole[:-1] + "\n", "empty": "", "more": whole + "}", "note": "no json", "none": '{"results": null}', "list": "[1, 2]"}
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
    small_splits(100)
    elements, errors = listed(spark, tmp_path)
    assert elements == {"whole": [(i + 1, {"a": "x" * 50, "b": {"c": [1, 2]}}) for i in range(20)]}
    assert errors.keys() == {"text", "deep", "one", "line", "more"} and errors["one"] == errors["line"] == "the file ends 1 levels deep"
    assert errors["text"] == "the file ends within a text"


def test_one_log_is_read_by_many_tasks(spark, tmp_path, small_splits):
    results = [{"sample": {"input": f"in {i}", "target": "t}"}, "response": "r" * (i % 50), "score": str(i)} for i in range(3000)]
    (tmp_path / "log.json").write_text(json.dumps({"eval": {"id": 1}, "results": results, "stats": {}}))
    (tmp_path / "bad.json").write_text('{"results": [{"a": 1}')
    small_splits(20_000)
    found, bad = s.split_result_logs(spark, str(tmp_path))
    rows = found.orderBy("result_no").collect()
    assert [(r["result_no"], r["result"]["sample"]["input"], r["result"]["sample"]["target"], r["result"]["response"], r["result"]["score"]) for r in rows] == [
        (i + 1, x["sample"]["input"], "t}", x["response"], x["score"]) for i, x in enumerate(results)
    ]
    assert bad.count() == 1
    pieces = s._pieces(spark, str(tmp_path / "log.json"))
    assert pieces.select("split").distinct().count() >= 10 and pieces.rdd.getNumPartitions() >= 10


def test_an_element_over_many_splits(spark, tmp_path, small_splits):
    long = {"a": [{"b": "}" * 20}] * 100, "c": "d"}
    (tmp_path / "x").write_text(json.dumps({"results": [1, long, [2], long, "}"]}))
    small_splits(80)
    assert listed(spark, tmp_path)[0] == {"x": list(enumerate([1, long, [2], long, "}"], 1))}


def test_quotes_that_are_escaped():
    text = np.frombuffer(rb'"a\"b\\" "\\\"c" \\', np.uint8)
    assert s._quotes(text)[-1] == 4
