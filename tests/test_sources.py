import json

import pytest
from pyspark.sql import functions as F

from textrec.operators import tables as t
from textrec.operators.records import as_table, columns_of, field_types, merged_type, read_records, record_fields
from textrec.operators.texts import explode_results
from textrec.plans.evidence import summarise_folder
from textrec.queries.standins import BACKENDS
from textrec.sources import files, logs, sinks
from textrec.sources.page_files import PageReader, read_pages


@pytest.fixture
def folder(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return path

    write.root = str(tmp_path)
    return write


def test_list_files(spark, folder):
    for name in ["b.pdf", "a.PDF", "a.pdf", "x.txt", "sub/c.pdf", "a.pdf.bak", "k=1/d.pdf"]:
        folder(name, "12345")
    got = files.list_files(spark, folder.root, "*.pdf").orderBy("path").collect()
    assert [(r["name"], r["length"]) for r in got] == [("a.pdf", 5), ("b.pdf", 5)]
    assert files.list_files(spark, folder.root, "*.eval").count() == 0
    assert files.list_files(spark, folder.root + "/missing", "*.pdf").count() == 0


def test_list_files_by_several_patterns(spark, folder):
    for name in ["2025-05/x.eval", "2025-05/deep/y.eval", "2024/z.eval", "2025-06.eval", "other.eval", "2025-05/x.txt"]:
        folder(name, "{}")
    listed = files.list_files(spark, folder.root, "2025*/*.eval", "2025*.eval", "*.eval")
    got = [(r["glob_no"], r["name"]) for r in listed.orderBy("glob_no", "path").collect()]
    assert got == [(0, "x.eval"), (1, "2025-06.eval"), (2, "2025-06.eval"), (2, "other.eval")]
    first = t.first_or_default(listed.where("glob_no < 2").withColumn("at", F.struct("glob_no", "path")), "name", "at", "none")
    assert first.first()["name"] == "x.eval"
    assert t.first_or_default(listed.limit(0), "name", "path", "none").first()["name"] == "none"


def test_contents_are_not_listed(spark, folder):
    folder("a.pdf", b"x" * 1000)
    plan = files.list_files(spark, folder.root, "*.pdf")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_decoding(spark, folder):
    folder("1.json", '{"a": "é"}')
    folder("2.json", '{"a": "é"}'.encode("latin-1"))
    folder("3.json", "plain é")
    folder("4.json", bytes(range(256)))
    folder("5.json", b"\xff\x00")
    decoded = files.decode_text(files.binary_files(spark, folder.root, "*.json"))
    got = {r["path"][-6:]: (r["encoding"], r["text"]) for r in decoded.collect()}
    assert got["1.json"] == ("utf-8", '{"a": "é"}')
    assert got["2.json"] == ("latin-1", '{"a": "é"}')
    assert got["3.json"] == (None, "plain é")
    profile = {r["path"][-6:]: tuple(r)[1:] for r in files.binary_profile(decoded).collect()}
    assert profile == {
        "3.json": (8, 8, "plain é".encode().hex()),
        "4.json": (256, 100, bytes(range(100)).hex()),
        "5.json": (2, 2, "ff00"),
    }


def results(n, **more):
    return [{"sample": {"input": f"in {i}", "target": "t"}, "response": f"r {i}", "score": str(i), **more} for i in range(n)]


@pytest.fixture
def log_files(folder):
    folder("a.json", "{broken")
    folder("b.json", json.dumps({"results": [], "other": 1}))
    folder("c.json", json.dumps({"results": results(5), "x": {"y": 1}}, indent=2))
    folder("d.json", json.dumps({"other": 1}))
    folder("e.json", json.dumps({"results": [{"response": None}, {"sample": {"question": "q"}}]}))
    return folder.root


def test_result_logs(spark, log_files):
    scanned = logs.scan_result_logs(spark, log_files)
    got = {r["file_path"][-6:]: (r["results"] and len(r["results"]), r["error"]) for r in scanned.collect()}
    assert got == {"a.json": (None, "{broken"), "b.json": ([], None), "c.json": (5, None), "d.json": (None, None), "e.json": (2, None)}
    parsed = logs.parse_result_logs(files.decode_text(files.binary_files(spark, log_files, "*.json")))
    assert {r["file_path"][-6:]: r["results"] and len(r["results"]) for r in parsed.collect()} == {k: v for k, (v, _) in got.items()}
    flat = explode_results(scanned).select("file_path", "result_no", "result.response").orderBy("file_path", "result_no").collect()
    assert [(r[0][-6:], r[1], r[2]) for r in flat] == [("c.json", i + 1, f"r {i}") for i in range(3)] + [("e.json", 1, None), ("e.json", 2, None)]
    assert explode_results(scanned, None).count() == 7


def test_results_of_first_log(spark, log_files):
    got = [tuple(r)[1:] for r in logs.direct_results(logs.scan_result_logs(spark, log_files)).orderBy("result_no").collect()]
    assert got == [(i + 1, f"in {i}", "t", f"r {i}", str(i)) for i in range(3)]
    last = logs.direct_results(logs.scan_result_logs(spark, f"{log_files}/e.json")).orderBy("result_no").collect()
    assert tuple(last[0])[2:] == ("N/A",) * 4


def test_fallback_report(spark, log_files):
    """Raw logs are used only when the report shows nothing."""
    raw = logs.direct_results(logs.scan_result_logs(spark, log_files)).select("question", "response")
    shown = spark.createDataFrame([("q", "r")], "question string, response string")
    assert t.with_fallback(shown, raw).collect() == shown.collect()
    assert t.with_fallback(shown.limit(0), raw).count() == 3
    assert t.with_fallback(shown.limit(0), raw.limit(0)).count() == 0


def test_load_tables(spark, folder):
    folder("evals/1.json", json.dumps({"eval_id": "e", "task": "t"}))
    folder("samples/1.json", json.dumps({"sample_id": "s", "input": "i", "score": "C"}) + "\n")
    folder("messages/1.json", "\n".join(json.dumps({"sample_id": "s", "turn": i, "role": "user", "content": "c"}) for i in range(3)))
    tables = logs.load_tables(spark, folder.root)
    assert {r["table"]: r["rows"] for r in t.table_counts(tables).collect()} == {"evals": 1, "samples": 1, "messages": 3}
    assert tables["samples"].first().asDict() == {"sample_id": "s", "input": "i", "target": None, "score": "C"}


def test_sample_records(spark, folder):
    folder("s1/a.json", '{"input": "i", "target": "t", "extra": "x"}\n{"input": "j", "target": null}')
    folder("s2/a.json", '{"input": "k", "number": 3}')
    one, two = logs.load_samples(spark, f"{folder.root}/s1"), logs.load_samples(spark, f"{folder.root}/s2")
    merged = {r["input"]: r.asDict() for r in t.records_table([one, two], fill="missing").collect()}
    assert merged["j"] == {"input": "j", "target": None, "extra": None, "number": None}
    assert merged["k"] == {"input": "k", "target": "missing", "extra": "missing", "number": 3}
    assert logs.load_samples(spark, f"{folder.root}/s1", "input string").columns == ["input"]


def test_records_of_any_shapes(spark, folder, rows):
    lines = ['{"id": 1, "size": 5, "x": null}', '{"id": 2, "size": "6"}', "{broken", '{"id": 3, "size": {"n": 1}, "tags": ["a", 1]}', "[1, 2]", "5", "", '{"id": 1.5, "a b": true, "a.b": "dot", "it\'s": "q", "ID": 9, "a\'b\\"c": 7, "b\\\\": 3}', '{"z": 1, "z": 2}']
    folder("r/a.json", "\n".join(lines))
    records = read_records(spark, f"{folder.root}/r")
    assert sorted(r["error"] for r in records.where("error is not null").collect()) == sorted(['{"z": 1, "z": 2}', "{broken"])
    found = rows(record_fields(records))
    assert ("size", "STRING", 1) in found and ("size", "OBJECT<n: BIGINT>", 1) in found and ("x", "VOID", 1) in found and ("id", "BIGINT", 3) in found
    types = {r["field"]: (r["type"], r["rows"], r["kinds"]) for r in field_types(records).collect()}
    assert types["size"] == ("VARIANT", 3, 3) and types["id"][0].startswith("DECIMAL(") and types["id"][1:] == (4, 2) and types["a.b"] == ("STRING", 1, 1)
    table = as_table(records)
    assert table.columns == ["ID", "a b", "a'b\"c", "a.b", "b\\", "it's", "size", "tags", "x"] and table.count() == 8
    got = table.where("`a b`").select("`a.b`", "`it's`", "`a'b\"c`", "`b\\`").collect()
    assert [tuple(r) for r in got] == [("dot", "q", 7, 3)]
    assert sorted(r[0] for r in table.select(F.try_variant_get("size", "$", "int")).collect() if r[0]) == [5, 6]
    assert columns_of(records, {"id": "int", "none": "string"}).where("id = 2").collect() == [(2, None)]
    assert merged_type(records.where("to_json(record) like '{%'")).first()["rows"] == 4
    assert as_table(records.limit(0)).columns == [] and record_fields(records.limit(0)).count() == 0


def test_records_of_whole_files(spark, folder):
    folder("w/a.json", json.dumps({"results": [1, 2], "n": 1}, indent=2))
    folder("w/b.json", "no")
    got = read_records(spark, f"{folder.root}/w", lines=False)
    assert sorted((r["n"] is not None, r["error"]) for r in got.select(F.try_variant_get("record", "$.n", "int").alias("n"), "error").collect()) == [(False, "no"), (True, None)]


def form_feed_pages(content):
    if content.startswith(b"!"):
        raise ValueError("not a document")
    for page in content.decode().split("\f"):
        if page == "BAD":
            raise ValueError("bad page")
        yield page


def test_pages(spark, folder):
    folder("a.pdf", "one\ftwo")
    folder("b.pdf", "one\fBAD\fthree")
    folder("c.pdf", "!")
    folder("long.pdf", "\f".join(str(i) for i in range(200)))
    pages = files.extract_pages(files.binary_files(spark, folder.root, "*.pdf"), form_feed_pages)
    got = [tuple(r) for r in pages.orderBy("doc", "page").collect()]
    assert got[:5] == [
        ("a.pdf", 1, "one", None),
        ("a.pdf", 2, "two", None),
        ("b.pdf", 1, "one", None),
        ("b.pdf", 2, None, "ValueError: bad page"),
        ("c.pdf", 1, None, "ValueError: not a document"),
    ]
    assert got[5:] == [("long.pdf", i + 1, str(i), None) for i in range(200)]


def form_feed_file(file):
    """Reads a piece at a time, so that pages come before the file's end is reached."""
    left = b""
    while piece := file.read(4):
        *whole, left = (left + piece).split(b"\f")
        for page in whole:
            if page == b"BAD":
                raise ValueError("bad page")
            yield page.decode()
    yield left.decode()


def test_page_files(spark, folder):
    folder("a.pdf", "one\ftwo")
    folder("b.pdf", "one\fsecond\fBAD\fthree")
    folder("k=1/c.pdf", "deep")
    folder("k=1/d.txt", "other")
    folder("e.pdf", b"ok\f\xff\xfe")
    folder("f.pdf", "")
    folder("long.pdf", "\f".join(str(i) for i in range(500)))
    pages = read_pages(spark, folder.root, "*.pdf", form_feed_file, bytes_per_task=20)
    got = [tuple(r) for r in pages.orderBy("doc", "page").collect()]
    assert got[:7] == [
        ("a.pdf", 1, "one", None),
        ("a.pdf", 2, "two", None),
        ("b.pdf", 1, "one", None),
        ("b.pdf", 2, "second", None),
        ("b.pdf", 3, None, "ValueError: bad page"),
        ("e.pdf", 1, "ok", None),
        ("e.pdf", 2, None, "UnicodeDecodeError: 'utf-8' codec can't decode byte 0xff in position 0: invalid start byte"),
    ]
    assert got[7:] == [("f.pdf", 1, "", None)] + [("long.pdf", i + 1, str(i), None) for i in range(500)]
    assert [tuple(r)[:3] for r in read_pages(spark, "file://" + folder.root, "k=*/*.pdf", form_feed_file).collect()] == [("k=1/c.pdf", 1, "deep")]
    assert read_pages(spark, folder.root, "*.none", form_feed_file).count() == read_pages(spark, folder.root + "/missing", "*", form_feed_file).count() == 0


def test_a_folder_summarised_into_csv(spark, folder, tmp_path):
    for name, text in [("a_report.pdf", "first\fsecond, \"x\""), ("b.pdf", " \f"), ("c.pdf", "one\fBAD\fx"), ("d.pdf", "late"), ("n.txt", "no")]:
        folder(f"in/{name}", text)
    run = lambda path, **more: summarise_folder(spark, f"{folder.root}/in", "*.pdf", form_feed_file, f"{folder.root}/{path}", "instructed", BACKENDS, "Be brief.", **more)
    got = {r["pdf_filename"]: (r["pdf_title"], r["full_text"], r["summary"] is not None) for r in run("one").collect()}
    assert got == {"a_report.pdf": ("a report", 'first\nsecond, "x"\n', True), "d.pdf": ("d", "late\n", True)}
    back = spark.read.csv(f"{folder.root}/one", header=True, multiLine=True, escape='"')
    assert {r["pdf_filename"]: r["full_text"] for r in back.collect()} == {k: v[1] for k, v in got.items()}
    assert [r["pdf_filename"] for r in run("two", first=3).collect()] == ["a_report.pdf"]
    assert summarise_folder(spark, f"{folder.root}/none", "*", form_feed_file, f"{folder.root}/three", "instructed", BACKENDS, "x").count() == 0


def test_ranges_of_page_files(folder):
    for name, size in [("a", 5), ("b", 5), ("c", 50), ("d", 1), ("e", 9), ("f", 1)]:
        folder(name, "x" * size)
    reader = PageReader(folder.root, "*", 10, form_feed_file)
    assert [p.names for p in reader.partitions()] == [["a", "b"], ["c"], ["d", "e"], ["f"]]
    # A file of 500 pages comes in several batches, and the first before the last page is read.
    folder("g/pages", "\f".join(str(i) for i in range(500)))
    batches = list(PageReader(folder.root + "/g", "*", 10, form_feed_file).read(PageReader(folder.root + "/g", "*", 10, form_feed_file).partitions()[0]))
    assert [b.num_rows for b in batches] == [64] * 7 + [52]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc'), (2, "é,\r\n"), (3, "back\\slash"), (4, None)], "id int, text string")
    sinks.write_csv(df, f"{tmp_path}/out")
    import pandas as pd

    parts = [p for p in (tmp_path / "out").glob("*.csv")]
    back = pd.concat(pd.read_csv(p, encoding="utf-8") for p in parts).sort_values("id")
    assert back["text"].tolist()[:3] == ['a "q", b\nc', "é,\r\n", "back\\slash"] and pd.isna(back["text"].tolist()[3])


def test_split_and_lines(spark, tmp_path):
    tagged = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "doc string, matched boolean")
    sinks.write_split(tagged, f"{tmp_path}/split")
    assert {r["doc"] for r in spark.read.parquet(f"{tmp_path}/split/matched=true").collect()} == {"a", "c"}
    lines = spark.range(100).select(F.col("id").alias("n"), F.concat(F.lit("line "), "id").alias("line")).repartition(5)
    sinks.write_lines(lines, ["n"], f"{tmp_path}/lines")
    text = "".join(p.read_text() for p in sorted((tmp_path / "lines").glob("part-*.txt")))
    assert text == "".join(f"line {i}\n" for i in range(100))


def test_reports_on_tables(spark, rows):
    df = spark.createDataFrame([(1, "a", '{"x": 1, "y": {"z": 2}}'), (2, None, "[]")], "id int, name string, j string")
    assert rows(t.schema_report(df)) == [(1, "id", "int", 2, 2), (2, "name", "string", 2, 1), (3, "j", "string", 2, 2)]
    assert [r[0] for r in df.orderBy("id").select(t.json_keys("j")).collect()] == [["x", "y"], None]
    assert [r[0] for r in t.distinct_sorted(df.union(df), "id").collect()] == [1, 2]
    assert t.concat_tables(df, df, df).count() == 6
    assert [r["id"] for r in t.first_n(df, F.col("name").isNull(), 3, ["id"]).collect()] == [2]


def test_clearing_intermediate_tables(spark):
    from textrec.session import clear_stored, shared_folder, stored

    kept = stored(spark.range(3), "numbers")
    assert kept.count() == 3
    clear_stored(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/textrec")
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
