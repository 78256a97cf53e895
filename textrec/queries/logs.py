"""Raw bytes, decoded logs and page extraction over bytes made from the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textrec.operators.tables import first_nonempty
from textrec.operators.texts import explode_results
from textrec.plans.evidence import summarise_folder
from textrec.queries.inputs import LINES_PER_PAGE, PAGES_SQL, doc_name, read
from textrec.queries.registry import query
from textrec.queries.standins import BACKENDS
from textrec.sources.files import binary_profile, decode_text, extract_pages
from textrec.session import shared_folder
from textrec.sources.page_files import read_pages
from textrec.sources.logs import direct_results, parse_result_logs, scan_result_logs
from textrec.sources.split_logs import split_result_logs


def encoded(spark, folder, text):
    """French texts as Latin-1 bytes, others as UTF-8."""
    french = F.encode(text, "ISO-8859-1")
    content = F.when(F.col("lang") == "fr", french).otherwise(F.encode(text, "UTF-8"))
    return read(spark, folder, "documents").select("doc_id", doc_name().alias("path"), content.alias("content"))


def result_log():
    """A log with one result per line of the document."""
    result = lambda line: F.struct(
        F.struct(line.alias("input"), F.col("lang").alias("target")).alias("sample"),
        F.reverse(line).alias("response"),
        F.length(line).cast("string").alias("score"),
    )
    return F.to_json(F.struct(F.transform(F.split("text", "\n"), result).alias("results")))


def line_logs(spark, folder):
    return parse_result_logs(decode_text(encoded(spark, folder, result_log())))


LATIN_SQL = "lang = 'fr' AND regexp_matches(text, '[^\\x00-\\x7F]')"


@query(f"""SELECT doc_id, CASE WHEN {LATIN_SQL} THEN 'latin-1' ELSE 'utf-8' END AS encoding, text FROM documents""")
def decoded_texts(spark, folder):
    decoded = decode_text(encoded(spark, folder, F.to_json(F.struct("text"))))
    return decoded.select("doc_id", "encoding", F.get_json_object("text", "$.text").alias("text"))


@query("""SELECT 'doc_' || doc_id || '.pdf' AS path, octet_length(encode(text)) AS size,
    least(100, octet_length(encode(text)))::INTEGER AS shown, left(lower(hex(encode(text))), 200) AS first_hex
FROM documents""")
def byte_profiles(spark, folder):
    docs = read(spark, folder, "documents")
    raw = docs.select(doc_name().alias("path"), F.encode("text", "UTF-8").alias("content"))
    return binary_profile(decode_text(raw))


def line_pages(content: bytes):
    lines = content.decode("utf-8").split("\n")
    for start in range(0, len(lines), LINES_PER_PAGE):
        yield "\n".join(lines[start : start + LINES_PER_PAGE])


@query(f"WITH {PAGES_SQL} SELECT doc, page, text, CAST(NULL AS VARCHAR) AS error FROM doc_pages")
def extracted_pages(spark, folder):
    docs = read(spark, folder, "documents")
    files = docs.select(F.concat(F.lit("in/"), doc_name()).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return extract_pages(files, line_pages)


def sentences(file):
    """The file's text, read a piece at a time, cut after every full stop and blank."""
    left = ""
    while piece := file.read(64):
        *whole, left = (left + piece.decode("latin-1")).split(". ")
        yield from (s.encode("latin-1").decode("utf-8") for s in whole)
    yield left.rstrip("\n").encode("latin-1").decode("utf-8")


@query("""SELECT item_id, CAST(idx AS INTEGER) AS page, s AS text, CAST(NULL AS VARCHAR) AS error
FROM (SELECT item_id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) AS idx FROM benchmark)""")
def pages_of_files(spark, folder):
    """Each benchmark item written as a file of its own; a page for each sentence, read out of the files by a data source."""
    found = read_pages(spark, item_files(spark, folder), "item_id=*/*.txt", sentences, bytes_per_task=2_000)
    return found.select(item_of("doc"), "page", "text", "error")


def item_files(spark, folder):
    path = f"{shared_folder(spark)}/textrec/page-files-{uuid.uuid4().hex}"
    items = read(spark, folder, "benchmark").select("item_id", F.col("text").alias("value"))
    items.repartition("item_id").write.partitionBy("item_id").text(path)
    return path


def item_of(name):
    return F.regexp_extract(name, r"item_id=(\d+)/", 1).cast("long").alias("item_id")


@query("""WITH texts AS (SELECT item_id, array_to_string(string_split(text, '. '), chr(10)) || chr(10) AS t FROM benchmark)
SELECT item_id, t AS full_text, md5('Summarise.|700|0.5|' || t) AS summary, CAST(length(t) AS VARCHAR) AS prompt_tokens,
    CAST(length(t) + 32 AS VARCHAR) AS total_tokens FROM texts""")
def summarised_folder(spark, folder):
    """Files summarised into a CSV file in one call, which is read back."""
    files = item_files(spark, folder)
    summarise_folder(spark, files, "item_id=*/*.txt", sentences, f"{files}-summaries", "instructed", BACKENDS, "Summarise.")
    back = spark.read.csv(f"{files}-summaries", header=True, multiLine=True, escape='"')
    return back.select(item_of("pdf_filename"), "full_text", "summary", "prompt_tokens", "total_tokens")


RESULTS_SQL = """results AS (
    SELECT 'doc_' || doc_id || '.pdf' AS file_path, unnest(range(1, len(l) + 1)) AS result_no, unnest(l) AS input, lang
    FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents))"""


@query(f"""WITH {RESULTS_SQL}
SELECT file_path, CAST(result_no AS INTEGER) AS result_no, input, lang AS target, reverse(input) AS response,
    CAST(length(input) AS VARCHAR) AS score FROM results WHERE result_no <= 3""")
def first_results(spark, folder):
    return explode_results(line_logs(spark, folder), 3).select(
        "file_path", "result_no", "result.sample.input", "result.sample.target", "result.response", "result.score"
    )


@query(f"""WITH {RESULTS_SQL}
SELECT file_path, CAST(result_no AS INTEGER) AS result_no, input AS question, lang AS target,
    reverse(input) AS response, CAST(length(input) AS VARCHAR) AS score
FROM results WHERE file_path = (SELECT min(file_path) FROM results) AND result_no <= 3""")
def results_of_first_log(spark, folder):
    return direct_results(line_logs(spark, folder))


@query(f"""WITH {RESULTS_SQL}
SELECT file_path, count(*) AS n FROM results WHERE file_path = (SELECT min(file_path) FROM results) GROUP BY file_path""")
def first_log_with_results(spark, folder):
    return first_nonempty(line_logs(spark, folder)).select("file_path", F.size("results").cast("bigint").alias("n"))


@query("""SELECT item_id % 5 = 0 AS broken, count(*) AS files,
    sum(CASE WHEN item_id % 5 > 0 THEN len(string_split(text, chr(10))) ELSE 0 END)::BIGINT AS results,
    sum(CASE WHEN item_id % 5 > 0 THEN length(text) - len(string_split(text, chr(10))) + 1 ELSE 0 END)::BIGINT AS chars
FROM benchmark GROUP BY 1""")
def scanned_result_logs(spark, folder):
    """A log for each benchmark item, written as a file of its own; every fifth is cut off. What each kind holds."""
    path = f"{shared_folder(spark)}/textrec/result-logs-{uuid.uuid4().hex}"
    items = read(spark, folder, "benchmark").withColumn("lang", F.lit("none"))
    log = F.when(F.col("item_id") % 5 == 0, F.left(result_log(), F.lit(20))).otherwise(result_log())
    items.select("item_id", log.alias("value")).write.partitionBy("item_id").text(path)
    logs = scan_result_logs(spark, [f"{path}/*"])
    inputs = F.aggregate("results", F.lit(0).cast("long"), lambda a, r: a + F.length(r["sample"]["input"]))
    read_well = F.col("results").isNotNull()
    return logs.groupBy(F.col("error").isNotNull().alias("broken")).agg(
        F.count("*").alias("files"),
        F.sum(F.when(read_well, F.size("results")).otherwise(0)).alias("results"),
        F.sum(F.when(read_well, inputs).otherwise(0)).alias("chars"),
    )


@query("""SELECT doc_id // 500 AS log, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS result_no,
    text AS input, lang AS target, source AS response, CAST(length(text) AS VARCHAR) AS score FROM documents""")
def results_of_large_logs(spark, folder):
    """Logs of 500 results each, one document a result, read split by split; one that is cut off is left out."""
    path = f"{shared_folder(spark)}/textrec/large-logs-{uuid.uuid4().hex}"
    sample = F.struct(F.col("text").alias("input"), F.col("lang").alias("target"))
    result = F.to_json(F.struct(sample.alias("sample"), F.col("source").alias("response"), F.length("text").cast("string").alias("score")))
    docs = read(spark, folder, "documents").select(F.floor(F.col("doc_id") / 500).alias("log"), "doc_id", result.alias("json"))
    place = Window.partitionBy("log").orderBy("doc_id")
    lines = docs.select("log", "doc_id", F.concat(F.when(F.row_number().over(place) > 1, ",").otherwise(""), "json").alias("value"))
    logs = docs.select("log").distinct()
    head = logs.select("log", F.lit(-1).alias("doc_id"), F.lit('{"eval": {"results": [1]}, "results": [').alias("value"))
    tail = logs.select("log", F.lit(2**62).alias("doc_id"), F.lit('], "stats": {"n": [{}]}}').alias("value"))
    cut_off = logs.limit(1).select(F.lit(-1).alias("log"), F.lit(0).alias("doc_id"), F.lit('{"results": [{"response": "x"}, {"resp').alias("value"))
    ordered = head.union(lines).union(tail).union(cut_off).repartition("log").sortWithinPartitions("log", "doc_id")
    ordered.select("log", "value").write.partitionBy("log").text(path)
    found, _ = split_result_logs(spark, f"{path}/*")
    log = F.regexp_extract("file_path", r"log=(-?\d+)/", 1).cast("long")
    return found.select(log.alias("log"), "result_no", "result.sample.input", "result.sample.target", "result.response", "result.score")
