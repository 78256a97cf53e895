"""Unions, fallbacks, counts, schema reports, and tables written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textrec.operators.filters import by_role, docs_with_any, tag_matches
from textrec.operators.records import as_table, read_records, record_fields
from textrec.operators.tables import (
    concat_tables,
    first_n,
    first_or_default,
    json_keys,
    records_table,
    schema_report,
    table_counts,
    with_fallback,
)
from textrec.queries.inputs import (
    MESSAGES_SQL,
    PAGES_SQL,
    SAMPLES_SQL,
    document_names,
    messages,
    pages,
    read,
    samples,
)
from textrec.queries.registry import query
from textrec.session import shared_folder
from textrec.sources.files import list_files
from textrec.sources.logs import LOG_TABLES, load_samples, load_tables
from textrec.sources.sinks import write_csv, write_split


def new_folder(spark, label: str) -> str:
    return f"{shared_folder(spark)}/textrec/{label}-{uuid.uuid4().hex}"


@query("""SELECT * FROM (SELECT 'documents' AS "table", count(*) AS rows FROM documents
UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'lineitem', count(*) FROM lineitem)""")
def row_counts(spark, folder):
    return table_counts({name: read(spark, folder, name) for name in ["documents", "conversations", "lineitem"]})


@query("""WITH c AS (SELECT count(*) AS rows, count(conv_id) AS a, count(turn) AS b, count(role) AS c, count(text) AS d
    FROM conversations)
SELECT 1 AS position, 'conv_id' AS "column", 'bigint' AS type, rows, a AS non_null FROM c
UNION ALL SELECT 2, 'turn', 'bigint', rows, b FROM c
UNION ALL SELECT 3, 'role', 'string', rows, c FROM c
UNION ALL SELECT 4, 'text', 'string', rows, d FROM c""")
def schema_lines(spark, folder):
    return schema_report(read(spark, folder, "conversations"))


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def json_key_counts(spark, folder):
    keys = read(spark, folder, "events").select(F.explode(json_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"))


@query("""SELECT doc_id AS id, text, lang, 'absent' AS role FROM documents
UNION ALL SELECT conv_id, text, 'absent', role FROM conversations""")
def records_with_any_columns(spark, folder):
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    talks = read(spark, folder, "conversations").select(F.col("conv_id").alias("id"), "text", "role")
    return records_table([docs, talks], fill="absent")


def uneven_records(spark, folder):
    """A log of one record a document, whose field ``size`` is a number, a text, an object or null, and every seventh is cut off."""
    path, kind = new_folder(spark, "uneven"), F.col("doc_id") % 4
    size = F.expr("""CASE doc_id % 4 WHEN 0 THEN string(n_chars) WHEN 1 THEN concat('"', n_chars, '"') WHEN 2 THEN concat('{"n": ', n_chars, '}') ELSE 'null' END""")
    lang = F.when(kind == 2, F.concat(F.lit(', "lang": "'), "lang", F.lit('"'))).otherwise("")
    line = F.concat(F.lit('{"id": '), "doc_id", F.lit(', "size": '), size, lang, F.when(F.col("doc_id") % 7 > 0, "}").otherwise(""))
    read(spark, folder, "documents").select(line.alias("value")).write.text(path)
    return read_records(spark, path)


@query("""WITH d AS (SELECT doc_id % 4 AS k FROM documents WHERE doc_id % 7 > 0)
SELECT 'id' AS field, 'BIGINT' AS kind, count(*) AS rows FROM d UNION ALL SELECT 'lang', 'STRING', count(*) FROM d WHERE k = 2
UNION ALL SELECT 'size', CASE k WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'STRING' WHEN 2 THEN 'OBJECT<n: BIGINT>' ELSE 'VOID' END, count(*)
FROM d GROUP BY k""")
def fields_of_uneven_records(spark, folder):
    return record_fields(uneven_records(spark, folder))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 4 < 2 THEN n_chars END AS size, CASE WHEN doc_id % 4 = 2 THEN n_chars END AS nested,
    CASE WHEN doc_id % 4 = 2 THEN lang END AS lang FROM documents WHERE doc_id % 7 > 0
UNION ALL SELECT NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 7 = 0""")
def uneven_records_as_table(spark, folder):
    """The records as a table with a column for every field; the one of several kinds is read as number and as object."""
    table = as_table(uneven_records(spark, folder))
    return table.select("id", F.try_variant_get("size", "$", "bigint").alias("size"), F.try_variant_get("size", "$.n", "bigint").alias("nested"), "lang")


@query("""SELECT text FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT text FROM documents""")
def concatenated(spark, folder):
    docs, talks = (read(spark, folder, t).select("text") for t in ["documents", "conversations"])
    return concat_tables(docs, talks, docs)


@query(f"WITH {MESSAGES_SQL} SELECT sample_id, turn, role FROM messages")
def fallback_used(spark, folder):
    told = messages(spark, folder).select("sample_id", "turn", "role")
    return with_fallback(by_role(told, "tool"), told)


@query(f"WITH {MESSAGES_SQL} SELECT sample_id, turn, role FROM messages WHERE role = 'assistant'")
def fallback_not_used(spark, folder):
    told = messages(spark, folder).select("sample_id", "turn", "role")
    return with_fallback(by_role(told, "assistant"), told)


@query("SELECT min(url) AS url FROM pages")
def first_or_default_hit(spark, folder):
    return first_or_default(read(spark, folder, "pages"), "url", "url", "none")


@query("SELECT coalesce(min(url), 'none') AS url FROM pages WHERE url = ''")
def first_or_default_miss(spark, folder):
    return first_or_default(read(spark, folder, "pages").where(F.col("url") == ""), "url", "url", "none")


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_records(spark, folder):
    """Conversations written as JSON lines and loaded with an inferred schema."""
    path = new_folder(spark, "records")
    read(spark, folder, "conversations").write.json(path)
    return load_samples(spark, path)


@query("SELECT doc_id, text, lang FROM documents")
def csv_table(spark, folder):
    """Documents written as CSV and read back, line breaks and quotes included."""
    path = new_folder(spark, "csv")
    write_csv(read(spark, folder, "documents").select("doc_id", "text", "lang"), path)
    back = spark.read.schema("doc_id bigint, text string, lang string")
    return back.csv(path, header=True, multiLine=True, escape='"')


@query(f"""WITH {PAGES_SQL}, flags AS (
    SELECT doc, bool_or(contains(lower(text), 'orantion')) AS matched FROM doc_pages GROUP BY doc)
SELECT doc, CAST(matched AS VARCHAR) AS matched FROM flags""")
def split_documents(spark, folder):
    """Documents written to a folder per flag and read back."""
    path = new_folder(spark, "split")
    write_split(tag_matches(document_names(spark, folder), docs_with_any(pages(spark, folder), ["orantion"])), path)
    return spark.read.parquet(path).select("doc", F.col("matched").cast("string").alias("matched"))


@query(f"""WITH {SAMPLES_SQL}
SELECT 'evals' AS "table", count(*) AS rows, sum(length(r_name))::BIGINT AS chars FROM region
UNION ALL SELECT 'samples', count(*), sum(length(input))::BIGINT FROM samples
UNION ALL SELECT 'messages', count(*), sum(length(text))::BIGINT FROM conversations""")
def loaded_log_tables(spark, folder):
    """The three tables of a log folder, written as JSON and loaded with their schemas."""
    path = new_folder(spark, "logs")
    made = {
        "evals": read(spark, folder, "region").select(F.col("r_name").alias("task")),
        "samples": samples(spark, folder),
        "messages": messages(spark, folder),
    }
    for name, df in made.items():
        df.write.json(f"{path}/{name}")
    texts = {"evals": "task", "samples": "input", "messages": "content"}
    loaded = load_tables(spark, path)
    counts = [
        loaded[name].agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.sum(F.length(texts[name])).alias("chars"))
        for name in LOG_TABLES
    ]
    return concat_tables(*counts)


@query("""SELECT 0 AS glob_no, 'lang=' || lang AS folder FROM documents GROUP BY lang
UNION ALL SELECT 1, 'lang=' || lang FROM documents WHERE lang LIKE 'e%' GROUP BY lang""")
def listed_folders(spark, folder):
    """Folders that hold files, of documents written to a folder per language."""
    path = new_folder(spark, "listed")
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    docs.write.partitionBy("lang").json(path)
    # A folder of the same name below it, whose files no pattern names.
    docs.where("lang = 'fr'").write.partitionBy("lang").json(f"{path}/deeper/{path.rsplit('/', 1)[-1]}")
    listed = list_files(spark, path, "lang=*/*.json", "lang=e?/part-*.json", "*.txt")
    return listed.select("glob_no", F.element_at(F.split("path", "/"), -2).alias("folder")).distinct()
