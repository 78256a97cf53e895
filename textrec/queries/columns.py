"""Column helpers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textrec.functions.columns import (
    cap_chars,
    category_rank,
    clean_name,
    col_or,
    ensure_columns,
    lead_sentence,
    lookup,
    nested_or,
    strip,
    title_from_path,
)
from textrec.functions.keywords import any_keyword
from textrec.queries.inputs import SAMPLES_SQL, any_sql, read, samples, strip_sql
from textrec.queries.registry import query

MANY_WORDS = [
    "data", "orantion", "eadeau", "thion", "ingen", "schen", "quevi", "ouères", "ladelos", "tiondo", "heren",
    "unglich", "ichter", "cionel", "mentrai", "eraner", "wharea", "stedly", "blenth", "vioneau", "thandre", "ouble",
]


@query(f"""WITH {SAMPLES_SQL}
SELECT sample_id, target, score, 'No grade found' AS grade FROM samples""")
def column_or_default(spark, folder):
    rows = samples(spark, folder)
    return rows.select(
        "sample_id",
        col_or(rows, "target", "No target found").alias("target"),
        col_or(rows, "score", "No score found").alias("score"),
        col_or(rows, "grade", "No grade found").alias("grade"),
    )


@query(f"""WITH {SAMPLES_SQL}
SELECT sample_id, input AS question, coalesce(target, 'N/A') AS target, 'N/A' AS response FROM samples""")
def nested_or_default(spark, folder):
    rows = samples(spark, folder).select("sample_id", F.struct(F.struct("input", "target").alias("sample")).alias("r"))
    return rows.select(
        "sample_id",
        nested_or(rows, "r.sample.input", "N/A").alias("question"),
        nested_or(rows, "r.sample.target", "N/A").alias("target"),
        nested_or(rows, "r.response", "N/A").alias("response"),
    )


@query("""SELECT doc_id, lang AS response, CAST(NULL AS BIGINT) AS prompt_tokens,
    CAST(NULL AS BIGINT) AS completion_tokens, CAST(NULL AS BIGINT) AS total_tokens FROM documents""")
def add_missing_columns(spark, folder):
    docs = read(spark, folder, "documents")
    rows = docs.select("doc_id", F.col("lang").alias("response"), F.col("n_chars").alias("total_tokens"))
    tokens = dict.fromkeys(["prompt_tokens", "completion_tokens", "total_tokens"], "bigint")
    return ensure_columns(rows, keep={"response": "string"}, reset=tokens)


@query(f"""SELECT page_id, {strip_sql("replace(replace(list_extract(string_split(url, '/'), -1), '?page=2', ''), '_', ' ')")}
    AS title FROM pages""")
def page_titles(spark, folder):
    return read(spark, folder, "pages").select("page_id", title_from_path("url", "?page=2").alias("title"))


@query("SELECT doc_id, replace('report_' || source || '_' || doc_id, '_', ' ') AS title FROM documents")
def title_from_file_name(spark, folder):
    paths = F.format_string("in/report_%s_%d.pdf", "source", "doc_id")
    return read(spark, folder, "documents").select("doc_id", title_from_path(paths).alias("title"))


@query(f"""SELECT p_partkey, {strip_sql("replace(' **' || p_name || ' * ', '*', '')")} AS name FROM part""")
def clean_names(spark, folder):
    marked = F.concat(F.lit(" **"), "p_name", F.lit(" * "))
    return read(spark, folder, "part").select("p_partkey", clean_name(marked).alias("name"))


@query("SELECT doc_id, length(left(text, 2000)) AS n, md5(left(text, 2000)) AS digest FROM documents")
def cap_text(spark, folder):
    capped = read(spark, folder, "documents").select("doc_id", cap_chars("text", 2000).alias("text"))
    return capped.select("doc_id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


@query(f"""WITH d AS (SELECT doc_id, {strip_sql('text')} AS t FROM documents),
m AS (SELECT doc_id, t, regexp_extract(t, '([^.!?]+[.!?])', 1) AS s FROM d)
SELECT doc_id, CASE WHEN s <> '' THEN s WHEN length(t) > 150 THEN left(t, 150) || '...' ELSE t END AS lead FROM m""")
def lead_sentences(spark, folder):
    return read(spark, folder, "documents").select("doc_id", lead_sentence(strip("text")).alias("lead"))


@query("""SELECT doc_id, lang, CAST(nullif(list_position(['fr', 'en', 'de'], lang), 0) AS INTEGER) AS lang_rank
    FROM documents""")
def ordered_category(spark, folder):
    docs = read(spark, folder, "documents")
    return docs.select("doc_id", "lang", category_rank("lang", ["fr", "en", "de"]).alias("lang_rank"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'blue' WHEN 'view' THEN 'green' WHEN 'error' THEN 'red' END
    AS colour FROM events""")
def constant_lookup(spark, folder):
    colours = {"click": "blue", "view": "green", "error": "red"}
    return read(spark, folder, "events").select("event_id", lookup("event_type", colours).alias("colour"))


@query(f"""SELECT doc_id, {any_sql('lower(text)', ['Data', 'ORANTION'])} AS few,
    {any_sql('lower(text)', MANY_WORDS)} AS many FROM documents""")
def any_keywords(spark, folder):
    return read(spark, folder, "documents").select(
        "doc_id", any_keyword("text", ["Data", "ORANTION"]).alias("few"), any_keyword("text", MANY_WORDS).alias("many")
    )


@query("""SELECT lang, sum(CAST(contains(lower(text), 'the') AS BIGINT))::BIGINT AS folded,
    sum(CAST(contains(text, 'the') AS BIGINT))::BIGINT AS as_written FROM documents GROUP BY lang""")
def case_folding(spark, folder):
    return read(spark, folder, "documents").groupBy("lang").agg(
        F.count_if(any_keyword("text", ["THE"])).alias("folded"),
        F.count_if(F.contains("text", F.lit("the"))).alias("as_written"),
    )
