"""The operators' input tables built from the given ones, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrec.functions.columns import WHITESPACE

LINES_PER_PAGE = 4


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    talks = read(spark, folder, "conversations")
    return talks.select(F.col("conv_id").alias("sample_id"), "turn", "role", F.col("text").alias("content"))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("input"))
    targets = read(spark, folder, "benchmark").select(F.col("item_id").alias("sample_id"), F.col("text").alias("target"))
    scores = read(spark, folder, "labels").select(
        F.col("doc_id").alias("sample_id"), F.col("quality").cast("string").alias("score")
    )
    return docs.join(targets, "sample_id", "left").join(scores, "sample_id", "left")


def doc_name() -> Column:
    return F.format_string("doc_%d.pdf", "doc_id")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents cut into pages of a few lines each."""
    lines = F.split("text", "\n")
    count = F.ceil(F.size("lines") / LINES_PER_PAGE)
    chunk = lambda i: F.array_join(F.slice("lines", i * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), "\n")
    chunks = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), chunk)
    paged = read(spark, folder, "documents").select(doc_name().alias("doc"), lines.alias("lines"))
    return paged.select("doc", F.posexplode(chunks).alias("at", "text")).select(
        "doc", (F.col("at") + 1).alias("page"), "text", F.lit(None).cast("string").alias("error")
    )


def document_names(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select(doc_name().alias("doc"))


MESSAGES_SQL = "messages AS (SELECT conv_id AS sample_id, turn, role, text AS content FROM conversations)"

SAMPLES_SQL = """samples AS (
    SELECT d.doc_id AS sample_id, d.text AS input, b.text AS target, CAST(l.quality AS VARCHAR) AS score
    FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

PAGES_SQL = f"""doc_lines AS (
    SELECT 'doc_' || doc_id || '.pdf' AS doc, string_split(text, chr(10)) AS lines FROM documents),
doc_pages AS (
    SELECT doc, CAST(idx + 1 AS INTEGER) AS page,
           array_to_string(list_slice(lines, idx * {LINES_PER_PAGE} + 1, idx * {LINES_PER_PAGE} + {LINES_PER_PAGE}), chr(10)) AS text
    FROM (SELECT doc, lines, unnest(range((len(lines) + {LINES_PER_PAGE - 1}) // {LINES_PER_PAGE})) AS idx FROM doc_lines))"""


def strip_sql(expression: str) -> str:
    return f"trim({expression}, '{WHITESPACE}')"


PARAS_SQL = f"""{PAGES_SQL},
pieces AS (
    SELECT doc AS source, page, CAST(unnest(range(len(parts))) AS INTEGER) AS para, unnest(parts) AS piece
    FROM (SELECT doc, page, string_split(text, chr(10)) AS parts FROM doc_pages)),
paras AS (
    SELECT source, page, para, {strip_sql('piece')} AS text FROM pieces WHERE length({strip_sql('piece')}) > 50)"""


def any_sql(low: str, words) -> str:
    return "(" + " OR ".join(f"contains({low}, '{w.lower()}')" for w in words) + ")"
