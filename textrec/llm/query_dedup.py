"""Queries of the operators that find copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from textrec.llm.common import read
from textrec.llm.decontaminate import contamination
from textrec.llm.registry import query
from textrec.llm.repeats import remove_repeats
from textrec.llm.simhash import near_duplicates


@query()
def op1_simhash(spark, folder):
    """Fingerprint and component of every document."""
    found = near_duplicates(read(spark, folder, "documents"))
    digits = F.lpad(F.lower(F.hex("print")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


WORDS_SQL = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""


@query(f"""WITH doc_words AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
item_words AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
wins AS (
    SELECT item_id, list_slice(w, s + 1, s + 10) AS win
    FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS s FROM item_words WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM wins),
spots AS (SELECT doc_id, n, s, list_slice(w, s + 1, s + n) AS win
    FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM doc_words, lens)),
places AS (SELECT DISTINCT doc_id, item_id, s, n FROM spots JOIN wins USING (win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM places) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM places) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)""")
def op2_decontamination(spark, folder):
    """Words of every document that lie in ten-word passages of the benchmark."""
    found = contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def near_passages(spark, folder):
    """Proximity search: words in passages of the benchmark of which each may stand one place before or after its own."""
    found = contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"), slop=1)
    return found.select("doc_id", "n_words", "n_hit", F.array_join("items", ",").alias("items"))


@query()
def op3_suffixes(spark, folder):
    """What is left of every document without 100-byte strings that start earlier."""
    found = remove_repeats(read(spark, folder, "documents").select("doc_id", "text"))
    lengths = F.zip_with("ends", "starts", lambda b, a: b - a)
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
