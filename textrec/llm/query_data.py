"""Queries over conversations, pages, embeddings and whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textrec.llm.chat import render_conversations
from textrec.llm.common import read, scratch
from textrec.llm.registry import query
from textrec.llm.sharding import SLOTS, place, slot_table, write_shards
from textrec.llm.topk import top_k
from textrec.llm.urls import judge_urls

SHARDS = [f"shard-{i:02d}" for i in range(64)]

# Rules of the URL query: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query("""WITH placed AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
           role, text FROM conversations),
whole AS (
    SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY place) AS turns,
           string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
    FROM placed GROUP BY conv_id),
one AS (SELECT min(conv_id) AS conv_id, n, count(*) AS copies, turns, any_value(rendered) AS rendered FROM whole GROUP BY n, turns),
begun AS (SELECT DISTINCT list_slice(turns, 1, k) AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM one))
SELECT conv_id, CAST(n AS INTEGER) AS n_turns, copies, rendered FROM one
WHERE NOT EXISTS (SELECT 1 FROM begun WHERE begun.turns = one.turns)""")
def op5_chat(spark, folder):
    """Every conversation that no other one continues, rendered."""
    return render_conversations(read(spark, folder, "conversations"))


@query(f"""WITH cut AS (
    SELECT page_id, coalesce(url, '') AS url,
           CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
fits AS (
    SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
           row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS place
    FROM named LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1""")
def op6_urls(spark, folder):
    """Host, path, rule and verdict of every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(read(spark, folder, "pages"), rules)


@query("""WITH whole AS (
    SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op7_topk(spark, folder):
    """The five best rows for every row whose id is divisible by 50."""
    return top_k(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def _shard_letters() -> str:
    """The query's table as text, a letter per slot."""
    return "".join(chr(48 + i) for i in slot_table(tuple(SHARDS), SLOTS))


@query(f"""WITH slots AS (
    SELECT doc_id, CAST(CAST('0x' || substr(md5('=' || doc_id), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot, strlen(text) AS n_bytes
    FROM documents)
SELECT doc_id, n_bytes, slot, format('shard-{{:02d}}', ascii(substr($table${_shard_letters()}$table$, slot + 1, 1)) - 48) AS shard FROM slots""")
def op9_sharding(spark, folder):
    """The slot and shard of every document."""
    docs = read(spark, folder, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return place(docs, ["doc_id"], SHARDS)


@query(f"""WITH slots AS (
    SELECT doc_id, strlen(text) AS n_bytes, CAST(CAST('0x' || substr(md5('=' || doc_id), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot
    FROM documents)
SELECT format('shard-{{:02d}}', ascii(substr($table${_shard_letters()}$table$, slot + 1, 1)) - 48) AS shard, count(*) AS documents,
    CAST(sum(n_bytes) AS BIGINT) AS n_bytes, CAST(sum(doc_id) AS BIGINT) AS doc_ids FROM slots GROUP BY shard""")
def written_shards(spark, folder):
    """What each shard's folder holds after all documents were written to theirs."""
    path = scratch(spark, "shards")
    write_shards(place(read(spark, folder, "documents").select("doc_id", "text"), ["doc_id"], SHARDS), path)
    back = spark.read.parquet(path).groupBy(F.col("shard").cast("string").alias("shard"))
    return back.agg(F.count("*").alias("documents"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"), F.sum("doc_id").alias("doc_ids"))
