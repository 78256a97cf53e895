"""A stand-in model applied to columns of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textrec.operators.inference import (
    TOKENS,
    ask_model,
    build_messages,
    complete_prompts,
    usage_totals,
    write_back,
)
from textrec.functions.columns import ensure_columns
from textrec.operators.kept import kept_replies
from textrec.plans.evidence import evidence_table, summarise_documents
from textrec.queries.inputs import PAGES_SQL, pages, read, strip_sql
from textrec.queries.registry import query
from textrec.queries.standins import BACKENDS
from textrec.session import stored

SYSTEM = "Answer in one word."

ROLE_TURNS_SQL = """SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS prompt, role AS response FROM conversations"""


def prompts(spark, folder):
    """Conversation turns; those not said by the user have no prompt."""
    said = F.when(F.col("role") == "user", F.col("text"))
    key = F.format_string("%d/%d", "conv_id", "turn")
    return read(spark, folder, "conversations").select(key.alias("row_id"), said.alias("prompt"), F.col("role").alias("response"))


PROMPTS_SQL = """prompts AS (
    SELECT conv_id || '/' || turn AS row_id, CASE WHEN role = 'user' THEN text END AS prompt, role AS response
    FROM conversations)"""


def filled_sql(good: str, reply: str = "md5(prompt)") -> str:
    """Reply and token counts on the rows where ``good`` holds."""
    return f"""CASE WHEN {good} THEN {reply} ELSE response END AS response,
    CASE WHEN {good} THEN length(prompt) END AS prompt_tokens,
    CASE WHEN {good} THEN 32::BIGINT END AS completion_tokens,
    CASE WHEN {good} THEN length(prompt) + 32 END AS total_tokens"""


@query(f"WITH {PROMPTS_SQL} SELECT row_id, prompt, {filled_sql('prompt IS NOT NULL')} FROM prompts")
def completed_prompts(spark, folder):
    return complete_prompts(prompts(spark, folder), "digest", BACKENDS)


@query(f"""WITH {PROMPTS_SQL}
SELECT row_id, prompt, {filled_sql('prompt IS NOT NULL', f"md5('{SYSTEM}|50|0.5|' || prompt)")} FROM prompts""")
def completed_with_system(spark, folder):
    return complete_prompts(
        prompts(spark, folder), "instructed", BACKENDS, system=SYSTEM, max_tokens=50, temperature=0.5, batch_size=7
    )


@query(f"""WITH {PROMPTS_SQL}
SELECT row_id, prompt, {filled_sql('prompt IS NOT NULL', f"md5('{SYSTEM}|100|1.0|' || prompt)")} FROM prompts""")
def completed_with_inline_system(spark, folder):
    return complete_prompts(prompts(spark, folder), "instructed_inline", BACKENDS, system=SYSTEM)


@query(f"""WITH {PROMPTS_SQL}
SELECT row_id, prompt, {filled_sql("prompt IS NOT NULL AND length(prompt) % 4 = 2")},
    CASE WHEN length(prompt) % 2 = 1 THEN 'RuntimeError: odd' END AS error FROM prompts""")
def failed_calls(spark, folder):
    return complete_prompts(prompts(spark, folder), "moody", BACKENDS, error_col="error", batch_size=5)


@query(f"WITH {PROMPTS_SQL} SELECT row_id, prompt, {filled_sql('false')} FROM prompts")
def unknown_backend(spark, folder):
    return complete_prompts(prompts(spark, folder), "no such model", BACKENDS)


@query("""WITH said AS (SELECT conv_id, turn, text FROM conversations),
early AS (SELECT DISTINCT text FROM said WHERE turn < 2 AND text IS NOT NULL)
SELECT conv_id, turn, md5('Again.|9|0.0|' || said.text) AS reply, length(said.text) AS prompt_tokens, early.text IS NOT NULL AS had
FROM said LEFT JOIN early ON early.text = said.text""")
def resumed_run(spark, folder):
    """A run stopped after the first turns and started again over all; ``had`` tells whose reply was there by then."""
    run, asked = f"resumed-{uuid.uuid4().hex}", {"system": "Again.", "max_tokens": 9, "temperature": 0.0}
    said = read(spark, folder, "conversations").select(F.struct("conv_id", "turn").alias("place"), F.col("text").alias("prompt"))
    ask_model(said.where("place.turn < 2"), "place", BACKENDS["instructed"], run=run, **asked)
    before = stored(kept_replies(spark, run).where("error IS NULL").select("reply", F.lit(True).alias("had")), "before")
    replies = ask_model(said, "place", BACKENDS["instructed"], run=run, **asked).join(before, "reply", "left")
    return replies.select("place.conv_id", "place.turn", "reply", "prompt_tokens", F.coalesce("had", F.lit(False)).alias("had"))


@query("""SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'good' ELSE lang END AS response,
    CASE WHEN quality = 1 AND toxic = 0 THEN 1::BIGINT END AS prompt_tokens,
    CASE WHEN quality = 1 AND toxic = 0 THEN 2::BIGINT END AS completion_tokens,
    CASE WHEN quality = 1 AND toxic = 0 THEN 3::BIGINT END AS total_tokens
FROM documents LEFT JOIN labels USING (doc_id)""")
def replies_written_back(spark, folder):
    """Replies from a table: empty for poor documents, without usage for toxic ones."""
    rows = read(spark, folder, "documents").select("doc_id", F.col("lang").alias("response"))
    used = {t: F.when(F.col("toxic") == 0, F.lit(i).cast("bigint")) for i, t in enumerate(TOKENS, 1)}
    reply = F.when(F.col("quality") == 1, "good").otherwise("")
    replies = read(spark, folder, "labels").withColumns({"reply": reply, "error": F.lit(None).cast("string"), **used})
    return write_back(ensure_columns(rows, {}, TOKENS), replies, "doc_id")


@query(f"""WITH {PROMPTS_SQL}, done AS (SELECT split_part(row_id, '/', 2) AS turn, prompt FROM prompts)
SELECT turn, count(prompt) AS answered, sum(length(prompt))::BIGINT AS prompt_tokens,
    (32 * nullif(count(prompt), 0))::BIGINT AS completion_tokens, sum(length(prompt) + 32)::BIGINT AS total_tokens
FROM done GROUP BY turn""")
def token_usage(spark, folder):
    done = complete_prompts(prompts(spark, folder), "digest", BACKENDS)
    return usage_totals(done.withColumn("turn", F.element_at(F.split("row_id", "/"), 2)), ["turn"])


@query("""SELECT conv_id, turn, unnest(range(1, len(m) + 1)) AS place, unnest(m).role AS role, unnest(m).content AS content
FROM (SELECT conv_id, turn, CASE WHEN role = 'system' THEN [{'role': 'system', 'content': 'Be brief.'}]
    ELSE [{'role': 'system', 'content': 'Be brief.'}, {'role': role, 'content': text}] END AS m FROM conversations)""")
def built_messages(spark, folder):
    """Each turn as a conversation with the system prompt first."""
    part = lambda role: F.when(F.col("role") == role, F.col("text")).alias(role)
    turns = F.array(F.struct(part("user"), part("assistant")))
    built = read(spark, folder, "conversations").select(
        "conv_id", "turn", F.posexplode(build_messages(turns, "Be brief.", inline=True)).alias("at", "m")
    )
    return built.select("conv_id", "turn", (F.col("at") + 1).cast("bigint").alias("place"), "m.role", "m.content")


EVIDENCE_SQL = f"""{PAGES_SQL},
whole AS (SELECT doc, left(string_agg(text, chr(10) ORDER BY page) || chr(10), 750000) AS t
    FROM doc_pages WHERE text <> '' GROUP BY doc),
evidence AS (SELECT doc AS pdf_filename, replace(replace(doc, '.pdf', ''), '_', ' ') AS pdf_title, t AS full_text
    FROM whole WHERE length({strip_sql('t')}) > 0)"""


@query(f"WITH {EVIDENCE_SQL} SELECT * FROM evidence")
def evidence_documents(spark, folder):
    return evidence_table(pages(spark, folder))


@query(f"""WITH {EVIDENCE_SQL}
SELECT pdf_filename, pdf_title, md5('Summarise.|700|0.5|' || full_text) AS summary, length(full_text) AS prompt_tokens,
    32::BIGINT AS completion_tokens, length(full_text) + 32 AS total_tokens FROM evidence""")
def document_summaries(spark, folder):
    return summarise_documents(pages(spark, folder), "instructed", BACKENDS, system="Summarise.").drop("full_text")
