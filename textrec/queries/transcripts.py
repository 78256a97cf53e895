"""Messages, questions, replies and the transcript report."""

from __future__ import annotations

from pyspark.sql import functions as F

from textrec.operators.transcripts import (
    first_reply,
    group_messages,
    join_message_blocks,
    join_messages,
    message_blocks,
    question,
    system_prompt,
    transcript_rows,
)
from textrec.plans.transcripts import transcript_or_logs, transcript_report
from textrec.queries.inputs import MESSAGES_SQL, SAMPLES_SQL, messages, samples
from textrec.queries.logs import RESULTS_SQL, line_logs
from textrec.queries.registry import query

FIRSTS_SQL = f"""{MESSAGES_SQL}, {SAMPLES_SQL},
users AS (SELECT sample_id, arg_min_null(content, turn) AS first_user FROM messages WHERE role = 'user' GROUP BY sample_id),
answers AS (SELECT sample_id, arg_min(content, turn) AS reply FROM messages
    WHERE role = 'assistant' AND content <> '' GROUP BY sample_id),
report AS (
    SELECT s.sample_id, CASE WHEN u.sample_id IS NOT NULL THEN u.first_user ELSE s.input END AS question,
        s.target, coalesce(a.reply, 'No response found') AS response, s.score
    FROM samples s LEFT JOIN users u ON u.sample_id = s.sample_id LEFT JOIN answers a ON a.sample_id = s.sample_id
    WHERE s.input IS NOT NULL)"""


def flat(grouped):
    """One text per list, to compare it by."""
    line = lambda m: F.format_string("%d %s %s", m["turn"], m["role"], m["content"])
    return F.md5(F.array_join(F.transform("messages", line), "\n"))


GROUPED_SQL = f"""{MESSAGES_SQL},
grouped AS (
    SELECT sample_id, count(*) AS n,
        md5(string_agg(turn || ' ' || role || ' ' || content, chr(10) ORDER BY turn)) AS digest
    FROM messages GROUP BY sample_id)"""


@query(f"WITH {GROUPED_SQL} SELECT sample_id, n, digest FROM grouped")
def grouped_messages(spark, folder):
    grouped = group_messages(messages(spark, folder))
    return grouped.select("sample_id", F.size("messages").cast("bigint").alias("n"), flat(grouped).alias("digest"))


@query(f"""WITH {GROUPED_SQL}, {SAMPLES_SQL}
SELECT s.sample_id, s.target, coalesce(g.n, 0) AS n, coalesce(g.digest, md5('')) AS digest
FROM samples s LEFT JOIN grouped g ON g.sample_id = s.sample_id""")
def joined_messages(spark, folder):
    joined = join_messages(samples(spark, folder), group_messages(messages(spark, folder)))
    return joined.select("sample_id", "target", F.size("messages").cast("bigint").alias("n"), flat(joined).alias("digest"))


@query(f"""WITH {MESSAGES_SQL}, {SAMPLES_SQL},
placed AS (SELECT *, (row_number() OVER (PARTITION BY sample_id ORDER BY turn) - 1) // 2 AS block FROM messages),
blocks AS (
    SELECT sample_id, block, count(*) AS n, md5(string_agg(turn || ' ' || role || ' ' || content, chr(10) ORDER BY turn)) AS digest
    FROM placed GROUP BY sample_id, block)
SELECT s.sample_id, coalesce(b.block, 0) AS block, coalesce(b.n, 0)::INTEGER AS n_messages, coalesce(b.digest, md5('')) AS digest
FROM samples s LEFT JOIN blocks b ON b.sample_id = s.sample_id""")
def messages_in_blocks(spark, folder):
    """The messages of every sample, two in a row."""
    joined = join_message_blocks(samples(spark, folder), message_blocks(messages(spark, folder), 2))
    return joined.select("sample_id", "block", "n_messages", flat(joined).alias("digest"))


@query(f"WITH {FIRSTS_SQL} SELECT sample_id, question FROM report")
def first_user_message(spark, folder):
    return question(samples(spark, folder), messages(spark, folder))


@query(f"WITH {FIRSTS_SQL} SELECT sample_id, response FROM report")
def first_nonempty_reply(spark, folder):
    return first_reply(samples(spark, folder), messages(spark, folder))


@query(f"WITH {MESSAGES_SQL} SELECT content FROM messages WHERE role = 'system' ORDER BY sample_id, turn LIMIT 1")
def first_system_prompt(spark, folder):
    return system_prompt(messages(spark, folder))


@query(f"""WITH {FIRSTS_SQL}
SELECT *, CAST(row_number() OVER (ORDER BY sample_id) AS INTEGER) AS sample_no
FROM report ORDER BY sample_id LIMIT 3""")
def transcript_report_first(spark, folder):
    return transcript_report(samples(spark, folder), messages(spark, folder))


@query(f"WITH {FIRSTS_SQL} SELECT * FROM report")
def transcript_report_all(spark, folder):
    return transcript_rows(samples(spark, folder), messages(spark, folder))


@query(f"""WITH {FIRSTS_SQL}
SELECT CAST(row_number() OVER (ORDER BY sample_id) AS INTEGER) AS sample_no, question, target, response, score
FROM report ORDER BY sample_id LIMIT 3""")
def report_before_logs(spark, folder):
    return transcript_or_logs(samples(spark, folder), messages(spark, folder), line_logs(spark, folder))


@query(f"""WITH {RESULTS_SQL}
SELECT CAST(result_no AS INTEGER) AS sample_no, input AS question, lang AS target, reverse(input) AS response,
    CAST(length(input) AS VARCHAR) AS score
FROM results WHERE file_path = (SELECT min(file_path) FROM results) AND result_no <= 3""")
def logs_after_empty_report(spark, folder):
    """No sample has an input, so the raw logs are shown."""
    bare = samples(spark, folder).drop("input")
    return transcript_or_logs(bare, messages(spark, folder), line_logs(spark, folder))
