"""Scores of replies against targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from textrec.operators.scoring import accuracy, exact_score, graded_score
from textrec.plans.evaluation import evaluate
from textrec.queries.inputs import SAMPLES_SQL, read, samples
from textrec.queries.registry import query
from textrec.queries.standins import BACKENDS

GRADE_TEMPLATE = "Does the answer hold the fact?\nAnswer: {answer}\nFact: {fact}"
GRADE_PATTERN = r"GRADE:\s*([CI])"


def replies(spark, folder):
    """Documents as replies, their source in capitals and their language as target."""
    return read(spark, folder, "documents").select(
        "doc_id", "source", F.upper("lang").alias("response"), F.when(F.col("lang") != "es", F.col("lang")).alias("target")
    )


REPLIES_SQL = """replies AS (
    SELECT doc_id, source, upper(lang) AS response, CASE WHEN lang <> 'es' THEN lang END AS target FROM documents)"""


@query(f"WITH {REPLIES_SQL} SELECT *, coalesce(response = target, false) AS correct FROM replies")
def exact_match(spark, folder):
    return exact_score(replies(spark, folder))


@query(f"WITH {REPLIES_SQL} SELECT *, coalesce(lower(response) = lower(target), false) AS correct FROM replies")
def exact_match_normalised(spark, folder):
    return exact_score(replies(spark, folder), normalise=True)


@query(f"""WITH {REPLIES_SQL}
SELECT source, count(*) AS rows, sum(c)::BIGINT AS correct_rows, avg(c) AS accuracy
FROM (SELECT source, CAST(coalesce(lower(response) = lower(target), false) AS BIGINT) AS c FROM replies) GROUP BY source""")
def accuracy_by_source(spark, folder):
    return accuracy(exact_score(replies(spark, folder), normalise=True), ["source"])


@query(f"""WITH {SAMPLES_SQL}
SELECT sample_id, target, CASE WHEN contains(input, coalesce(target, 'None')) THEN 'C' ELSE 'I' END AS grade FROM samples""")
def graded_answers(spark, folder):
    graded = graded_score(
        samples(spark, folder), BACKENDS["grade"], GRADE_TEMPLATE, GRADE_PATTERN, {"answer": "input", "fact": "target"}
    )
    return graded.select("sample_id", "target", "grade")


@query(f"""WITH s AS (SELECT doc_id, text AS input, CASE WHEN lang = 'en' THEN md5(text) ELSE lang END AS target FROM documents)
SELECT doc_id, target, md5(input) AS response, length(input) + 32 AS total_tokens, target = md5(input) AS correct FROM s""")
def evaluation_run(spark, folder):
    target = F.when(F.col("lang") == "en", F.md5("text")).otherwise(F.col("lang"))
    rows = read(spark, folder, "documents").select("doc_id", F.col("text").alias("input"), target.alias("target"))
    run = evaluate(rows, "digest", BACKENDS, exact_score)
    return run.select("doc_id", "target", "response", "total_tokens", "correct")


@query("""WITH s AS (SELECT text AS input, source, CASE WHEN lang = 'en' THEN md5(text) ELSE lang END AS target FROM documents)
SELECT source, count(*) AS rows, sum(CAST(target = md5(input) AS BIGINT))::BIGINT AS correct_rows,
    avg(CAST(target = md5(input) AS BIGINT)) AS accuracy FROM s GROUP BY source""")
def evaluation_accuracy(spark, folder):
    target = F.when(F.col("lang") == "en", F.md5("text")).otherwise(F.col("lang"))
    rows = read(spark, folder, "documents").select("doc_id", "source", F.col("text").alias("input"), target.alias("target"))
    return accuracy(evaluate(rows, "digest", BACKENDS, exact_score), ["source"])


@query(f"""WITH {SAMPLES_SQL}
SELECT sample_id, coalesce(target, CASE WHEN length(input) % 2 = 0 THEN left(md5(input), 9) ELSE reverse(left(md5(input), 9)) END) AS target,
    md5(input) AS response, CASE WHEN contains(md5(input), coalesce(target, CASE WHEN length(input) % 2 = 0 THEN left(md5(input), 9)
        ELSE reverse(left(md5(input), 9)) END)) THEN 'C' ELSE 'I' END AS grade FROM samples""")
def graded_evaluation(spark, folder):
    """Digests as replies, graded by whether they hold the target; samples without one expect a digest's begin, every other one backward."""
    begin = F.left(F.md5("input"), F.lit(9))
    made = F.when(F.length("input") % 2 == 0, begin).otherwise(F.reverse(begin))
    expected = samples(spark, folder).withColumn("target", F.coalesce("target", made))
    values = {"answer": "response", "fact": "target"}
    scorer = lambda df: graded_score(df, BACKENDS["grade"], GRADE_TEMPLATE, GRADE_PATTERN, values)
    return evaluate(expected, "digest", BACKENDS, scorer).select("sample_id", "target", "response", "grade")
