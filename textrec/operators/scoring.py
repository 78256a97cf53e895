"""Scores of replies against targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrec.functions.columns import strip
from textrec.operators.inference import Backend, answered
from textrec.operators.texts import rendered
from textrec.session import stored


def exact_score(
    df: DataFrame, reply: str = "response", target: str = "target", normalise: bool = False, name: str = "correct"
) -> DataFrame:
    """True where the reply equals the target; a missing reply is wrong.

    ``normalise`` compares without case and outer white space.
    """
    a, b = F.col(reply), F.col(target)
    if normalise:
        a, b = F.lower(strip(a)), F.lower(strip(b))
    return df.withColumn(name, F.coalesce(a == b, F.lit(False)))


def accuracy(df: DataFrame, by: Sequence[str] = (), correct: str = "correct") -> DataFrame:
    """Rows, correct rows and their share, overall or per group."""
    hit = F.col(correct).cast("bigint")
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.sum(hit).alias("correct_rows"), F.avg(hit).alias("accuracy")
    )


def graded_score(
    df: DataFrame,
    grader: Backend,
    template: str,
    pattern: str,
    values: Mapping[str, str],
    name: str = "grade",
    **options,
) -> DataFrame:
    """Grade read from the reply to a second prompt about each row.

    ``values`` maps the template's names to columns; ``pattern`` holds the
    grade as its first group. No match, or no reply, gives null.
    """
    prompts = df.withColumn("_prompt", rendered(template, **{n: F.col(c) for n, c in values.items()}))
    replies = answered(prompts, grader, "_prompt", **options)
    found = F.regexp_extract("_reply", pattern, 1)
    return stored(replies.select(*df.columns, F.when(found != "", found).alias(name)), "graded")
