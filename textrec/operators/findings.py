"""Structured findings: grouping, titles, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
NO_TITLE = "Unknown"
FINDING_FIELDS = ["question_num", "quote", "source", "page", "summary"]


def question_list(questions: DataFrame) -> DataFrame:
    """One row with the column ``questions``: the question texts by number, as indented JSON for a prompt."""
    line = F.concat(F.lit('  "'), F.col("question_num").cast("string"), F.lit('": '), _quoted(F.col("question")))
    lines = questions.agg(F.array_sort(F.collect_list(F.struct("question_num", line.alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda r: r["line"]), ",\n")
    return lines.select(F.when(F.size("lines") == 0, "{}").otherwise(F.concat(F.lit("{\n"), body, F.lit("\n}"))).alias("questions"))


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def with_titles(df: DataFrame, titles: DataFrame, key: str = "question_num", title: str = "title") -> DataFrame:
    """Title per row, ``Unknown`` where the number has none.

    Spark broadcasts the titles when they are below its size threshold and
    joins by key otherwise.
    """
    return df.join(titles.select(key, title), key, "left").withColumn(title, F.coalesce(title, F.lit(NO_TITLE)))


def findings_by_question(findings: DataFrame) -> DataFrame:
    """``(question_num, findings)``: the findings of a question in order, a row for each question.

    A null question number is a group of its own. For callers who want a list: a
    row holds all findings of a question. ``indexed_findings`` of ``plans.themes``
    is the long form, which the reports and the themes are made from.
    """
    fields = F.struct("batch", "pos", *FINDING_FIELDS, "raw")
    return findings.groupBy("question_num").agg(F.array_sort(F.collect_list(fields)).alias("findings"))


def report_totals(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: documents, matched documents, findings."""
    return docs.agg(
        F.count("*").alias("total_documents"), F.count_if("matched").alias("relevant_documents")
    ).withColumn("total_findings", findings.agg(F.count("*")).scalar())


def sections(df: DataFrame, order: Sequence[str] = ("question_num",)) -> DataFrame:
    """Report sections in ascending order of question."""
    return df.orderBy(*order)
