"""Markdown and JSON reports as ordered lines, so that a report may be of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrec.operators.findings import with_titles
from textrec.operators.tables import concat_tables
from textrec.operators.texts import rendered
from textrec.plans.themes import Themes

# The lines of a Markdown report.
HEADING = "# {heading}"
DATE_LINE = "Generated: {x}"
TOTAL_LINE = "Total Documents: {x}"
RELEVANT_LINE = "Documents Analyzed ({criteria}): {x}"
FINDINGS_LINE = "Total Relevant Findings: {x}"
SUMMARY_HEADING = "## Executive Summary"
QUESTION_HEADING = "## Question {number}: {title}"
THEME_HEADING = "### {x}"
QUOTES_HEADING = "**Key Quotes:**"
QUOTE_LINE = '- "{x}"'

# The keys of a JSON report.
DATE_KEY = "analysis_date"
COUNT_KEYS = ["total_documents", "relevant_documents", "total_findings"]
CRITERIA_KEY = "filter_criteria"
QUESTIONS_KEY = "questions"
CLUSTERS_KEY = "clusters"
INDICES_KEY = "finding_indices"
QUOTES_KEY = "key_quotes"
RAW_KEY = "raw_findings"

# Columns that put report lines in order.
ORDER = ["section", "question_num", "block", "item", "step", "line_no"]

KEEP_NULLS = {"ignoreNullFields": "false"}


def _lines(rows: DataFrame, lines: list[Column | str], section: int, block: int = 0, **place: str) -> DataFrame:
    """The lines of each row with their order columns; unnamed places sort first."""

    def at(name: str, kind: str) -> Column:
        value = F.col(place[name]) if name in place else F.lit(None)
        return F.coalesce(value.cast(kind), F.lit(-1).cast(kind)).alias(name)

    listed = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    return rows.select(
        F.lit(section).alias("section"),
        at("question_num", "int"),
        F.lit(block).alias("block"),
        at("item", "int"),
        at("step", "int"),
        F.posexplode(listed).alias("line_no", "line"),
    )


def _text(template: str, **values: str) -> Column:
    return rendered(template, **{n: F.col(c) for n, c in values.items()})


def markdown_report(
    totals: DataFrame, themes: Themes, titles: DataFrame, heading: str, criteria: str, summary: str
) -> DataFrame:
    """Totals, then by question its title, themes, summaries and quotes.

    ``totals`` has one row with ``analysis_date`` and the three counts.
    """
    top = [
        rendered(HEADING, heading=heading),
        _text(DATE_LINE, x="analysis_date"),
        _text(TOTAL_LINE, x="total_documents"),
        rendered(RELEVANT_LINE, criteria=criteria, x=F.col("relevant_documents")),
        _text(FINDINGS_LINE, x="total_findings"),
        *["", SUMMARY_HEADING, ""],
        *summary.split("\n"),
        "",
    ]
    titled = with_titles(themes.questions, titles)
    heads = ["", _text(QUESTION_HEADING, number="question_num", title="title"), ""]
    each = themes.themes
    place = {"question_num": "question_num", "item": "item"}
    theme = [_text(THEME_HEADING, x="theme"), "", _text("{x}", x="summary"), "", QUOTES_HEADING]
    quotes = each.select("*", F.posexplode("key_quotes").alias("step", "quote"))
    last = each.withColumn("step", F.lit(2**31 - 1))
    return concat_tables(
        _lines(totals, top, 0),
        _lines(titled, heads, 1, question_num="question_num"),
        _lines(each, theme, 1, 1, **place),
        _lines(quotes, [_text(QUOTE_LINE, x="quote")], 1, 1, step="step", **place),
        _lines(last, [""], 1, 1, step="step", **place),
    )


def json_report(totals: DataFrame, themes: Themes, indexed: DataFrame, criteria: str) -> DataFrame:
    """One nested JSON document: totals, then by answered question its clusters and raw findings.

    The head and the tail of a cluster, every finding that belongs to it and every
    raw finding are lines of their own, so no line grows with a question; a
    finding is as its reply gave it. ``indexed`` is the output of ``indexed_findings``.
    """

    def quoted(value: Column) -> Column:
        listed = F.to_json(F.array(value))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    def entry(key: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{key}": '), value, F.lit(","))

    counts = [entry(key, F.col(key).cast("string")) for key in COUNT_KEYS]
    head = [
        "{",
        entry(DATE_KEY, quoted(F.col("analysis_date"))),
        *counts,
        entry(CRITERIA_KEY, quoted(F.lit(criteria))),
        f'"{QUESTIONS_KEY}": {{',
    ]

    def after(is_first: Column, line: Column) -> Column:
        """The first line of a list has no comma before it."""
        return F.concat(F.when(is_first, "").otherwise(","), line)

    asked = themes.questions
    number = F.coalesce(F.col("question_num"), F.lit(-1))
    first_asked = number == asked.agg(F.min(number)).scalar()
    name = F.coalesce(F.col("question_num").cast("string"), F.lit("null"))
    opening = F.concat(F.lit('"'), name, F.lit(f'": {{"{CLUSTERS_KEY}": {{"{CLUSTERS_KEY}": ['))

    # A cluster's object without its last brace, the list of its findings open.
    fields = F.to_json(F.struct("theme", "summary"), KEEP_NULLS)
    cluster = F.concat(F.substring(fields, F.lit(1), F.length(fields) - 1), F.lit(f',"{INDICES_KEY}":['))
    quotes = F.coalesce(F.to_json("key_quotes"), F.lit("null"))
    # The least finding of each theme has no comma before it.
    least = themes.members.groupBy("question_num", "item").agg(F.min("idx").alias("_least"))
    least = least.select(F.col("question_num").alias("_q"), F.col("item").alias("_i"), "_least")
    members = themes.members.join(least, F.col("question_num").eqNullSafe(F.col("_q")) & (F.col("item") == F.col("_i")))
    wanted = asked.select(F.col("question_num").alias("_q"))
    found = indexed.join(wanted, F.col("question_num").eqNullSafe(F.col("_q")), "left_semi")

    at_question = {"question_num": "question_num"}
    at_item = {**at_question, "item": "item"}
    last = themes.themes.withColumn("step", F.lit(2**31 - 1))
    return concat_tables(
        _lines(totals, head, 0),
        _lines(asked, [after(first_asked, opening)], 1, 0, **at_question),
        _lines(themes.themes, [after(F.col("item") == 0, cluster)], 1, 1, **at_item),
        _lines(members, [after(F.col("idx") == F.col("_least"), F.col("idx").cast("string"))], 1, 1, step="idx", **at_item),
        _lines(last, [F.concat(F.lit(f'],"{QUOTES_KEY}":'), quotes, F.lit("}"))], 1, 1, step="step", **at_item),
        _lines(asked, [f']}}, "{RAW_KEY}": ['], 1, 2, **at_question),
        _lines(found, [after(F.col("idx") == 0, F.col("raw"))], 1, 3, question_num="question_num", item="idx"),
        _lines(asked, ["]}"], 1, 4, **at_question),
        _lines(totals, ["}", "}"], 2),
    )
