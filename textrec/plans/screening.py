"""From screened paragraphs to findings and themes."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrec.functions.replies import reply_findings
from textrec.operators.batching import assign_batches
from textrec.operators.filters import docs_with_all, tag_matches
from textrec.operators.findings import question_list, report_totals
from textrec.operators.inference import Backend, ask_model
from textrec.operators.texts import (
    MIN_PARAGRAPH_CHARS,
    context_blocks,
    explode_findings,
    relevant_paragraphs,
    render_prompt,
)
from textrec.plans.themes import Themes, cluster_findings, indexed_findings
from textrec.session import stored

# Paragraphs per prompt and reply lengths.
PARAGRAPHS_PER_PROMPT = 10
ANALYSIS_TOKENS = 4000

# The caller may pass a template of its own with the same names in braces.
ANALYSIS_TEMPLATE = (
    "Read the paragraphs below and answer these questions:\n{questions}\n\n"
    "For every passage that answers one, give its exact words, its source and page, "
    "the number of the question and a short summary.\n\nParagraphs:\n{context}\n\n"
    'Reply with JSON only: {{"findings": [{{"question_num": 0, "quote": "", "source": "", '
    '"page": 0, "summary": ""}}]}}'
)


def question_json(questions: Mapping[int, str] | DataFrame) -> Column:
    """The questions as JSON for a prompt, from a mapping or a table ``(question_num, question)``."""
    if isinstance(questions, DataFrame):
        return question_list(questions).scalar()
    return F.lit(json.dumps(dict(sorted(questions.items())), indent=2, ensure_ascii=False))


def context_table(paras: DataFrame, n: int = PARAGRAPHS_PER_PROMPT) -> DataFrame:
    """``(batch, paragraphs, context)`` of consecutive batches of ``n`` paragraphs.

    The paragraphs are few compared with the pages they were found in, so they
    are written before they are sorted: sorting reads its input twice.
    """
    found = stored(paras, "paragraphs")
    return context_blocks(assign_batches(found, ["source", "page", "para"], n))


def ask_batches(
    paras: DataFrame,
    questions: Mapping[int, str] | DataFrame,
    backend: Backend,
    n: int = PARAGRAPHS_PER_PROMPT,
    template: str = ANALYSIS_TEMPLATE,
    **options,
) -> DataFrame:
    """``(batch, reply, token counts, error)``: the model's reply to each batch of paragraphs, asked once."""
    prompts = render_prompt(context_table(paras, n), template, questions=question_json(questions), context=F.col("context"))
    return ask_model(prompts, "batch", backend, **{"max_tokens": ANALYSIS_TOKENS, "temperature": 0.0, **options})


def reply_rows(replies: DataFrame) -> DataFrame:
    """``(batch, pos, question_num, quote, source, page, summary, raw)`` from the replies to batches."""
    return explode_findings(replies.select("batch", reply_findings("reply").alias("findings")))


def analyse_batches(paras: DataFrame, questions: Mapping[int, str] | DataFrame, backend: Backend, **options) -> DataFrame:
    """``(batch, pos, question_num, quote, source, page, summary, raw)`` found in batches of paragraphs."""
    return reply_rows(ask_batches(paras, questions, backend, **options))


@dataclass(frozen=True)
class Screening:
    """Tables of one run: tagged documents, findings with their place ``idx`` in their question, themes, totals, failed calls."""

    documents: DataFrame
    findings: DataFrame
    themes: Themes
    totals: DataFrame
    errors: DataFrame


def screen_documents(
    docs: DataFrame,
    pages: DataFrame,
    terms: Sequence[str],
    keywords: Sequence[str],
    questions: Mapping[int, str] | DataFrame,
    finder: Backend,
    clusterer: Backend,
    sep: str = "\n\n",
    min_len: int = MIN_PARAGRAPH_CHARS,
    finder_options: Mapping | None = None,
    clusterer_options: Mapping | None = None,
) -> Screening:
    """Documents that hold all ``terms``, what their paragraphs say on the questions, and its themes.

    ``finder_options`` are those of ``ask_batches``, ``clusterer_options`` those
    of ``cluster_findings``: system prompt, templates, call sizes, partitions, the
    name of a run that keeps replies, and so on. ``errors`` has ``(step, key,
    error)`` of every failed call; the key of a theme's call is the question, the
    round and the part. ``pages`` is read twice. Pages extracted from files
    should be written to a table first, as extraction would be repeated.
    """
    flags = docs_with_all(pages, terms)
    documents = tag_matches(docs, flags)
    paras = relevant_paragraphs(pages, flags, keywords, sep, min_len)
    found = ask_batches(paras, questions, finder, **(finder_options or {}))
    findings = indexed_findings(reply_rows(found))
    themes = cluster_findings(findings, clusterer, **(clusterer_options or {}))

    def failed(replies: DataFrame, step: str, *key: str) -> DataFrame:
        rows = replies.where(F.col("error").isNotNull())
        named = F.array_join(F.array(*[F.col(k).cast("string") for k in key]), "/", "none")
        return rows.select(F.lit(step).alias("step"), named.alias("key"), "error")

    errors = failed(found, "findings", "batch").union(failed(themes.errors, "themes", "question_num", "round", "part"))
    return Screening(documents, findings, themes, report_totals(documents, findings), errors)
