"""Summaries of whole documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrec.functions.columns import MAX_TEXT_CHARS, title_from_path
from textrec.operators.filters import non_blank
from textrec.operators.inference import Backend, complete_prompts
from textrec.operators.texts import full_text
from textrec.session import stored
from textrec.sources.page_files import Extractor, read_pages
from textrec.sources.sinks import write_csv

# Reply length and temperature of a summary.
SUMMARY_TOKENS = 700
SUMMARY_TEMPERATURE = 0.5


def evidence_table(pages: DataFrame, cap: int = MAX_TEXT_CHARS) -> DataFrame:
    """``(pdf_filename, pdf_title, full_text)`` of the documents that have text.

    Empty pages are left out. A document that could not be read to its end, or
    holds white space only, is dropped.
    """
    failed = pages.where(F.col("error").isNotNull()).select("doc").distinct()
    # Joined after the texts are grouped by document, so that they move only once.
    texts = full_text(pages.where(F.col("text") != ""), cap).join(failed, "doc", "left_anti")
    return non_blank(texts, "text").select(
        F.col("doc").alias("pdf_filename"), title_from_path("doc").alias("pdf_title"), F.col("text").alias("full_text")
    )


def summarise_documents(
    pages: DataFrame,
    backend: str,
    backends: Mapping[str, Backend],
    system: str,
    result_col: str = "summary",
    cap: int = MAX_TEXT_CHARS,
    **options,
) -> DataFrame:
    """Evidence table with a summary and token counts per document."""
    return complete_prompts(
        evidence_table(pages, cap),
        backend,
        backends,
        prompt_col="full_text",
        result_col=result_col,
        system=system,
        max_tokens=SUMMARY_TOKENS,
        temperature=SUMMARY_TEMPERATURE,
        **options,
    )


def summarise_folder(
    spark: SparkSession,
    folder: str,
    glob: str,
    extractor: Extractor,
    path: str,
    backend: str,
    backends: Mapping[str, Backend],
    system: str,
    first: int | None = None,
    **options,
) -> DataFrame:
    """Summaries of the files below ``folder`` that match ``glob``, or the ``first`` of them, written to ``path`` as CSV and returned.

    Pages are extracted once. ``options`` are those of ``summarise_documents``,
    among them the name of a ``run`` that keeps replies. Files that could not be
    read to their end, or hold no text, have no row; no file gives a table without rows.
    """
    pages = stored(read_pages(spark, folder, glob, extractor, first=first), "pages")
    summaries = summarise_documents(pages, backend, backends, system, **options)
    write_csv(summaries, path)
    return summaries
