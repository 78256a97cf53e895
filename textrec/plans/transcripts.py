"""Transcript report of the first samples of an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textrec.operators.filters import require
from textrec.operators.transcripts import transcript_rows
from textrec.session import stored
from textrec.sources.logs import direct_results

# Samples shown in a report.
SHOWN = 3


def transcript_report(samples: DataFrame, msgs: DataFrame, n: int = SHOWN, score: str = "score") -> DataFrame:
    """The first ``n`` samples that have an input, numbered from 1.

    The samples are chosen, numbered and written before any message is read, so
    Spark knows their size when it joins the messages. Only the messages of ``n``
    samples are aggregated, and only those ``n`` rows are numbered in one task.
    """
    chosen = require(samples, "input").orderBy("sample_id").limit(n)
    first = stored(chosen.withColumn("sample_no", F.row_number().over(Window.orderBy("sample_id"))), "shown")
    theirs = msgs.join(first.select("sample_id"), "sample_id", "left_semi")
    return transcript_rows(first, theirs, score).join(first.select("sample_id", "sample_no"), "sample_id")


def transcript_or_logs(samples: DataFrame, msgs: DataFrame, logs: DataFrame, n: int = SHOWN) -> DataFrame:
    """The transcript report, or the first results of the raw logs when it shows no sample.

    The report has at most ``n`` rows and is written, so the logs are read only if needed.
    """
    shown = ["question", "target", "response", "score"]
    report = stored(transcript_report(samples, msgs, n).select("sample_no", *shown), "report")
    if not report.isEmpty():
        return report
    return direct_results(logs, n).select(F.col("result_no").alias("sample_no"), *shown)
