"""Replies kept under what was asked, so that a run started again asks only for what is new."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrec.session import shared_folder

# A kept reply: what was asked, as a digest, the answer, and when it came.
KEPT = "digest string, reply string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, error string, asked_at timestamp"


def prompt_digest(prompt: Column, model: str, inline: bool, system: str | None, max_tokens: int, temperature: float) -> Column:
    """Digest of all that makes a reply: the model's name, the system prompt and where it goes, the settings and the prompt.

    Null for a null prompt.
    """
    setting = json.dumps([model, inline, system, max_tokens, float(temperature)])
    return F.sha2(F.concat(F.lit(setting + "\n"), prompt).cast("binary"), 256)


def _path(spark: SparkSession, run: str) -> str:
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError("a run's name has letters, digits, '.', '_' and '-' only")
    return f"{shared_folder(spark)}/textrec/replies-of-{run}"


def keep_replies(replies: DataFrame, run: str) -> None:
    """Adds ``replies`` to those of a run; files that are there already stay as they are."""
    rows = replies.withColumn("asked_at", F.current_timestamp())
    fields = [f.split()[0] for f in KEPT.split(", ")]
    rows.select(*fields).write.mode("append").parquet(_path(replies.sparkSession, run))


def kept_replies(spark: SparkSession, run: str) -> DataFrame:
    """One row for each digest that the run asked for: a good reply rather than a failed one, the first of several."""
    path = _path(spark, run)
    # So that the folder is there to be read, with or without replies.
    spark.createDataFrame([], KEPT).write.mode("append").parquet(path)
    every = spark.read.schema(KEPT).parquet(path)
    rest = F.struct(*[c for c in every.columns if c != "digest"])
    best = F.min_by(rest, F.struct(F.col("error").isNotNull(), "asked_at", "reply"))
    return every.groupBy("digest").agg(best.alias("best")).select("digest", "best.*")
