"""Evaluation logs and sample datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrec.functions.columns import nested_or
from textrec.functions.replies import one_document
from textrec.operators.tables import first_nonempty
from textrec.operators.texts import explode_results

# What a missing field of a result shows.
MISSING = "N/A"

SAMPLES = "sample_id string, input string, target string, score string"
MESSAGES = "sample_id string, turn bigint, role string, content string"
EVALS = "eval_id string, task string, model string, created string"
RESULTS = (
    "array<struct<sample:struct<input:string,target:string,question:string>,response:string,score:string>>"
)
LOG_TABLES = {"evals": EVALS, "samples": SAMPLES, "messages": MESSAGES}


def load_tables(spark: SparkSession, folder: str, form: str = "json", schemas: dict | None = None) -> dict[str, DataFrame]:
    """Evaluations, samples and messages from the sub-folders of a log folder."""
    wanted = schemas or LOG_TABLES
    return {name: spark.read.schema(schema).format(form).load(f"{folder}/{name}") for name, schema in wanted.items()}


def scan_result_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file_path, results, error)``: one JSON document per file.

    A file that is not JSON gives a row without results and with its text as the error.
    """
    schema = T.StructType.fromDDL(f"results {RESULTS}, _corrupt_record string")
    logs = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(paths)
    return logs.select(
        F.col("_metadata.file_path").alias("file_path"), "results", F.col("_corrupt_record").alias("error")
    )


def parse_result_logs(decoded: DataFrame) -> DataFrame:
    """``(file_path, results)`` from texts decoded by ``decode_text``; no results if not JSON."""
    document = one_document(F.col("text"), f"struct<results:{RESULTS}>")
    return decoded.select(F.col("path").alias("file_path"), document["results"].alias("results"))


def direct_results(logs: DataFrame, n: int = 3) -> DataFrame:
    """First results of the first log that has any, for samples without messages."""
    first = explode_results(first_nonempty(logs), n)
    return first.select(
        "file_path",
        "result_no",
        nested_or(first, "result.sample.input", MISSING).alias("question"),
        nested_or(first, "result.sample.target", MISSING).alias("target"),
        nested_or(first, "result.response", MISSING).alias("response"),
        nested_or(first, "result.score", MISSING).alias("score"),
    )


def load_samples(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Sample records from JSON lines; without a schema every attribute becomes a column."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)
