"""Whole-table operators: unions, fallbacks, counts, schema reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrec.functions.columns import as_column


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """``primary``, or ``fallback`` when ``primary`` has no rows; one plan, no count."""
    return primary.unionByName(fallback.where(~primary.select(F.lit(1)).exists()))


def concat_tables(*dfs: DataFrame) -> DataFrame:
    """All rows of all tables, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def records_table(dfs: list[DataFrame], fill: str | None = None) -> DataFrame:
    """Tables with different columns as one; a column a table lacks gets ``fill`` if it is text."""
    types: dict[str, T.DataType] = {}
    for df in dfs:
        for field in df.schema.fields:
            types.setdefault(field.name, field.dataType)

    def widened(df: DataFrame) -> DataFrame:
        return df.select(
            *[
                F.col(f"`{n}`")
                if n in df.columns
                else F.lit(fill if isinstance(t, T.StringType) else None).cast(t).alias(n)
                for n, t in types.items()
            ]
        )

    return concat_tables(*[widened(df) for df in dfs])


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table, rows)``."""
    return concat_tables(
        *[df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    )


def schema_report(df: DataFrame) -> DataFrame:
    """``(position, column, type, rows, non_null)`` in one pass over the table."""
    fields = df.schema.fields
    counts = df.agg(F.count("*").alias("rows"), *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)])
    lines = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col("rows"),
                F.col(f"c{i}").alias("non_null"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return counts.select(F.inline(lines))


def json_keys(col: Column | str) -> Column:
    """Top-level keys of a JSON object."""
    return F.json_object_keys(as_column(col))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def first_or_default(df: DataFrame, col: str, order: str, default: str) -> DataFrame:
    """One row: the first value in ``order``, else the default."""
    return df.agg(F.coalesce(F.min_by(col, order), F.lit(default)).alias(col))


def first_n(df: DataFrame, predicate: Column, n: int, order: list[str | Column]) -> DataFrame:
    """First ``n`` of the rows that pass; the limit counts passing rows only."""
    return df.where(predicate).orderBy(*order).limit(n)


def first_nonempty(df: DataFrame, path: str = "file_path", results: str = "results") -> DataFrame:
    """The row of the first file whose results are not empty; files have one row each.

    One pass: every task keeps its first such row.
    """
    filled = F.when(F.size(results) > 0, F.col(path))
    first = df.agg(F.min_by(F.struct(*df.columns), filled).alias("first"))
    return first.where(F.col("first").isNotNull()).select("first.*")
