"""Row filters and document screening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrec.functions.columns import strip
from textrec.functions.keywords import any_keyword
from textrec.operators.texts import full_text


def by_role(df: DataFrame, role: str) -> DataFrame:
    return df.where(F.col("role") == role)


def require(df: DataFrame, col: str) -> DataFrame:
    """Rows whose column is not null; none at all when the table lacks the column."""
    return df.where(F.col(col).isNotNull() if col in df.columns else F.lit(False))


def non_blank(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.length(strip(col)) > 0)


def filter_or_all(df: DataFrame, col: str, value: str, all_label: str = "All") -> DataFrame:
    """Rows with the value, or the whole table when the value is ``all_label`` or occurs nowhere.

    Whether it occurs is looked up at once, by a query that stops at the first
    row; the result then is the table or a plain filter, which reaches the scan.
    """
    hit = df.where(F.col(col) == value)
    return df if value == all_label or hit.isEmpty() else hit


def excerpt(df: DataFrame, cols: Sequence[str], n: int, order: Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows of chosen columns."""
    return df.orderBy(*order).limit(n).select(*cols)


def docs_with_any(pages: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """``(doc, matched)``: does any page that could be read contain any keyword."""
    hits = pages.select("doc", any_keyword("text", keywords).alias("hit"))
    return hits.groupBy("doc").agg(F.bool_or("hit").alias("matched"))


def docs_with_all(pages: DataFrame, terms: Sequence[str]) -> DataFrame:
    """``(doc, matched)``: does every term occur somewhere in the document.

    Pages are tested one by one, so a document is never put together, unless a
    term holds a line break and could lie across a page end.
    """
    if any("\n" in t for t in terms):
        whole = full_text(pages)
        tests = [any_keyword("text", [t]) for t in terms]
        return whole.select("doc", F.forall(F.array(*tests), lambda t: t).alias("matched"))
    found = pages.select("doc", *[any_keyword("text", [t]).alias(f"t{i}") for i, t in enumerate(terms)])
    seen = found.groupBy("doc").agg(*[F.bool_or(f"t{i}").alias(f"t{i}") for i in range(len(terms))])
    every = F.lit(True)
    for i in range(len(terms)):
        every = every & F.col(f"t{i}")
    return seen.select("doc", every.alias("matched"))


def tag_matches(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """Every listed document with its flag; a document without pages does not match."""
    return docs.join(flags, "doc", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
