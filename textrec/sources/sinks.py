"""Tables and reports written to files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    """Header, UTF-8; line breaks, quotes and outer white space of texts are kept."""
    df.write.options(
        header=True,
        encoding="UTF-8",
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_split(tagged: DataFrame, path: str) -> None:
    """Matched and other documents, each under its own folder. Sources stay where they are."""
    tagged.write.partitionBy("matched").parquet(path)


def write_lines(lines: DataFrame, order: Sequence[str], path: str) -> None:
    """Report lines as text, in order over the part files."""
    lines.orderBy(*order).select("line").write.text(path)
