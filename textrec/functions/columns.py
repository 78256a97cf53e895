"""Column helpers: defaults, clean-up of names and texts, fixed lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as white space when a text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Character caps.
MAX_TEXT_CHARS = 750_000
LEAD_CHARS = 150


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(as_column(col), F.lit(WHITESPACE))


def col_or(df: DataFrame, name: str, default) -> Column:
    """The column if the table has it, else a constant. A null in the column stays null."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(default)


def has_path(schema: T.DataType, path: Sequence[str]) -> bool:
    for name in path:
        if not isinstance(schema, T.StructType) or name not in schema.fieldNames():
            return False
        schema = schema[name].dataType
    return True


def nested_or(df: DataFrame, path: str, default) -> Column:
    """A nested field, or a constant where the field is absent or null.

    JSON sources hold "absent" and "null" as the same value, so both get the default.
    """
    if not has_path(df.schema, path.split(".")):
        return F.lit(default)
    return F.coalesce(F.col(path), F.lit(default))


def ensure_columns(df: DataFrame, keep: Mapping[str, str], reset: Mapping[str, str]) -> DataFrame:
    """Add the ``keep`` columns where missing and set the ``reset`` columns to null.

    Both map a column name to its type.
    """
    added = {n: t for n, t in keep.items() if n not in df.columns} | dict(reset)
    return df.withColumns({n: F.lit(None).cast(t) for n, t in added.items()}) if added else df


def title_from_path(col: Column | str, suffix: str = ".pdf") -> Column:
    """Readable title: base name without the suffix, underscores as spaces."""
    base = F.element_at(F.split(as_column(col), "/"), -1)
    return strip(F.replace(F.replace(base, F.lit(suffix), F.lit("")), F.lit("_"), F.lit(" ")))


def clean_name(col: Column | str, mark: str = "*") -> Column:
    return strip(F.replace(as_column(col), F.lit(mark), F.lit("")))


def cap_chars(col: Column | str, n: int = MAX_TEXT_CHARS) -> Column:
    """At most the first ``n`` characters (code points)."""
    return F.left(as_column(col), F.lit(n))


def lead_sentence(col: Column | str, n: int = LEAD_CHARS) -> Column:
    """First sentence; without one, the first ``n`` characters and an ellipsis.

    Anchored at the start, so a long text without a sentence end is read once
    and not from each of its positions.
    """
    text = as_column(col)
    first = F.regexp_extract(text, r"^[.!?]*+([^.!?]++[.!?])", 1)
    short = F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)
    return F.coalesce(F.nullif(first, F.lit("")), short)


def category_rank(col: Column | str, categories: Sequence[str]) -> Column:
    """Position (from 1) in a fixed order; null for a value outside it."""
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), as_column(col))
    return F.when(place > 0, place.cast("int"))


def lookup(col: Column | str, mapping: Mapping) -> Column:
    """Constant lookup; null for a key without an entry."""
    pairs = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.element_at(F.create_map(*pairs), as_column(col))
