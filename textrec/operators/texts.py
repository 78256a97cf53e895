"""Page texts: whole documents, paragraphs, context blocks and prompts."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textrec.functions.columns import cap_chars, strip
from textrec.functions.keywords import keyword_filter
from textrec.operators.batching import SLOT_BITS
from textrec.session import stored

# A paragraph must be longer than this after stripping.
MIN_PARAGRAPH_CHARS = 50

# How a paragraph and its source are shown to a model, and what lies between two.
CONTEXT_FORMAT = "[Source: %s, Page %d]\n%s"
CONTEXT_GAP = "\n\n"

# Characters of a text that are one row where texts are asked for in segments.
SEGMENT_CHARS = 100_000


def _joined(order: str, text: str, end: str = "") -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(rows, lambda r: F.concat(r[text], F.lit(end))), "")


def full_text(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """``(doc, text)``: the page texts in page order, each followed by a line break.

    A null page number comes first. With ``cap`` only the pages that begin within
    the first ``cap`` characters are put together. A group is a document, whose
    text is one row; ``text_segments`` gives texts of any length.
    """
    read = pages.where(F.col("text").isNotNull()).select("doc", "page", "text")
    if cap is not None:
        order = Window.partitionBy("doc").orderBy("page", "text").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0))
        read = read.withColumn("start", start).where(F.col("start") < cap)
    whole = read.groupBy("doc").agg(_joined("page", "text", "\n").alias("text"))
    return whole if cap is None else whole.withColumn("text", cap_chars("text", cap))


def page_offsets(pages: DataFrame) -> DataFrame:
    """``(doc, page, text, start)``: pages with text, and where each begins in its document's whole text, from 0.

    A page counts with its line break. Sums are taken in two levels: over the
    pages that lie together after a sort by range, and over one number for each
    document and range. So a document that holds most pages is spread over as
    many tasks as its pages fill. A null page number comes first, as in
    ``full_text``. The sorted pages are written once.
    """
    keys = ["doc", "page", "text"]
    read = pages.where(F.col("text").isNotNull()).select(*keys)
    placed = read.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(placed, "pages").withColumn("_slot", F.shiftright("_at", SLOT_BITS))
    size = F.length("text").cast("long") + 1
    sums = rows.groupBy("_slot", "doc").agg(F.sum(size).alias("_size"))
    before = Window.partitionBy("doc").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select(F.col("_slot").alias("_in"), F.col("doc").alias("_of"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("_slot", "doc").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    begun = rows.withColumn("_own", F.coalesce(F.sum(size).over(within), F.lit(0)))
    both = begun.join(earlier, (F.col("_slot") == F.col("_in")) & F.col("doc").eqNullSafe(F.col("_of")))
    return both.select(*keys, (F.col("_from") + F.col("_own")).alias("start"))


def text_segments(pages: DataFrame, chars: int = SEGMENT_CHARS) -> DataFrame:
    """``(doc, segment, start, text)``: the whole texts of ``full_text`` in segments of ``chars`` characters, the last shorter.

    For documents of any length: no row holds more than a segment, and pages are
    cut where a segment ends. Segments count from 0.
    """
    whole = page_offsets(pages).withColumn("text", F.concat("text", F.lit("\n")))
    last = F.expr(f"(start + length(text) - 1) div {int(chars)}")
    each = whole.select("doc", "start", "text", F.explode(F.sequence(F.expr(f"start div {int(chars)}"), last)).alias("segment"))
    begin = F.col("segment") * chars - F.col("start")
    skip = F.greatest(begin, F.lit(0)).cast("int")
    piece = F.substring("text", skip + 1, (begin + chars).cast("int") - skip)
    pieces = each.select("doc", "segment", (F.col("start") + skip).alias("at"), piece.alias("piece"))
    listed = F.array_sort(F.collect_list(F.struct("at", "piece")))
    joined = F.array_join(F.transform(listed, lambda r: r["piece"]), "")
    made = pieces.groupBy("doc", "segment").agg(joined.alias("text"))
    return made.select("doc", "segment", (F.col("segment") * chars).alias("start"), "text")


def paragraphs(pages: DataFrame, sep: str = "\n\n", min_len: int = MIN_PARAGRAPH_CHARS) -> DataFrame:
    """``(source, page, para, text)``: stripped pieces of a page longer than ``min_len``.

    ``para`` is the position of the piece on its page. Narrow: no shuffle.
    """
    # The outer form keeps Spark from splitting each text a second time to look for empty lists.
    pieces = F.transform(F.split("text", _literal(sep)), strip)
    placed = pages.select(F.col("doc").alias("source"), "page", F.posexplode_outer(pieces).alias("para", "text"))
    return placed.where(F.length("text") > min_len)


def _literal(sep: str) -> str:
    """Pattern for the text itself; plain characters stay plain, as they are split faster."""
    return "".join(f"\\{c}" if c in r"\^$.|?*+()[]{}" else c for c in sep)


def keep_passing(rows: DataFrame, flags: DataFrame, key: str = "source") -> DataFrame:
    """Rows of the documents flagged as matched."""
    passing = flags.where("matched").select(F.col("doc").alias(key))
    return rows.join(passing, key, "left_semi")


def relevant_paragraphs(
    pages: DataFrame,
    flags: DataFrame,
    keywords: Sequence[str],
    sep: str = "\n\n",
    min_len: int = MIN_PARAGRAPH_CHARS,
) -> DataFrame:
    """Paragraphs of passing documents that contain a keyword.

    The paragraph filters are narrow and cut the rows before they are joined to
    the passing documents.
    """
    found = paragraphs(pages, sep, min_len).where(keyword_filter("text", keywords))
    return keep_passing(found, flags)


def context_blocks(paras: DataFrame) -> DataFrame:
    """``(batch, paragraphs, context)``: the paragraphs of a batch, each under its source line.

    A group is one batch, so its size is the batch size.
    """
    rows = F.array_sort(F.collect_list(F.struct("source", "page", "para", "text")))
    block = F.transform("rows", lambda r: F.format_string(CONTEXT_FORMAT, r["source"], r["page"], r["text"]))
    return (
        paras.groupBy("batch")
        .agg(rows.alias("rows"))
        .select("batch", F.size("rows").alias("paragraphs"), F.array_join(block, CONTEXT_GAP).alias("context"))
    )


def rendered(template: str, **values: Column | str) -> Column:
    """A ``{name}`` template filled with columns; ``{{`` and ``}}`` are literal braces."""
    parts: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            value = values[name]
            column = value if isinstance(value, Column) else F.lit(value)
            parts.append(F.coalesce(column.cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


def render_prompt(df: DataFrame, template: str, name: str = "prompt", **values: Column | str) -> DataFrame:
    return df.withColumn(name, rendered(template, **values))


def explode_findings(df: DataFrame, findings: str = "findings") -> DataFrame:
    """``(batch, pos, …, raw)``: one row per finding of a batch, with the JSON it was read from."""
    # The outer form keeps Spark from parsing each reply a second time to look for empty lists.
    each = df.select("batch", F.posexplode_outer(findings).alias("pos", "finding")).where(F.col("pos").isNotNull())
    return each.select("batch", "pos", "finding.f.*", "finding.raw")


def explode_results(df: DataFrame, n: int | None = 3) -> DataFrame:
    """First ``n`` results of each log, numbered from 1."""
    results = F.col("results") if n is None else F.slice("results", 1, n)
    others = [c for c in df.columns if c != "results"]
    each = df.select(*others, F.posexplode_outer(results).alias("pos", "result")).where(F.col("pos").isNotNull())
    return each.select(*others, (F.col("pos") + 1).alias("result_no"), "result")
