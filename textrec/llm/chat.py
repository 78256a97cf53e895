"""Conversations logged again with every turn, collapsed to the longest and rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textrec.operators.batching import number_rows
from textrec.session import stored

# Turns of a conversation whose hashes are added up in one window.
BLOCK_TURNS = 4_096

# Marks around a turn.
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"
NO_ROLE = "unknown"


def _hash(*values: Column) -> Column:
    """XXH64 that tells null from empty and knows which value is null; the first value is a salt."""
    return F.xxhash64(*[x for v in values for x in (v.isNull(), v)])


def numbered_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv, turn, role, text, at)``: every turn at its place from 1 in its conversation, by turn number, role and text, nulls first.

    Turns are sorted by range and numbered from counts, so a conversation that
    has very many, or the rows without an id, are spread over many tasks.
    """
    named = turns.select(*[F.col(c).alias(n) for c, n in ((conv, "conv"), (turn, "turn"), (role, "role"), (text, "text"))])
    return number_rows(named, ["turn", "role", "text"], by=["conv"], name="at")


def prefix_hashes(placed: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """``(conv, at, h1, h2, last)``: the rolling hash of each conversation's first ``at`` turns, from ``numbered_turns``.

    Each turn's hash covers its place, role and text, and the hashes of a prefix
    are added up with exclusive or, two of 64 bits each. As that is associative,
    turns are added up within blocks of ``block`` turns, and then the blocks.
    """
    hashed = placed.select("conv", "at", F.expr(f"(at - 1) div {int(block)}").alias("block"), *[_hash(F.lit(salt), F.col("at"), F.col("role"), F.col("text")).alias(f"t{salt}") for salt in (1, 2)])
    blocks = hashed.groupBy("conv", "block").agg(F.bit_xor("t1").alias("b1"), F.bit_xor("t2").alias("b2"), F.max("at").alias("end"))
    whole = Window.partitionBy("conv").orderBy("block")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    earlier = blocks.select(
        F.col("conv").alias("of"), F.col("block").alias("in"), F.when(F.lead("block").over(whole).isNull(), F.col("end")).alias("end"),
        *[F.coalesce(F.bit_xor(b).over(before), zero).alias(b) for b in ("b1", "b2")],
    )
    upto = Window.partitionBy("conv", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = hashed.select("conv", "at", "block", *[F.bit_xor(t).over(upto).alias(t) for t in ("t1", "t2")])
    both = within.join(earlier, F.col("conv").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in")))
    hashes = [F.col(f"t{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"h{i}") for i in (1, 2)]
    return both.select("conv", "at", *hashes, F.coalesce(F.col("at") == F.col("end"), F.lit(False)).alias("last"))


def maximal_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv, n_turns, copies)`` of the conversations that are no other one's beginning.

    Of conversations with the same turns the smallest id stays and ``copies``
    counts them all. Only hashes are compared, over two joins by 128-bit hash
    and length; hashes shared by many conversations are made one before they
    meet. Turns with a null conversation id count as one conversation.
    """
    return _maximal(numbered_turns(turns, conv, turn, role, text)).withColumnRenamed("conv", conv)


def _maximal(placed: DataFrame) -> DataFrame:
    rolled = stored(prefix_hashes(placed), "prefixes")
    key = ["at", "h1", "h2"]
    whole = rolled.where("last").groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    begun = rolled.where("NOT last").select(*key).distinct()
    kept = whole.join(begun, key, "left_anti")
    return kept.select("conv", F.col("at").cast("int").alias("n_turns"), "copies")


def rendered_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv, n_turns, copies, at, rendered)``: the turns of every maximal conversation, rendered, a row each.

    The long form of ``render_conversations``, for conversations of any length;
    put together by ``at`` they are its texts.
    """
    placed = numbered_turns(turns, conv, turn, role, text)
    kept = _maximal(placed).withColumnRenamed("conv", "kept")
    before, after = OPEN.split("{role}")
    body = F.concat(F.lit(before), F.coalesce("role", F.lit(NO_ROLE)), F.lit(after), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    theirs = placed.join(kept, F.col("conv").eqNullSafe(F.col("kept")))
    return theirs.select(F.col("conv").alias(conv), "n_turns", "copies", "at", body.alias("rendered"))


def render_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv, n_turns, copies, rendered)``: the text of every maximal conversation.

    A turn is ``<|role|>``, a line break, its text, ``<|end|>`` and a line
    break. A null role reads ``unknown``, a null text is empty. Repeated turn
    numbers are all rendered, ordered by role and text. Other columns of
    ``turns`` are not looked at. No turns: no rows. Built-in functions only;
    the rows of one conversation meet only where its text is put together.
    """
    each = rendered_turns(turns, conv, turn, role, text)
    listed = F.sort_array(F.collect_list(F.struct("at", "rendered")))
    texts = each.groupBy(conv, "n_turns", "copies").agg(listed.alias("turns"))
    return texts.select(conv, "n_turns", "copies", F.array_join("turns.rendered", "").alias("rendered"))
