"""Messages of evaluated samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrec.functions.columns import col_or
from textrec.operators.batching import number_rows
from textrec.operators.filters import require

# Messages of a sample that are one row where they are asked for in blocks.
BLOCK_TURNS = 1_000

# What a report shows where there is nothing.
NO_QUESTION = "No question found"
NO_RESPONSE = "No response found"
NO_TARGET = "No target found"
NO_SCORE = "No score found"


def group_messages(msgs: DataFrame) -> DataFrame:
    """``(sample_id, messages)``: the messages of a sample in turn order, one row for each sample.

    ``message_blocks`` are for samples too long for a row.
    """
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    return msgs.groupBy("sample_id").agg(listed.alias("messages"))


def join_messages(samples: DataFrame, grouped: DataFrame) -> DataFrame:
    """Samples with their messages; an empty list for a sample without any."""
    none = F.array().cast(grouped.schema["messages"].dataType)
    return samples.join(grouped, "sample_id", "left").withColumn("messages", F.coalesce("messages", none))


def message_blocks(msgs: DataFrame, n: int = BLOCK_TURNS) -> DataFrame:
    """``(sample_id, block, n_messages, messages)``: the messages of a sample in turn order, ``n`` in a row, blocks counted from 0.

    Messages are numbered within their sample after a sort by range, so neither a
    task nor a row grows with a sample. Messages with the same turn come by role and content.
    """
    numbered = number_rows(msgs.select("sample_id", "turn", "role", "content"), ["turn", "role", "content"], by=["sample_id"], name="_no")
    listed = F.array_sort(F.collect_list(F.struct("_no", "turn", "role", "content")))
    blocks = numbered.groupBy("sample_id", F.expr(f"(_no - 1) div {int(n)}").alias("block")).agg(listed.alias("listed"))
    plain = F.transform("listed", lambda m: F.struct(m["turn"].alias("turn"), m["role"].alias("role"), m["content"].alias("content")))
    return blocks.select("sample_id", "block", F.size("listed").alias("n_messages"), plain.alias("messages"))


def join_message_blocks(samples: DataFrame, blocks: DataFrame) -> DataFrame:
    """Samples with their messages, a row for each block; one with an empty list, as block 0, for a sample without any."""
    none = F.array().cast(blocks.schema["messages"].dataType)
    joined = samples.join(blocks, "sample_id", "left")
    filled = {"block": F.coalesce("block", F.lit(0).cast("long")), "n_messages": F.coalesce("n_messages", F.lit(0)), "messages": F.coalesce("messages", none)}
    return joined.withColumns(filled)


def first_turns(msgs: DataFrame) -> DataFrame:
    """``(sample_id, has_user, first_user, reply)`` in one aggregation.

    ``first_user`` is the first user message, null if that one is null;
    ``reply`` is the first assistant message that is neither null nor empty.
    """
    user = F.col("role") == "user"
    answer = (F.col("role") == "assistant") & (F.col("content") != "")
    return (
        msgs.where(user | answer)
        .groupBy("sample_id")
        .agg(
            F.bool_or(user).alias("has_user"),
            F.min(F.when(user, F.struct("turn", "content")))["content"].alias("first_user"),
            F.min(F.when(answer, F.struct("turn", "content")))["content"].alias("reply"),
        )
    )


def question(samples: DataFrame, msgs: DataFrame) -> DataFrame:
    """``(sample_id, question)``: first user message, or the sample's own input."""
    joined = samples.join(first_turns(msgs), "sample_id", "left")
    own = col_or(samples, "input", NO_QUESTION)
    return joined.select("sample_id", F.when(F.col("has_user"), F.col("first_user")).otherwise(own).alias("question"))


def first_reply(samples: DataFrame, msgs: DataFrame) -> DataFrame:
    """``(sample_id, response)`` with a constant where no reply exists."""
    joined = samples.join(first_turns(msgs), "sample_id", "left")
    return joined.select("sample_id", F.coalesce("reply", F.lit(NO_RESPONSE)).alias("response"))


def system_prompt(msgs: DataFrame) -> DataFrame:
    """Content of the first system message overall; no row when there is none."""
    return msgs.where(F.col("role") == "system").orderBy("sample_id", "turn").limit(1).select("content")


def transcript_rows(samples: DataFrame, msgs: DataFrame, score: str = "score") -> DataFrame:
    """Question, target, response and score of every sample that has an input."""
    valid = require(samples, "input")
    shown = valid.join(first_turns(msgs), "sample_id", "left")
    return shown.select(
        "sample_id",
        F.when(F.col("has_user"), F.col("first_user")).otherwise(col_or(samples, "input", NO_QUESTION)).alias("question"),
        col_or(samples, "target", NO_TARGET).alias("target"),
        F.coalesce("reply", F.lit(NO_RESPONSE)).alias("response"),
        col_or(samples, score, NO_SCORE).alias("score"),
    )
