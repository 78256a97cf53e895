"""Placement of rows on shards by a lookup table that the shards fill in turns."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Slots of the table: a prime, and far more than shards.
SLOTS = 65_537
HEX_DIGITS = 15


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HEX_DIGITS], 16)


@lru_cache
def slot_table(shards: tuple[str, ...], slots: int = SLOTS) -> tuple[int, ...]:
    """The number of the shard that owns each slot.

    Every shard has an order of preference over all slots: an offset and a step
    taken from its name, which visit each slot once as the number of slots is
    prime. The shards take turns, each claiming the first free slot of its order,
    until none is free: shares differ by one slot at most, and a shard that
    leaves or joins moves few slots but its own.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime not below the number of shards")
    at = [_digest(f"offset {s}") % slots for s in shards]
    step = [_digest(f"step {s}") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for shard in range(min(len(shards), free) if free < len(shards) else len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            owner[at[shard]] = shard
            free -= 1
    return tuple(owner)


def slot_of(keys: Sequence[str | Column], slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of the MD5 value of its columns as text. Null differs from every text."""
    texts = [F.coalesce(F.concat(F.lit("="), (F.col(k) if isinstance(k, str) else k).cast("string")), F.lit("")) for k in keys]
    digits = F.substring(F.md5(F.concat_ws("\x1f", *texts).cast("binary")), 1, HEX_DIGITS)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str], slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard of each row.

    The table is broadcast: it has ``slots`` rows whatever the input, and a
    lookup takes constant time. No row moves. Rows with equal keys share a
    shard; null keys are a key like any other. A column of ``df`` named as
    ``slot`` or ``shard`` is an error: give other names. An empty table stays empty.
    """
    clash = {slot, shard} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    own = f"_{uuid.uuid4().hex}"  # no column of the table
    owner = pd.DataFrame({own: range(slots), shard: [shards[i] for i in slot_table(tuple(shards), slots)]})
    table = df.sparkSession.createDataFrame(owner, f"{own} int, `{shard}` string")
    return df.withColumn(slot, slot_of(keys, slots)).join(F.broadcast(table), F.col(slot) == F.col(own)).drop(own)


def write_shards(placed: DataFrame, path: str, shard: str = "shard") -> None:
    """Rows written to a folder per shard. AQE joins small shards into tasks and splits large ones."""
    placed.hint("rebalance", shard).write.partitionBy(shard).parquet(path)
