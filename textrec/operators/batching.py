"""Row numbers and fixed-size batches over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textrec.session import stored

# `monotonically_increasing_id` keeps the partition above and the row below this bit.
SLOT_BITS = 33


def number_rows(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "row_no") -> DataFrame:
    """Number rows from 1 in ``order``, within each ``by`` group if given.

    ``by`` and ``order`` together must be unique. Rows are range-partitioned and
    sorted, so no task holds more than its share even if one group holds most
    rows. The only single-partition step adds up one count per partition. The
    sorted rows are written once, because their positions must not change
    between the count and the numbering.
    """
    keys = [*by, *order]
    placed = (
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    )
    rows = stored(placed, "numbered").withColumn("_slot", F.shiftright("_at", SLOT_BITS))
    counts = rows.groupBy("_slot").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_slot", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    # One row per partition, so the broadcast is bounded by the partition count.
    numbered = rows.join(F.broadcast(starts), "_slot").withColumn(
        name, F.col("_start") + F.col("_at") - F.shiftleft("_slot", SLOT_BITS) + 1
    )
    if not by:
        return numbered.drop("_slot", "_at", "_start")
    # A group begins where its first row in a partition is, less its rows in earlier partitions.
    groups = rows.groupBy("_slot", *by).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select(
        F.col("_slot").alias("_in"),
        *[F.col(c).alias(f"_by_{c}") for c in by],
        (F.col("_first") - F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).alias("_from"),
    )
    same = F.col("_slot") == F.col("_in")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    within = rows.join(offsets, same).withColumn(name, F.col("_at") - F.col("_from") + 1)
    return within.drop("_slot", "_at", "_in", "_from", *[f"_by_{c}" for c in by])


def assign_batches(
    df: DataFrame, order: Sequence[str], n: int | None = None, by: Sequence[str] = (), name: str = "batch"
) -> DataFrame:
    """Consecutive batches of ``n`` rows, numbered from 0; one batch when ``n`` is not given."""
    if n is None:
        return df.withColumn(name, F.lit(0).cast("long"))
    numbered = number_rows(df, order, by, "_no")
    return numbered.withColumn(name, F.expr(f"(_no - 1) div {int(n)}")).drop("_no")
