"""Connected components of links, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrec.session import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    larger = both.where(F.col("v") > F.col("u")).join(least, "u")
    return larger.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. ``u > v`` in every link."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    others = links.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(links: DataFrame) -> tuple:
    """Number of links and a digest of them."""
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count("*"), digest).first())


def stars(links: DataFrame) -> DataFrame:
    """``(u, v)``: every linked node but the smallest of its component, with that smallest one.

    ``links`` has the columns ``u`` and ``v`` of one ordered type. Large-star and
    small-star steps take turns until nothing changes; each result is written to
    the shared folder, so lineage stays short and a lost executor costs no
    earlier step. A node with very many links is only ever aggregated (combined
    before the shuffle) or joined to one row.
    """
    ordered = links.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now = stored(ordered.distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        now = stored(_small_star(_large_star(now)), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now
