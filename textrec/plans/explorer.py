"""Tables behind the two plots of classified entries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrec.functions.columns import category_rank, lookup
from textrec.operators.filters import filter_or_all

# The label that selects every sector, axis labels and columns shown.
ALL_SECTORS = "All Sectors"
SECTOR_AXIS = "Sector"
KIND_AXIS = "Kind of Agent"
DETAILS = ["Organization", "Sector", "Agent_Type_Text", "Kind_of_Agent", "Description", "Full_Description_Tooltip"]


def function_plot(
    df: DataFrame,
    sector: str,
    kinds: Sequence[str],
    agent_types: Sequence[str],
    colours: Mapping[str, str],
    key: str,
) -> DataFrame:
    """Rows of one sector by agent type and kind, or of all sectors by agent type and sector.

    A sector without rows shows all of them. The ranks carry the order of the
    categories, so no row is moved. Narrow, but for one look for the sector.
    """
    shown = filter_or_all(df, "Sector", sector, ALL_SECTORS)
    one_sector = F.lit(False) if sector == ALL_SECTORS else (F.col("Sector") == sector)
    return shown.select(
        key,
        F.col("Agent_Type_Text").alias("x"),
        F.when(one_sector, F.col("Kind_of_Agent")).otherwise(F.col("Sector")).alias("y"),
        F.when(one_sector, KIND_AXIS).otherwise(SECTOR_AXIS).alias("y_label"),
        lookup("Kind_of_Agent", colours).alias("colour"),
        category_rank("Agent_Type_Text", agent_types).alias("x_rank"),
        category_rank("Kind_of_Agent", kinds).alias("kind_rank"),
        *DETAILS,
    )


def consequence_plot(df: DataFrame, colours: Mapping[str, str], key: str) -> DataFrame:
    """Value against proximity of every entry. Narrow: no shuffle."""
    return df.select(
        key,
        F.col("Economic_Value").alias("x"),
        F.col("Proximity_NCF").alias("y"),
        F.col("Economic_Value").alias("size"),
        lookup("Kind_of_Agent", colours).alias("colour"),
        *DETAILS,
    )
