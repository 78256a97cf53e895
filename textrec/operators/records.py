"""JSON records whose fields differ from one to the next, held as VARIANT: read once, without a pass for their types."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "record variant, _corrupt_record string"

# Types that a column may have; fields that are objects, lists or of several kinds stay VARIANT.
PLAIN = re.compile(r"BIGINT|DOUBLE|FLOAT|STRING|BOOLEAN|DATE|TIMESTAMP|DECIMAL\(\d+,\s*\d+\)", re.IGNORECASE)


def read_records(spark: SparkSession, path: str | list[str], lines: bool = True) -> DataFrame:
    """``(record, error)``: a row for each JSON line, or with ``lines`` false for each file.

    What is no JSON has its text as the error and a null record; so has an object
    that names a key twice. The types of fields are not looked for, so the files
    are read once, and records of any shapes go into one table.
    """
    reader = spark.read.schema(RECORDS).option("singleVariantColumn", "record").option("mode", "PERMISSIVE")
    return reader.option("multiLine", not lines).json(path).withColumnRenamed("_corrupt_record", "error")


def merged_type(records: DataFrame, col: str = "record") -> DataFrame:
    """One row: ``rows``, and ``type``, the type that holds them all, as Spark writes it."""
    return records.agg(F.count(col).alias("rows"), F.schema_of_variant_agg(col).alias("type"))


def record_fields(records: DataFrame, col: str = "record") -> DataFrame:
    """``(field, kind, rows)``: how many records have each top-level field, by the kind of its value.

    A null value is of the kind VOID; records that are no objects have no fields.
    Rows are combined before they are shuffled, so a field that all have is no more work.
    """
    spark = records.sparkSession
    values = spark.tvf.variant_explode(F.col(f"t.{col}").outer())
    each = records.select(col).alias("t").lateralJoin(values.alias("e")).where(F.col("e.key").isNotNull())
    kinds = each.select(F.col("e.key").alias("field"), F.schema_of_variant("e.value").alias("kind"))
    return kinds.groupBy("field", "kind").agg(F.count("*").alias("rows"))


def field_types(records: DataFrame, col: str = "record") -> DataFrame:
    """``(field, type, rows, kinds)``: for each top-level field the type that holds all its values, and how many kinds there are."""
    spark = records.sparkSession
    values = spark.tvf.variant_explode(F.col(f"t.{col}").outer())
    each = records.select(col).alias("t").lateralJoin(values.alias("e")).where(F.col("e.key").isNotNull())
    kind = F.schema_of_variant("e.value")
    return each.groupBy(F.col("e.key").alias("field")).agg(
        F.schema_of_variant_agg("e.value").alias("type"), F.count("*").alias("rows"), F.count_distinct(kind).alias("kinds")
    )


def _field(col: str, name: str, kind: str) -> Column:
    """A field's value as ``kind``; paths have no way to write a name with both kinds of quotes."""
    if "'" in name and '"' in name:
        named = F.try_variant_get(col, "$", "map<string, variant>")
        return F.try_variant_get(F.get(F.map_values(F.map_filter(named, lambda k, _: k == F.lit(name))), F.lit(0)), "$", kind)
    return F.try_variant_get(col, f'$["{name}"]' if "'" in name else f"$['{name}']", kind)


def columns_of(records: DataFrame, fields: Mapping[str, str], col: str = "record") -> DataFrame:
    """The ``fields`` (name: type) of each record as columns, null where they are absent or cannot be of that type."""
    return records.select(*[_field(col, name, kind).alias(name) for name, kind in fields.items()])


def as_table(records: DataFrame, col: str = "record") -> DataFrame:
    """A column for every top-level field that any record has, in order of name.

    A column has the type that holds all values of the field; where they are
    objects, lists or of several kinds it stays VARIANT. Only the fields' names
    and types reach the driver. Names that differ in case only get one column.
    """
    found = {r["field"]: r["type"] for r in field_types(records, col).orderBy("field").collect()}
    seen: dict[str, str] = {}
    for name, kind in found.items():
        if name.lower() not in {n.lower() for n in seen}:
            seen[name] = kind if PLAIN.fullmatch(kind) else "variant"
    return columns_of(records, seen, col)
