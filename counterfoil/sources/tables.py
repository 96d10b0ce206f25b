"""Typed tables as string tables, and the profile of a source."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import col, number_text

NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def _cell_text(field: T.StructField, scale: int | None) -> Column:
    c = col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        if scale is None:
            return number_text(c.cast("double"))
        return c.cast(f"decimal(38,{scale})").cast("string")
    if isinstance(field.dataType, NESTED):
        return F.to_json(c)
    return c.cast("string")


def as_string_table(df: DataFrame, scales: Mapping[str, int] | None = None) -> DataFrame:
    """Every column as text, so that any Spark table can be a source.

    Doubles print their shortest digits without exponent; ``scales`` fixes the
    number of decimals of the columns it names. Lists and structs become JSON.
    """
    scales = scales or {}
    return df.select(
        *(_cell_text(f, scales.get(f.name)).alias(f.name) for f in df.schema.fields)
    )


def profile(source_a: DataFrame, source_b: DataFrame) -> DataFrame:
    """``(source, rows, columns)``, one row per source."""

    def one(df: DataFrame, label: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(label).alias("source"), "rows", F.lit(len(df.columns)).alias("columns")
        )

    return one(source_a, "source_a").unionByName(one(source_b, "source_b"))
