"""Key presence, unmatched keys and repeated keys.

Both sides go through one grouped count, so a key that holds a large share of
the rows is summed before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import col


def key_counts(keys_a: DataFrame, keys_b: DataFrame) -> DataFrame:
    """``(key, n_a, n_b)`` for every non-null key of either side."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = keys_a.select("key", one.alias("n_a"), zero.alias("n_b")).unionByName(
        keys_b.select("key", zero.alias("n_a"), one.alias("n_b"))
    )
    return (
        both.filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    )


def key_status(counts: DataFrame) -> DataFrame:
    """``(key, in_a, in_b)``: the matched, only-in-A and only-in-B key sets."""
    return counts.select(
        "key", (F.col("n_a") > 0).alias("in_a"), (F.col("n_b") > 0).alias("in_b")
    )


def unmatched(counts: DataFrame) -> DataFrame:
    """``(source, key)`` of the keys that one side lacks."""
    only_a, only_b = F.col("n_b") == 0, F.col("n_a") == 0
    return counts.filter(only_a | only_b).select(
        F.when(only_a, F.lit("Source A")).otherwise(F.lit("Source B")).alias("source"), "key"
    )


def duplicate_keys(df: DataFrame, columns: Sequence[str], nulls: bool) -> DataFrame:
    """Key values on more than one row, with the number of rows.

    ``nulls`` keeps null as a value of its own (the raw report does), otherwise
    rows with a null key are left out (the report after normalisation).
    """
    rows = df if nulls else df.dropna(subset=list(columns))
    return (
        rows.groupBy(*(col(c) for c in columns))
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > 1)
    )


def raw_key_columns(df: DataFrame, key_a: str, key_b: str) -> list[str]:
    """The key names that the raw table has; both when it has both."""
    return [name for name in dict.fromkeys((key_a, key_b)) if name in df.columns]


def sample_text(duplicates: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """One row: number of repeated values and the first ``n`` of them, in order."""
    if len(columns) == 1:
        shown = F.coalesce(col(columns[0]), F.lit("nan"))
    else:
        quoted = [
            F.coalesce(F.concat(F.lit("'"), col(c), F.lit("'")), F.lit("nan")) for c in columns
        ]
        shown = F.concat(F.lit("("), F.concat_ws(", ", *quoted), F.lit(")"))
    values = duplicates.select(shown.alias("shown"))
    first = values.orderBy("shown").limit(n).agg(
        F.array_sort(F.collect_list("shown")).alias("sample")
    )
    total = values.agg(F.count(F.lit(1)).alias("repeated"))
    return (
        total.unionByName(first, allowMissingColumns=True)
        .agg(F.max("repeated").alias("repeated"), F.max("sample").alias("sample"))
        .filter(F.col("repeated") > 0)
    )
