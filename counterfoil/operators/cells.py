"""Per key: rows on each side and, per mapping, how many row pairs agree.

All counts and rates of a reconciliation follow from this table, and it is
built without making the row pairs. Where a key has at most one row per side,
one grouping of both sides brings the two rows together. Where it has more, the
agreeing pairs of a mapping are the sum over the distinct texts of (rows of A
with the text) x (rows of B with the text), which needs counts only. A key with
a third of all rows on both sides thus costs what its rows cost, not their
product.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import col
from ..functions.numbers import exact_number, shifted
from .compare import CellPair, keyed_rows

# Repeated keys are sent to every task only when their counted size is below this.
BROADCAST_BYTES = 64 * 1024 * 1024
# Where they are more, keys with more rows than this are sent to every task all the same: there can't be many.
HOT_ROWS = 100_000
# Rows of the other ones that a task counts; with more, sorting and counting wrest the memory from each other.
TASK_ROWS = 250_000
# Distinct numbers of a key up to which its near pairs are counted in one grouped row.
FEW_NUMBERS = 64


def joins(join_type: str, n_a: Column, n_b: Column) -> Column:
    """Does a key with these row counts take part in the comparison?"""
    return {
        "inner": (n_a > 0) & (n_b > 0),
        "left": n_a > 0,
        "right": n_b > 0,
        "outer": F.lit(True),
    }[join_type]


def row_pairs(join_type: str, n_a: Column, n_b: Column) -> Column:
    """Rows that the join has for the key."""
    return F.when(
        joins(join_type, n_a, n_b), F.greatest(n_a, F.lit(1)) * F.greatest(n_b, F.lit(1))
    ).otherwise(F.lit(0))


def _texts(df: DataFrame, key: str, pairs: Sequence[CellPair], side: str) -> DataFrame:
    return keyed_rows(df, key, pairs, side).select(
        col(key).alias("key"), *(pair.counted_text(side).alias(f"t{pair.index}") for pair in pairs)
    )


def build_key_cells(
    df_a: DataFrame,
    df_b: DataFrame,
    key_a: str,
    key_b: str,
    pairs: Sequence[CellPair],
    join_type: str,
    keep: Callable[[DataFrame], DataFrame],
    count_type: str = "bigint",
) -> DataFrame:
    """``(key, n_a, n_b, pairs, m0, m1, ...)``: ``m`` counts agreeing pairs per mapping.

    ``keep`` stores the narrow first result, which is read twice. ``count_type``
    may be a wider decimal where pairs of one key exceed 64 bits.
    """
    a = _texts(df_a, key_a, pairs, "a")
    b = _texts(df_b, key_b, pairs, "b")
    n_a, n_b = F.col("n_a"), F.col("n_b")
    matched = [F.col(f"m{pair.index}") for pair in pairs]

    first = keep(_single_rows(a, b, pairs, join_type, count_type))
    repeated = ((n_a > 1) | (n_b > 1)) & joins(join_type, n_a, n_b)
    hot = repeated & (n_a + n_b > HOT_ROWS)
    bytes_of, zero = F.octet_length("key") + 32, F.lit(0)
    size = first.filter(repeated).agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum(bytes_of).alias("bytes"),
        F.coalesce(F.sum(F.when(hot, bytes_of)), zero).alias("hot_bytes"),
        F.coalesce(F.sum(F.when(~hot, n_a + n_b)), zero).alias("rows"),
    ).first()
    cells = first
    if pairs and size["keys"] > 0:

        def keys(condition: Column) -> DataFrame:
            return first.filter(condition).select("key")

        if size["bytes"] < BROADCAST_BYTES:
            few = F.broadcast(keys(repeated))
            counted = _counted_rows(*(rows.join(few, "key", "left_semi") for rows in (a, b)), pairs, count_type, keep)
        else:
            # Here rows are dealt out by key, and all of a hot key would meet in one task; so hot keys go the way above.
            # The number of tasks follows the rows, since packed bytes say little about the memory they take; with fewer tasks
            # than the session's, Spark would join in as many as that and deal out the rows once more.
            least = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            tasks = max(least, int(size["rows"]) // TASK_ROWS + 1)
            many, sides = keys(repeated & ~hot), (a, b)
            if size["hot_bytes"] > 0:
                few = keys(hot)
                if size["hot_bytes"] < BROADCAST_BYTES:
                    few = F.broadcast(few)
                sides = tuple(rows.join(few, "key", "left_anti") for rows in (a, b))
            many = many.repartition(tasks, "key").hint("merge")
            sides = (rows.repartition(tasks, "key").join(many, "key", "left_semi") for rows in sides)
            counted = _counted_rows(*sides, pairs, count_type, keep)
            if size["hot_bytes"] > 0:
                sides = (rows.join(few, "key", "left_semi") for rows in (a, b))
                counted = counted.unionByName(_counted_rows(*sides, pairs, count_type, keep))
        cells = first.filter(~repeated).unionByName(counted)
    return cells.select(
        "key", "n_a", "n_b", row_pairs(join_type, n_a, n_b).alias("pairs"), *matched
    )


def _single_rows(
    a: DataFrame, b: DataFrame, pairs: Sequence[CellPair], join_type: str, count_type: str
) -> DataFrame:
    """All keys with their row counts; agreement where each side has at most one row."""
    one, zero = F.lit(1).cast(count_type), F.lit(0).cast(count_type)
    names = [f"t{pair.index}" for pair in pairs] or ["key"]
    row = F.struct(*names)
    both = a.select("key", one.alias("n_a"), zero.alias("n_b"), row.alias("row_a")).unionByName(
        b.select("key", zero.alias("n_a"), one.alias("n_b"), row.alias("row_b")),
        allowMissingColumns=True,
    )
    grouped = both.groupBy("key").agg(
        F.sum("n_a").cast(count_type).alias("n_a"),
        F.sum("n_b").cast(count_type).alias("n_b"),
        F.min("row_a").alias("row_a"),
        F.min("row_b").alias("row_b"),
    )
    n_a, n_b = F.col("n_a"), F.col("n_b")
    single = (n_a <= 1) & (n_b <= 1) & joins(join_type, n_a, n_b)
    return grouped.select(
        "key",
        "n_a",
        "n_b",
        *(
            F.when(
                single & pair.agree(F.col(f"row_a.t{pair.index}"), F.col(f"row_b.t{pair.index}")),
                one,
            )
            .otherwise(zero)
            .alias(f"m{pair.index}")
            for pair in pairs
        ),
    )


def _counted_rows(
    a: DataFrame,
    b: DataFrame,
    pairs: Sequence[CellPair],
    count_type: str,
    keep: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Agreeing pairs of repeated keys from the counts of their distinct texts."""
    one, zero = F.lit(1).cast(count_type), F.lit(0).cast(count_type)

    def long_form(df: DataFrame, n_a: Column, n_b: Column) -> DataFrame:
        texts = F.array(*(F.col(f"t{pair.index}") for pair in pairs))
        return df.select("key", n_a.alias("a"), n_b.alias("b"), F.posexplode(texts).alias("i", "t"))

    def total(c: Column | str) -> Column:
        return F.sum(c).cast(count_type)

    a_count, b_count = F.col("a"), F.col("b")
    texts = (
        long_form(a, one, zero)
        .unionByName(long_form(b, zero, one))
        .groupBy("key", "i", "t")
        .agg(total("a").alias("a"), total("b").alias("b"))
    )
    tolerant = [p for p in pairs if p.mapping.method == "tolerance"]
    positions = [i for i, p in enumerate(pairs) if p in tolerant]
    same = a_count * b_count
    if tolerant:
        number = F.when(F.col("i").isin(positions), exact_number(F.col("t")))
        texts = keep(texts.withColumn("v", number))  # read once for the equal texts and for each tolerance
        same = F.when(F.col("v").isNotNull(), zero).otherwise(same)
    cells = texts.groupBy("key", "i").agg(
        total("a").alias("n_a"),
        total("b").alias("n_b"),
        total(same).alias("same"),
        total(F.when(F.col("t").isNull(), a_count + b_count).otherwise(zero)).alias("empty"),
    )
    n_a, n_b = F.col("n_a"), F.col("n_b")
    agreeing = F.when((n_a > 0) & (n_b > 0), F.col("same")).otherwise(F.col("empty"))
    parts = cells.select("key", "i", "n_a", "n_b", agreeing.alias("m"))
    for position, pair in zip(positions, tolerant):
        numbers = texts.filter((F.col("i") == position) & F.col("v").isNotNull()).select("key", "v", "a", "b")
        near = _near_pairs(numbers, pair.mapping.tolerance, total, keep)
        parts = parts.unionByName(
            near.select("key", F.lit(position).alias("i"), zero.alias("n_a"), zero.alias("n_b"), "m")
        )
    return parts.groupBy("key").agg(
        F.max("n_a").alias("n_a"),
        F.max("n_b").alias("n_b"),
        *(
            F.coalesce(total(F.when(F.col("i") == i, F.col("m"))), zero).alias(f"m{pair.index}")
            for i, pair in enumerate(pairs)
        ),
    )


def _near_pairs(
    numbers: DataFrame, tolerance: str, total: Callable, keep: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Per key: pairs of numbers (key, v, a, b) within the tolerance, counted without making them.

    Most keys have few distinct numbers, and these fit into one grouped row. Only keys with more than
    ``FEW_NUMBERS`` go the way of running sums, whose cost does not depend on how many there are.
    """
    sizes = keep(numbers.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FEW_NUMBERS))
    size = sizes.agg(F.count(F.lit(1)).alias("keys"), F.sum(F.octet_length("key") + 32).alias("bytes")).first()
    if not size["keys"]:
        return _near_in_rows(numbers, tolerance, total)
    many = sizes.select("key")
    if size["bytes"] < BROADCAST_BYTES:
        many = F.broadcast(many)
    few = _near_in_rows(numbers.join(many, "key", "left_anti"), tolerance, total)
    return few.unionByName(_near_by_sums(numbers.join(many, "key", "left_semi"), tolerance, total, keep))


def _near_in_rows(numbers: DataFrame, tolerance: str, total: Callable) -> DataFrame:
    """Near pairs of keys with few numbers: the numbers of B within reach of each number of A, key by key."""
    kind = numbers.schema["a"].dataType
    zero = F.lit(0).cast(kind)
    v = F.col("v")
    asked = F.struct("a", shifted(v, tolerance, False).alias("low"), shifted(v, tolerance, True).alias("high"))
    lists = numbers.groupBy("key").agg(
        F.collect_list(F.when(F.col("a") > 0, asked)).alias("asked"),
        F.collect_list(F.when(F.col("b") > 0, F.struct("v", "b"))).alias("held"),
    )

    def reached(x: Column) -> Column:
        near = F.filter("held", lambda y: (y["v"] >= x["low"]) & (y["v"] <= x["high"]))
        return F.aggregate(near, zero, lambda s, y: (s + y["b"]).cast(kind))

    pairs = F.aggregate("asked", zero, lambda s, x: (s + x["a"] * reached(x)).cast(kind))
    return lists.select("key", pairs.alias("m"))


def _near_by_sums(
    numbers: DataFrame, tolerance: str, total: Callable, keep: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Pairs of numbers of one key within the tolerance, counted without making them.

    Along the sorted numbers a running sum counts the rows of B. Each number v of
    A asks for the sum up to v + tolerance and for the sum before v - tolerance;
    the difference is what is near. The rows are dealt by ranges of key and
    number, so a key with very many numbers is spread over tasks: the sums start
    anew in each range and the totals of the ranges before it are added.
    """
    kind = numbers.schema["a"].dataType
    zero = F.lit(0).cast(kind)
    of_a = numbers.filter(F.col("a") > 0)

    def asked(up: bool) -> DataFrame:
        sign, turn = (1, 2) if up else (-1, 0)
        weight = (F.col("a") * sign).cast(kind).alias("w")
        return of_a.select("key", shifted(F.col("v"), tolerance, up).alias("v"), F.lit(turn).alias("turn"), weight, zero.alias("b"))

    held = numbers.filter(F.col("b") > 0).select("key", "v", F.lit(1).alias("turn"), zero.alias("w"), "b")
    events = held.union(asked(True)).union(asked(False)).groupBy("key", "v", "turn")
    events = events.agg(total("w").alias("w"), total("b").alias("b"))
    order = ["key", "v.whole", "v.part", "turn"]
    events = keep(events.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))

    sums = events.groupBy("key", "range").agg(total("b").alias("b"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "range", F.coalesce(F.sum("b").over(before), zero).alias("before"))
    inside = Window.partitionBy("key", "range").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("run", F.sum("b").over(inside)).join(sums, ["key", "range"])
    return counted.groupBy("key").agg(total(F.col("w") * (F.col("run") + F.col("before"))).alias("m"))


def judgements(
    df_a: DataFrame,
    df_b: DataFrame,
    key_a: str,
    key_b: str,
    pairs: Sequence[CellPair],
    key_cells: DataFrame,
    count_type: str = "bigint",
) -> DataFrame:
    """``(key, mapping_idx, column, status, diff_type, pairs)``: the details, counted per judgement.

    All numbers follow from counts: agreeing pairs are those of the per-key table, pairs
    that lack one cell are the empty cells of a side times the filled cells of the other, and what is left
    of all pairs differs. So there are at most four rows per key and mapping, and no pair of rows is made.
    """
    zero = F.lit(0).cast(count_type)

    def empties(df: DataFrame, key: str, side: str) -> DataFrame:
        other = "b" if side == "a" else "a"
        counts = [F.count_if(pair.shown(side).isNull()).cast(count_type).alias(f"e{side}{pair.index}") for pair in pairs]
        none = [zero.alias(f"e{other}{pair.index}") for pair in pairs]
        rows = df.filter(col(key).isNotNull()).groupBy(col(key).alias("key")).agg(*counts)
        return rows.select("*", *none)

    both = empties(df_a, key_a, "a").unionByName(empties(df_b, key_b, "b"))
    names = [f"e{side}{pair.index}" for side in "ab" for pair in pairs]
    empty = both.groupBy("key").agg(*(F.sum(name).cast(count_type).alias(name) for name in names))
    cells = key_cells.filter(F.col("pairs") > 0).join(empty, "key")

    def counted(pair: CellPair) -> list[Column]:
        # A key that one side lacks is compared with one empty cell.
        rows = {side: F.greatest(F.col(f"n_{side}"), F.lit(1)) for side in "ab"}
        gone = {side: F.when(F.col(f"n_{side}") == 0, F.lit(1)).otherwise(F.col(f"e{side}{pair.index}")) for side in "ab"}
        same = F.col(f"m{pair.index}")
        lacks_a = gone["a"] * (rows["b"] - gone["b"])
        lacks_b = (rows["a"] - gone["a"]) * gone["b"]
        differs = "set_diff" if pair.mapping.method == "set" else "value_diff"
        kinds = {
            "exact_match": same, "missing_in_a": lacks_a, "missing_in_b": lacks_b, differs: F.col("pairs") - same - lacks_a - lacks_b
        }
        return [
            F.struct(
                F.lit(pair.index).alias("mapping_idx"),
                F.lit(pair.mapping.label).alias("column"),
                F.lit("match" if kind == "exact_match" else "mismatch").alias("status"),
                F.lit(kind).alias("diff_type"),
                n.cast(count_type).alias("pairs"),
            )
            for kind, n in kinds.items()
        ]

    rows = cells.select("key", F.inline(F.array(*(entry for pair in pairs for entry in counted(pair)))))
    return rows.filter(F.col("pairs") > 0)
