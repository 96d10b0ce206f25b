"""Cell comparison: how a pair of cells is judged, and one row per judged pair."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import col, java_pattern, let, list_source, list_text, parse_array, segments
from ..functions.numbers import exact_number, number_key, shifted
from ..spec import ColumnMapping
from .normalize import shadow_name

DETAIL_COLUMNS = (
    "key",
    "mapping_idx",
    "column",
    "value_a",
    "value_b",
    "normalized_a",
    "normalized_b",
    "status",
    "diff_type",
    "only_in_a",
    "only_in_b",
    "common",
)


def close(a: Column, b: Column, tolerance: str) -> Column:
    """Numbers no further apart than the tolerance; other cells by their text.

    Nothing is rounded. Numbers with more digits than ``exact_number`` takes
    agree when they are the same number, and with no other.
    """

    def within(pair: Column) -> Column:
        low, high = F.least(pair["a"], pair["b"]), F.greatest(pair["a"], pair["b"])
        return high <= shifted(low, tolerance, up=True)

    same = a.eqNullSafe(b)
    both = F.struct(exact_number(a).alias("a"), exact_number(b).alias("b"))
    near = let(F.when(~same, both), lambda p: F.when(p["a"].isNotNull() & p["b"].isNotNull(), within(p)))
    return same | F.coalesce(near, number_key(a).eqNullSafe(number_key(b)))


@dataclass(frozen=True)
class CellPair:
    """A mapping with the knowledge of whether its cells are lists."""

    index: int
    mapping: ColumnMapping
    list_a: bool
    list_b: bool

    def _cell(self, side: str) -> tuple[Column, bool]:
        name = self.mapping.column_a if side == "a" else self.mapping.column_b
        return col(name), self.list_a if side == "a" else self.list_b

    def shown(self, side: str) -> Column:
        """The normalised cell as text."""
        cell, is_list = self._cell(side)
        return F.to_json(cell) if is_list else cell

    def items(self, side: str) -> Column:
        """The cell as a sorted set (set method) or as its pieces (segments); null stays null."""
        cell, is_list = self._cell(side)
        if self.mapping.method == "segments":
            return segments(cell, self.mapping.lengths)
        array = cell if is_list else parse_array(cell, F.col(self._source_name(side)))
        return F.when(cell.isNotNull(), F.sort_array(F.array_distinct(array)))

    def _source_name(self, side: str) -> str:
        return f"__list_source_{side}{self.index}"

    def helpers(self, side: str) -> list[Column]:
        """Columns that ``items`` and ``text`` need beside the cells."""
        cell, is_list = self._cell(side)
        if self.mapping.method != "set" or is_list:
            return []
        return [list_source(cell).alias(self._source_name(side))]

    @property
    def has_items(self) -> bool:
        return self.mapping.method in ("set", "segments")

    def text(self, side: str) -> Column:
        """One text per cell, equal exactly when the cells count as equal.

        Only ``tolerance`` is not a matter of equal texts; see ``agree``.
        """
        cell, is_list = self._cell(side)
        mapping = self.mapping
        if mapping.method == "set":
            return F.to_json(self.items(side))
        if is_list:
            return list_text(cell)
        if mapping.compare_on == "canonical":
            name = mapping.column_a if side == "a" else mapping.column_b
            cell = col(shadow_name(name))
        if mapping.method == "regex":
            return self._groups(cell)
        return cell

    def counted_text(self, side: str) -> Column:
        """The text by which equal cells are counted; a number has one however it is written."""
        text = self.text(side)
        return number_key(text) if self.mapping.method == "tolerance" else text

    def _groups(self, cell: Column) -> Column:
        """What the pattern's groups take from the cell; the cell when it takes nothing."""
        pattern = java_pattern(self.mapping.pattern, full=False)
        n = re.compile(self.mapping.pattern).groups
        taken = [
            F.regexp_extract_all(cell, F.lit(pattern), F.lit(i)) for i in (range(1, n + 1) or (0,))
        ]
        return F.when(F.size(taken[0]) > 0, F.concat(F.lit("groups "), F.to_json(F.array(*taken)))
                      ).otherwise(F.concat(F.lit("text "), cell))

    def agree(self, a: Column, b: Column) -> Column:
        """Do two texts of this mapping count as equal? Never null; null equals null."""
        if self.mapping.method == "tolerance":
            return close(a, b, self.mapping.tolerance)
        return a.eqNullSafe(b)

    # -- one detail per pair -------------------------------------------------

    def carried(self, side: str) -> list[Column]:
        """What a row brings into the join for this mapping."""
        out = [self.shown(side).alias(f"shown_{side}{self.index}")]
        if self.has_items:
            out.append(self.items(side).alias(f"items_{side}{self.index}"))
        elif self._needs_text:
            out.append(self.text(side).alias(f"text_{side}{self.index}"))
        return out

    @property
    def _needs_text(self) -> bool:
        plain = self.mapping.method in ("exact", "tolerance")
        return not plain or self.mapping.compare_on != "display" or self.list_a or self.list_b

    def _joined_texts(self) -> tuple[Column, Column]:
        kind = "text" if self._needs_text else "shown"
        return F.col(f"{kind}_a{self.index}"), F.col(f"{kind}_b{self.index}")

    def agrees(self) -> Column:
        """Does the joined pair match? Never null."""
        if self.mapping.method == "set":
            return F.col(f"items_a{self.index}").eqNullSafe(F.col(f"items_b{self.index}"))
        if self.mapping.method == "segments":
            return F.col(f"shown_a{self.index}").eqNullSafe(F.col(f"shown_b{self.index}"))
        return self.agree(*self._joined_texts())

    def detail(self) -> Column:
        """The judgement of a joined pair as a struct."""
        i, mapping = self.index, self.mapping
        a, b = F.col(f"shown_a{i}"), F.col(f"shown_b{i}")
        agrees = self.agrees()
        no_items = F.lit(None).cast("array<string>")
        only_a, only_b, common = no_items, no_items, no_items
        if self.has_items:
            both = a.isNotNull() & b.isNotNull()
            items_a, items_b = F.col(f"items_a{i}"), F.col(f"items_b{i}")
            if mapping.method == "set":
                left, right = F.array_except(items_a, items_b), F.array_except(items_b, items_a)
                shared = F.array_intersect(items_a, items_b)
            else:
                left, right, shared = _piecewise(items_a, items_b)
            only_a, only_b, common = F.when(both, left), F.when(both, right), F.when(both, shared)
            text_a = F.when(both, F.to_json(items_a)).otherwise(a)
            text_b = F.when(both, F.to_json(items_b)).otherwise(b)
        else:
            text_a, text_b = self._joined_texts()
        differs = "set_diff" if mapping.method == "set" else "value_diff"
        diff_type = (
            F.when(agrees, F.lit("exact_match"))
            .when(a.isNull(), F.lit("missing_in_a"))
            .when(b.isNull(), F.lit("missing_in_b"))
            .otherwise(F.lit(differs))
        )
        return F.struct(
            F.lit(i).alias("mapping_idx"),
            F.lit(mapping.label).alias("column"),
            a.alias("value_a"),
            b.alias("value_b"),
            text_a.alias("normalized_a"),
            text_b.alias("normalized_b"),
            F.when(agrees, F.lit("match")).otherwise(F.lit("mismatch")).alias("status"),
            diff_type.alias("diff_type"),
            only_a.alias("only_in_a"),
            only_b.alias("only_in_b"),
            common.alias("common"),
        )


def _piecewise(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Pieces that differ from the piece in the same place, and pieces that agree."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))

    def pick(keep, part: str) -> Column:
        return F.transform(F.filter(pairs, keep), lambda p: p.getField(part))

    def differ(p: Column) -> Column:
        return ~p.getField("a").eqNullSafe(p.getField("b"))

    return pick(differ, "a"), pick(differ, "b"), pick(lambda p: ~differ(p), "a")


def cell_pairs(
    mappings: Sequence[tuple[int, ColumnMapping]], schema_a: T.StructType, schema_b: T.StructType
) -> list[CellPair]:
    """Mappings with their positions in the job, tied to the normalised tables."""

    def is_list(schema: T.StructType, name: str) -> bool:
        return isinstance(schema[name].dataType, T.ArrayType)

    return [
        CellPair(i, m, is_list(schema_a, m.column_a), is_list(schema_b, m.column_b))
        for i, m in mappings
    ]


def keyed_rows(df: DataFrame, key: str, pairs: Sequence[CellPair], side: str) -> DataFrame:
    """Rows with a key, and the helper columns of the pairs."""
    helpers = [c for pair in pairs for c in pair.helpers(side)]
    rows = df.filter(col(key).isNotNull())
    return rows.select("*", *helpers) if helpers else rows


def _carry(
    df: DataFrame, key: str, pairs: Sequence[CellPair], side: str, collapse: bool
) -> DataFrame:
    rows = keyed_rows(df, key, pairs, side).select(
        col(key).alias("key"), *(c for pair in pairs for c in pair.carried(side))
    )
    if collapse:
        rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(f"n_{side}"))
    return rows


def _few_keys(df: DataFrame) -> DataFrame:
    """The keys of a side, a frequent one at most 64 times.

    Repeats are dropped before the shuffle. Dropping all of them would leave the
    keys partitioned for the join, and then a frequent key of the other side
    could not be split between tasks any more.
    """
    part = F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")
    return df.select("key", part).distinct().select("key")


def joined_rows(
    df_a: DataFrame,
    df_b: DataFrame,
    key_a: str,
    key_b: str,
    pairs: Sequence[CellPair],
    join_type: str,
    collapse: bool = False,
) -> DataFrame:
    """The rows of both sides side by side, by key.

    Rows that one side lacks come from anti joins against the keys of that side
    and not from an outer join: an inner and an anti join can both be split on a
    key with very many rows, a full outer join cannot. ``collapse`` counts
    identical rows first and joins them once (``n_a``, ``n_b``).
    """
    a = _carry(df_a, key_a, pairs, "a", collapse)
    b = _carry(df_b, key_b, pairs, "b", collapse)
    joined = a.join(b, "key")
    if join_type in ("left", "outer"):
        alone = a.join(_few_keys(b), "key", "left_anti")
        joined = joined.unionByName(alone, allowMissingColumns=True)
    if join_type in ("right", "outer"):
        alone = b.join(_few_keys(a), "key", "left_anti")
        joined = joined.unionByName(alone, allowMissingColumns=True)
    return joined


def details(joined: DataFrame, pairs: Sequence[CellPair], mismatches_only: bool = False) -> DataFrame:
    """One row per joined row and mapping.

    For the mismatches alone, rows that agree in every mapping are dropped before
    the others multiply.
    """
    if mismatches_only:
        joined = joined.filter(~reduce(lambda x, y: x & y, (pair.agrees() for pair in pairs)))
    head: list[Column] = [F.col("key")]
    if "n_a" in joined.columns:
        times = F.coalesce("n_a", F.lit(1)) * F.coalesce("n_b", F.lit(1))
        head.append(times.alias("pairs"))
    judged = joined.select(*head, F.inline(F.array(*(pair.detail() for pair in pairs))))
    return judged.filter(F.col("status") == "mismatch") if mismatches_only else judged


def empty_details(df: DataFrame) -> DataFrame:
    schema = T.StructType.fromDDL(
        "key string, mapping_idx int, column string, value_a string, value_b string, "
        "normalized_a string, normalized_b string, status string, diff_type string, "
        "only_in_a array<string>, only_in_b array<string>, common array<string>"
    )
    return df.sparkSession.createDataFrame([], schema)
