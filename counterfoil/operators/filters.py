"""Row rules: an ordered list per source, all of which a row must survive.

Cells are compared as text with null as empty text unless the operator says
otherwise, so a predicate is never null and rules combine with plain AND. Text
predicates are written with null tests instead of a coalesced column where that
says the same, since only those reach the scan as pushed filters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import messages
from ..errors import SpecError
from ..functions import blank, col, java_pattern, nz, to_number
from ..spec import FilterRule

LOG_SCHEMA = (
    "stage string, source string, rule_index int, column string, operator string, "
    "action string, value string, rows_before bigint, rows_after bigint, "
    "rows_affected bigint, status string, message string"
)


def _equals(c: Column, value: Any) -> Column:
    if isinstance(value, bool):
        return F.lower(nz(c)) == F.lit(str(value).lower())
    if isinstance(value, (int, float)):
        return _numeric(c, value, lambda number, bound: number == bound)
    return _is(c, str(value))


def _is(c: Column, text: str) -> Column:
    return nz(c) == F.lit("") if text == "" else c.eqNullSafe(F.lit(text))


def _numeric(c: Column, value: Any, test) -> Column:
    bound = float(value)
    if math.isnan(bound):
        return F.lit(False)
    return F.coalesce(test(to_number(c), F.lit(bound)), F.lit(False))


def _member(c: Column, values: Sequence[Any]) -> Column:
    texts = [str(v).lower() if isinstance(v, bool) else str(v) for v in values]
    if "" in texts:
        return c.isNull() | c.isin(texts)
    return c.isNotNull() & c.isin(texts)


def _contains(c: Column, text: str) -> Column:
    return F.lit(True) if text == "" else c.isNotNull() & c.contains(F.lit(text))


def predicate(rule: FilterRule) -> Column:
    """Does the row match the rule? Never null."""
    c, value = col(rule.column), rule.value
    match rule.operator:
        case "equals":
            return _equals(c, value)
        case "not_equals":
            return ~_equals(c, value)
        case "in":
            return _member(c, value)
        case "not_in":
            return ~_member(c, value)
        case "greater_than":
            return _numeric(c, value, lambda number, bound: number > bound)
        case "less_than":
            return _numeric(c, value, lambda number, bound: number < bound)
        case "contains":
            return _contains(c, str(value))
        case "matches_regex":
            return nz(c).rlike(java_pattern(str(value)))
        case "is_null":
            return blank(c)
        case "is_not_null":
            return ~blank(c)
    raise SpecError(f"unknown filter operator {rule.operator!r}")


def survives(rule: FilterRule) -> Column:
    """Does the row stay?"""
    return ~predicate(rule) if rule.action == "skip" else predicate(rule)


def check_patterns(spark: SparkSession, patterns: Sequence[str]) -> None:
    """Try the patterns on a constant, so that a bad one fails before any scan."""
    if not patterns:
        return
    try:
        spark.range(1).select(*(F.lit("").rlike(p) for p in patterns)).collect()
    except Exception as exc:
        raise SpecError(f"a pattern is not usable: {exc}") from exc


def all_rules(df: DataFrame, rules: Sequence[FilterRule]) -> Column:
    """One condition for the whole list; rules on absent columns do nothing."""
    live = [survives(rule) for rule in rules if rule.column in df.columns]
    return reduce(lambda left, right: left & right, live, F.lit(True))


def apply_filters(df: DataFrame, rules: Sequence[FilterRule]) -> DataFrame:
    if not any(rule.column in df.columns for rule in rules):
        return df
    return df.filter(all_rules(df, rules))


def filter_audit(df: DataFrame, rules: Sequence[FilterRule], source: str) -> DataFrame:
    """Rows before and after every rule, from one pass over the source."""
    counts = [F.count(F.lit(1)).alias("n0")]
    kept = F.lit(True)
    for i, rule in enumerate(rules, start=1):
        if rule.column in df.columns:
            kept = kept & survives(rule)
        counts.append(F.count_if(kept).alias(f"n{i}"))
    entries = [
        _entry(df, rule, source, i) for i, rule in enumerate(rules)
    ] or [_passthrough(source)]
    return df.agg(*counts).select(F.inline(F.array(*entries))).to(_schema())


def _schema() -> T.StructType:
    return T.StructType.fromDDL(LOG_SCHEMA)


def _entry(df: DataFrame, rule: FilterRule, source: str, i: int) -> Column:
    before, after = F.col(f"n{i}"), F.col(f"n{i + 1}")
    found = rule.column in df.columns
    message = None
    if not found:
        message = messages.RULE_SKIPPED.format(
            column=rule.column, source=source, columns=df.columns
        )
    shown = None if rule.operator in ("is_null", "is_not_null") else str(rule.value)
    return _log_struct(
        source=F.lit(source),
        rule_index=F.lit(i),
        column=F.lit(rule.column),
        operator=F.lit(rule.operator),
        action=F.lit(rule.action),
        value=F.lit(shown),
        rows_before=before,
        rows_after=after,
        rows_affected=before - after,
        status=F.lit("applied" if found else "warning"),
        message=F.lit(message),
    )


def _passthrough(source: str) -> Column:
    n = F.col("n0")
    return _log_struct(
        source=F.lit(source),
        action=F.lit("no_rules"),
        rows_before=n,
        rows_after=n,
        rows_affected=F.lit(0).cast("bigint"),
        status=F.lit("passthrough"),
        message=F.format_string(messages.NO_RULES, F.lit(source), n),
    )


def _log_struct(stage: str = "filter", **values: Column) -> Column:
    values["stage"] = F.lit(stage)
    return F.struct(
        *(
            values.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in _schema().fields
        )
    )


def log_row(df: DataFrame, stage: str, **values: Column) -> DataFrame:
    """The rows of ``df`` as log entries with the given columns."""
    return df.select(F.inline(F.array(_log_struct(stage, **values)))).to(_schema())
