"""Metrics of a reconciliation: counts, rates, breakdowns and callers' own.

A metric is an aggregate over one frame (a source, the per-key counts, the key
list, the details) or a formula over other metrics. All aggregates over one
frame are one pass; frames that no requested metric needs are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import messages
from ..errors import SpecError
from ..functions import round2, safe_divide
from .compare import CellPair
from .derived import Typed, kind_of, names_in, to_column

FRAMES = ("source_a", "source_b", "filtered_a", "filtered_b", "keys", "cells", "details", "collapsed", "judgements")
# Thresholds (fixed values): mismatching cells of a risky key, rates of the bands.
HIGH_RISK = 3
HIGH_RATE, MEDIUM_RATE = 90, 70


@dataclass(frozen=True)
class Metric:
    """A scalar metric: an ``aggregate`` over a frame, or a ``formula`` over metrics.

    ``formula`` gets the columns of the metrics it depends on by name. Three frames hold
    the judged cells. ``details`` has a row for each, so under repeated keys it makes all
    pairs of rows. ``judgements`` has their numbers per key, mapping and kind as
    ``pairs`` and makes none; ``weighted_count`` counts there. ``collapsed`` has the values
    as well, each pair of different rows once with its ``pairs``.
    """

    name: str
    over: str | None = None
    aggregate: Column | None = None
    formula: Callable[[Mapping[str, Column]], Column] | None = None
    expression: str | None = None
    depends_on: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        ways = [self.aggregate is not None, self.formula is not None, self.expression is not None]
        if sum(ways) != 1:
            raise SpecError(f"metric {self.name!r} needs one of aggregate, formula, expression")
        if self.aggregate is not None and self.over not in FRAMES:
            raise SpecError(f"metric {self.name!r}: {self.over!r} is not one of {FRAMES}")


def weighted_count(condition: Column) -> Column:
    """The number of judged cells that a condition takes, over ``judgements`` or ``collapsed``."""
    return F.coalesce(F.sum(F.when(condition, F.col("pairs"))), F.lit(0))


def cell_mismatches(pairs: Sequence[CellPair]) -> Column:
    """Mismatching cells of a key."""
    per_mapping = [F.col("pairs") - F.col(f"m{p.index}") for p in pairs]
    return reduce(lambda x, y: x + y, per_mapping) if pairs else F.lit(0).cast("bigint")


def cell_matches(pairs: Sequence[CellPair]) -> Column:
    agreeing = [F.col(f"m{p.index}") for p in pairs]
    return reduce(lambda x, y: x + y, agreeing) if pairs else F.lit(0).cast("bigint")


def _total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def builtin_metrics(
    kept_a: Column, kept_b: Column, pairs: Sequence[CellPair]
) -> dict[str, Metric]:
    """The built-in scalars, by name."""
    in_a, in_b = F.col("n_a") > 0, F.col("n_b") > 0
    compared = (F.col("pairs") > 0) if pairs else F.lit(False)
    full = compared & (cell_mismatches(pairs) == 0)
    rows = F.count(F.lit(1))

    def rate(m: Mapping[str, Column]) -> Column:
        return round2(safe_divide(m["full_match_count"], m["total_compared_keys"]) * 100)

    metrics = (
        Metric("total_rows_a", "source_a", rows),
        Metric("total_rows_b", "source_b", rows),
        Metric("rows_filtered_a", "source_a", F.count_if(kept_a)),
        Metric("rows_filtered_b", "source_b", F.count_if(kept_b)),
        Metric("matched_keys", "cells", F.count_if(in_a & in_b)),
        Metric("only_in_a", "cells", F.count_if(in_a & ~in_b)),
        Metric("only_in_b", "cells", F.count_if(in_b & ~in_a)),
        Metric("full_match_count", "cells", F.count_if(full)),
        Metric("total_mismatches", "cells", _total(cell_mismatches(pairs))),
        Metric(
            "total_compared_keys",
            formula=lambda m: m["matched_keys"],
            depends_on=("matched_keys",),
        ),
        Metric(
            "mismatch_count",
            formula=lambda m: m["total_compared_keys"] - m["full_match_count"],
            depends_on=("full_match_count", "total_compared_keys"),
        ),
        Metric(
            "match_rate_percent",
            formula=rate,
            depends_on=("full_match_count", "total_compared_keys"),
        ),
    )
    return {metric.name: metric for metric in metrics}


# Metrics that are tables of their own and not one value (fixed names).
TABLE_METRICS = (
    "per_column_stats",
    "high_risk_mismatches",
    "mismatches_by_column",
    "filter_breakdown",
)


def parse_request(entry: Any) -> Metric | str | None:
    """An entry of a report section: a name, an expression, or a caller's metric."""
    if isinstance(entry, Metric):
        return entry
    if isinstance(entry, str):
        return entry.strip() or None
    if not isinstance(entry, Mapping) or not str(entry.get("name", "")).strip():
        return None
    name = entry["name"].strip()
    if "expression" in entry:
        text = entry["expression"]
        if not isinstance(text, str) or not text.strip():
            return None
        return Metric(name, expression=text.strip(), depends_on=tuple(names_in(text)))
    if "plugin" in entry:
        plugin = entry["plugin"]
        if isinstance(plugin, Metric):
            return plugin
        compute = getattr(plugin, "compute", None)
        if not callable(compute):
            raise SpecError(f"metric {name!r}: plugin has no compute function")
        needs = entry.get("depends_on", getattr(plugin, "depends_on", ()))
        return Metric(name, formula=compute, depends_on=tuple(needs))
    return name


def resolve(
    entries: Sequence[Any], known: Mapping[str, Metric]
) -> tuple[list[str], list[str], list[Metric]]:
    """Requested scalars, requested tables, and all metrics needed in a workable order."""
    requested: dict[str, Metric] = {}
    tables: list[str] = []
    for entry in entries:
        found = parse_request(entry)
        if found is None:
            continue
        name = found if isinstance(found, str) else found.name
        if name in requested or name in tables:
            raise SpecError(f"metric {name!r} is defined more than once")
        if isinstance(found, str) and name in TABLE_METRICS:
            tables.append(name)
            continue
        if isinstance(found, str) and name not in known:
            raise SpecError(f"unknown metric {name!r}; known: {sorted(known)}")
        requested[name] = known[name] if isinstance(found, str) else found
    needed = dict(requested)
    waiting = list(requested.values())
    while waiting:
        metric = waiting.pop()
        for name in metric.depends_on:
            if name in needed:
                continue
            if name not in known:
                raise SpecError(f"metric {metric.name!r} needs unknown metric {name!r}")
            needed[name] = known[name]
            waiting.append(known[name])
    try:
        order = TopologicalSorter({n: m.depends_on for n, m in needed.items()}).static_order()
        ordered = [needed[name] for name in order]
    except CycleError as exc:
        raise SpecError(f"metrics depend on each other in a circle: {exc.args[1]}") from exc
    return list(requested), tables, ordered


def one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Several one-row tables side by side."""
    if len(parts) == 1:
        return parts[0]
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return stacked.agg(*(F.first(c, ignorenulls=True).alias(c) for c in stacked.columns))


def metrics_row(
    spark: SparkSession,
    requested: Sequence[str],
    ordered: Sequence[Metric],
    frame: Callable[[str], DataFrame],
) -> DataFrame:
    """One row with the requested metrics as columns."""
    by_frame: dict[str, list[Metric]] = {}
    for metric in ordered:
        if metric.aggregate is not None:
            by_frame.setdefault(metric.over, []).append(metric)
    parts = [
        frame(over).agg(*(m.aggregate.alias(m.name) for m in metrics))
        for over, metrics in by_frame.items()
    ]
    df = one_row(parts) if parts else spark.range(1).select()
    for metric in ordered:
        if metric.aggregate is None:
            df = df.withColumn(metric.name, _formula(metric, df))
    return df.select(*requested)


def _formula(metric: Metric, df: DataFrame) -> Column:
    columns = {name: F.col(name) for name in metric.depends_on}
    if metric.formula is not None:
        return metric.formula(columns)
    known = {}
    for name, column in columns.items():
        kind = kind_of(df.schema[name].dataType)
        if kind is None:
            raise SpecError(f"metric {name!r} is not a single value")
        known[name] = Typed(column, kind)
    return to_column(metric.expression, known)


# -- tables -----------------------------------------------------------------


def per_column(cells: DataFrame, pairs: Sequence[CellPair]) -> DataFrame:
    """Agreeing and disagreeing cells per label; mappings with one label are one row."""
    schema = "column string, matched bigint, mismatched bigint, total_compared bigint"
    if not pairs:
        empty = cells.sparkSession.createDataFrame([], schema)
        return empty.withColumn("match_rate_percent", F.lit(0.0))
    sums = cells.agg(
        _total(F.col("pairs")).alias("pairs"),
        *(_total(F.col(f"m{p.index}")).alias(f"m{p.index}") for p in pairs),
    )
    per_mapping = sums.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(p.mapping.label).alias("column"),
                        F.col(f"m{p.index}").alias("matched"),
                        F.col("pairs").alias("total_compared"),
                    )
                    for p in pairs
                )
            )
        )
    ).filter(F.col("total_compared") > 0)
    labels = per_mapping.groupBy("column").agg(
        F.sum("matched").alias("matched"), F.sum("total_compared").alias("total_compared")
    )
    return labels.select(
        "column",
        "matched",
        (F.col("total_compared") - F.col("matched")).alias("mismatched"),
        "total_compared",
        round2(safe_divide(F.col("matched"), F.col("total_compared")) * 100).alias(
            "match_rate_percent"
        ),
    )


def mismatches_by_column(breakdown: DataFrame) -> DataFrame:
    """Labels with mismatches and their number, most first; one row per label."""
    found = breakdown.filter(F.col("mismatched") > 0)
    return found.select("column", F.col("mismatched").alias("mismatches")).orderBy(
        F.desc("mismatches"), "column"
    )


def high_risk(cells: DataFrame, pairs: Sequence[CellPair], threshold: int = HIGH_RISK) -> DataFrame:
    """Keys with at least ``threshold`` mismatching cells."""
    return cells.select("key", cell_mismatches(pairs).alias("mismatches")).filter(
        F.col("mismatches") >= threshold
    )


def rate_band(rate: Column) -> Column:
    """The rate as high, medium or low."""
    return (
        F.when(rate >= HIGH_RATE, F.lit("high"))
        .when(rate >= MEDIUM_RATE, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def summary_counts(cells: DataFrame, pairs: Sequence[CellPair]) -> DataFrame:
    """The per-key part of the summary, where the compared keys are those with details.

    With nothing compared the rate is 100 here and 0 in ``match_rate_percent``.
    """
    in_a, in_b = F.col("n_a") > 0, F.col("n_b") > 0
    compared = (F.col("pairs") > 0) if pairs else F.lit(False)
    return cells.agg(
        F.count_if(compared).alias("compared"),
        F.count_if(compared & (cell_mismatches(pairs) == 0)).alias("full"),
        F.count_if(in_a & ~in_b).alias("only_a"),
        F.count_if(in_b & ~in_a).alias("only_b"),
        _total(cell_matches(pairs)).alias("matches"),
        _total(cell_mismatches(pairs)).alias("mismatches"),
    )


def summary(counts: DataFrame) -> DataFrame:
    """``(position, metric, value)`` from one row of counts."""
    rate = F.when(F.col("compared") == 0, F.lit(100.0)).otherwise(
        round2(safe_divide(F.col("full"), F.col("compared")) * 100)
    )
    values = {name: F.col(name) for name in counts.columns}
    values |= {"with_mismatches": F.col("compared") - F.col("full"), "rate": rate}
    entries = F.array(
        *(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(label).alias("metric"),
                values[name].cast("string").alias("value"),
            )
            for i, (name, label) in enumerate(messages.SUMMARY_LABELS.items(), start=1)
        )
    )
    return counts.select(F.inline(entries))
