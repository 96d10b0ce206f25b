"""Cell normalisation: cleaning, aliases, column parsing, caller's functions.

The job becomes a list of steps; each step is one projection that rewrites some
columns. ``normalize`` runs the projections, which Catalyst merges and prunes to
the columns that are used. ``normalization_audit`` runs the same projections and
carries counters of changed cells along, summed in one aggregate.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import messages
from ..functions import (
    col,
    collapse_spaces,
    fixed_width,
    list_source,
    nz,
    parse_array,
    strip,
    title_case,
)
from ..spec import AliasGroup, Cleaning, ColumnRule, ReconSpec, UserNormalizer

# Up to this many aliases the lookup is a literal map in the projection, above
# it a join; the list comes from the job, so its size is known beforehand.
LITERAL_ALIASES = 500
# A lookup is sent to every task while all its copies, one per column, stay below this.
BROADCAST_BYTES = 64 * 1024 * 1024

LOG_SCHEMA = (
    "step int, stage string, source string, action string, column string, status string, "
    "cells_transformed bigint, rules_applied string, groups_applied int, message string"
)
CASES = {"lower": F.lower, "upper": F.upper, "title": title_case}


@dataclass
class Step:
    """One projection and what the log says about it.

    ``prepare`` adds helper columns, which the projection drops again.
    """

    action: str
    rewrite: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    changed: Callable[[str, Column, Column], Column] | None = None
    prepare: Callable[[DataFrame], DataFrame] | None = None
    log: dict[str, Any] = field(default_factory=dict)
    silent_at_zero: bool = False
    shadows: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


def _differs(_: str, before: Column, after: Column) -> Column:
    return (~before.eqNullSafe(after)).cast("bigint")


def _text_differs(_: str, before: Column, after: Column) -> Column:
    """Change of the printed text, where a null cell prints as ``nan``."""
    return (F.coalesce(before, F.lit("nan")) != F.coalesce(after, F.lit("nan"))).cast("bigint")


# -- cleaning ---------------------------------------------------------------


def cleaning_steps(columns: Sequence[str], rules: Cleaning) -> list[Step]:
    """Null fill, trim and case, counted together as one action."""
    log = {"rules_applied": str(list(rules.rules))}

    def fill(c: Column) -> Column:
        if rules.preserve_nan_text:
            return nz(c)
        return F.when(c.isNull() | (c == "nan"), F.lit("")).otherwise(c)

    def filled(_: str, before: Column, after: Column) -> Column:
        return before.isNull().cast("bigint") if rules.remove_nulls else F.lit(0).cast("bigint")

    passes = [(fill, filled)]
    if rules.trim_whitespace:
        passes.append((strip, _differs))
    if rules.collapse_whitespace:
        passes.append((collapse_spaces, _differs))
    if rules.null_tokens or rules.null_value:
        tokens = ["", *rules.null_tokens]
        passes.append(
            (lambda c: F.when(c.isin(tokens), F.lit(rules.null_value)).otherwise(c), _differs)
        )
    if rules.case_normalize in CASES:
        passes.append((CASES[rules.case_normalize], _differs))
    return [
        Step("global_cleaning", {name: rewrite for name in columns}, changed, None, log, True)
        for rewrite, changed in passes
    ]


# -- aliases ----------------------------------------------------------------


def resolve_aliases(groups: Sequence[AliasGroup]) -> dict[str, tuple[str, int, str]]:
    """Alias to (shown text, replacements, canonical name) after all groups in turn.

    A later group sees the text that an earlier one wrote. Following each alias
    through the groups once gives a single lookup with the same outcome.
    """
    lookups = [(group, group.lookup()) for group in groups]
    resolved = {}
    for alias in {alias for _, lookup in lookups for alias in lookup}:
        current, text, name, count = alias, "", "", 0
        for group, lookup in lookups:
            if current in lookup:
                text, name, count = group.shown(lookup[current]), group.name, count + 1
                current = text.strip().lower()
        resolved[alias] = (text, count, name)
    return resolved


def _scopes(
    columns: Sequence[str], groups: Sequence[AliasGroup], logical: dict[str, Any]
) -> dict[tuple[int, ...], list[str]]:
    """Columns by the groups that apply to them."""

    def targets(group: AliasGroup) -> Iterable[str]:
        if group.columns is None:
            return columns
        physical = (logical.get(name, name) for name in group.columns)
        return {p for entry in physical for p in ([entry] if isinstance(entry, str) else entry)}

    wanted = [set(targets(group)) for group in groups]
    scopes: dict[tuple[int, ...], list[str]] = {}
    for name in columns:
        applying = tuple(i for i, target in enumerate(wanted) if name in target)
        if applying:
            scopes.setdefault(applying, []).append(name)
    return scopes


def _alias_key(c: Column) -> Column:
    return F.lower(strip(c))


def alias_steps(
    spark: SparkSession,
    columns: Sequence[str],
    groups: Sequence[AliasGroup],
    logical: dict[str, Any],
    shadows: Sequence[str] = (),
) -> list[Step]:
    steps = []
    for applying, names in _scopes(columns, groups, logical).items():
        resolved = resolve_aliases([groups[i] for i in applying])
        if not resolved:
            continue
        build = _literal_alias_step if len(resolved) <= LITERAL_ALIASES else _joined_alias_step
        steps.append(build(spark, names, resolved, [n for n in shadows if n in names]))
    for step in steps:
        step.silent_at_zero = True
        step.log = {"groups_applied": len(groups)}
    return steps


def _literal_alias_step(_, names, resolved, shadows) -> Step:
    keys = list(resolved)

    def pick(part: int) -> Callable[[Column], Column]:
        lookup = F.create_map(*(F.lit(x) for k in keys for x in (k, resolved[k][part])))
        # The membership test is a hash probe, so that only cells that are
        # aliases pay for the search in the map.
        return lambda c: F.when(
            _alias_key(c).isin(keys), F.try_element_at(lookup, _alias_key(c))
        )

    text, count, name = pick(0), pick(1), pick(2)
    return Step(
        "alias_groups",
        {n: lambda c: F.coalesce(text(c), c) for n in names},
        lambda _, before, after: F.coalesce(count(before), F.lit(0)).cast("bigint"),
        shadows={n: lambda c: F.coalesce(name(c), c) for n in shadows},
    )


def _joined_alias_step(spark, names, resolved, shadows) -> Step:
    schema = "alias string, text string, count int, name string"
    lookup = spark.createDataFrame([(k, *v) for k, v in resolved.items()], schema)
    size = sum(2 * (len(k) + len(v[0]) + len(v[2])) + 64 for k, v in resolved.items())

    def helper(name: str, part: str) -> str:
        return f"__alias_{part}_{name}"

    def join(df: DataFrame) -> DataFrame:
        for name in names:
            side = lookup.select(*(col(p).alias(helper(name, p)) for p in lookup.columns))
            if size * len(names) <= BROADCAST_BYTES:
                side = F.broadcast(side)
            df = df.join(side, _alias_key(col(name)) == col(helper(name, "alias")), "left")
        return df

    def taken(name: str, part: str) -> Callable[[Column], Column]:
        return lambda c: F.coalesce(col(helper(name, part)), c)

    return Step(
        "alias_groups",
        {n: taken(n, "text") for n in names},
        lambda name, before, after: F.coalesce(col(helper(name, "count")), F.lit(0)).cast("bigint"),
        join,
        shadows={n: taken(n, "name") for n in shadows},
    )


# -- column rules and caller's functions ------------------------------------


def column_step(rule: ColumnRule, columns: Sequence[str]) -> Step | None:
    if rule.column not in columns:
        message = messages.COLUMN_RULE_SKIPPED.format(column=rule.column)
        log = {"column": rule.column, "status": "warning", "message": message}
        return Step("column_specific", log=log)
    log = {"column": rule.column}
    if rule.array_parse:

        def array_changed(_: str, before: Column, after: Column) -> Column:
            # The list prints as ``[]`` at best, so any other text counts.
            return (F.coalesce(before, F.lit("nan")) != "[]").cast("bigint")

        helper = f"__list_source_{rule.column}"

        def add_source(df: DataFrame) -> DataFrame:
            return df.select("*", list_source(col(rule.column)).alias(helper))

        rewrite = {rule.column: lambda c: parse_array(c, col(helper))}
        return Step("array_parse", rewrite, array_changed, add_source, log)
    if rule.lengths is not None:
        lengths = rule.lengths
        rewrite = {rule.column: lambda c: fixed_width(c, lengths)}
        return Step("fixed_length_parse", rewrite, _text_differs, log=log)
    return None


def as_column_function(function: Any) -> Callable[[Column], Column]:
    """A caller's normaliser as a function on columns.

    Taken are: a function from Column to Column, a (pandas) UDF, and a class or
    object whose ``normalize`` maps a pandas Series to a Series of the same
    length cell by cell; the last runs as a vectorised UDF on Arrow batches, so it
    must not look at other cells. What depends on the whole column has ``fit`` and
    ``apply``; see ``fitted_step``.
    """
    target = function() if inspect.isclass(function) else function
    if hasattr(target, "normalize"):

        def run(cells: pd.Series) -> pd.Series:
            return target.normalize(cells)

        return F.pandas_udf(run, T.StringType())
    if callable(target):
        return target
    raise TypeError(f"{function!r} is neither callable nor has a normalize method")


def elementwise(function: Callable[[Any], Any]) -> Callable[[Column], Column]:
    """A function on single values as a normaliser, run on Arrow batches."""

    def run(cells: pd.Series) -> pd.Series:
        return cells.map(function)

    return F.pandas_udf(run, T.StringType())


def user_steps(entry: UserNormalizer, columns: Sequence[str]) -> list[Step]:
    """The caller's function; one that cannot be set up is logged and left out."""
    names = [n for n in columns if entry.columns is None or n in entry.columns]
    log = {"column": None, "rules_applied": entry.name}
    try:
        target = entry.function() if inspect.isclass(entry.function) else entry.function
        if hasattr(target, "fit"):
            return [fitted_step(target, name, {**log, "column": name}) for name in names]
        apply = as_column_function(target)
        for name in names:
            if not isinstance(apply(col(name)), Column):
                raise TypeError(f"'{entry.name}' does not give a Column")
    except Exception as exc:
        message = f"Failed to set up custom normalizer '{entry.name}': {exc}"
        return [Step("custom_normalizer", log={**log, "status": "error", "message": message})]
    return [Step("custom_normalizer", {n: apply for n in names}, _printed_differs, log=log)]


def fitted_step(target: Any, name: str, log: dict) -> Step:
    """A normaliser that looks at its whole column: ``fit`` once, then ``apply`` cell by cell.

    ``fit`` gets a table whose only column ``cell`` holds the column as the steps before left it,
    and gives a table of one row. ``apply`` gets a cell and that row as a struct, or null
    where ``fit`` gave none. Both are plans, so the row is found by the whole cluster and does not depend on how the
    rows lie; it is a scalar subquery and reaches the tasks as one value.
    """
    if not callable(getattr(target, "apply", None)):
        raise TypeError(f"{target!r} has fit but no apply method")
    helper = f"__fitted_{name}"

    def add_fitted(df: DataFrame) -> DataFrame:
        row = target.fit(df.select(col(name).alias("cell")))
        return df.select("*", row.select(F.struct("*")).scalar().alias(helper))

    rewrite = {name: lambda c: target.apply(c, col(helper))}
    return Step("custom_normalizer", rewrite, _printed_differs, add_fitted, log)


def _printed_differs(_: str, before: Column, after: Column) -> Column:
    return _text_differs(_, before.cast("string"), after.cast("string"))


# -- the whole job ----------------------------------------------------------


def plan_steps(
    spark: SparkSession,
    spec: ReconSpec,
    columns: Sequence[str],
    shadows: Sequence[str] = (),
    all_columns: Sequence[str] | None = None,
) -> list[Step]:
    """Steps for ``columns`` of a source that has ``all_columns``."""
    steps: list[Step] = []
    if spec.cleaning is not None:
        steps += cleaning_steps(columns, spec.cleaning)
    steps += alias_steps(spark, columns, spec.alias_groups, spec.logical_columns, shadows)
    present = all_columns or columns
    for rule in spec.column_rules:
        if rule.column in columns or rule.column not in present:
            step = column_step(rule, columns)
            steps += [step] if step else []
    for entry in spec.user_normalizers:
        steps += user_steps(entry, columns)
    return steps


def shadow_name(column: str) -> str:
    return f"__canonical_{column}"


def normalize(
    df: DataFrame,
    spec: ReconSpec,
    columns: Sequence[str] | None = None,
    canonical: Sequence[str] = (),
) -> DataFrame:
    """The table with every cell normalised, or only the named columns of it.

    For the columns in ``canonical`` a second column holds the canonical name of
    the alias group instead of the shown text.
    """
    names = [n for n in df.columns if columns is None or n in columns]
    extra: list[str] = []
    pending = [n for n in canonical if n in names]
    for step in plan_steps(df.sparkSession, spec, names, pending, df.columns):
        if not step.rewrite:
            continue
        source = step.prepare(df) if step.prepare else df
        shadowed = {shadow_name(n): f(col(n)) for n, f in step.shadows.items()}
        df = source.select(
            *(step.rewrite.get(n, lambda c: c)(col(n)).alias(n) for n in names),
            *(col(n) for n in extra),
            *(c.alias(n) for n, c in shadowed.items()),
        )
        extra += list(shadowed)
    plain = [shadow_name(n) for n in pending if shadow_name(n) not in extra]
    return df.select(
        *(col(n) for n in names + extra),
        *(col(n.removeprefix("__canonical_")).alias(n) for n in plain),
    )


def normalization_audit(df: DataFrame, spec: ReconSpec, source: str) -> DataFrame:
    """Changed cells per step over all columns, from one pass over the rows."""
    names = list(df.columns)
    entries: list[tuple[Step, str | None]] = []
    counters: list[str] = []
    for step in plan_steps(df.sparkSession, spec, names):
        merge = bool(entries) and step.silent_at_zero and entries[-1][0].action == step.action
        if not merge:
            counter = f"__n{len(counters)}" if step.rewrite else None
            entries.append((step, counter))
            if counter:
                counters.append(counter)
        if not step.rewrite:
            continue
        counter = entries[-1][1]
        held = counters if merge else counters[:-1]
        source_df = step.prepare(df) if step.prepare else df
        after = {n: f(col(n)) for n, f in step.rewrite.items()}
        moved = sum(
            (step.changed(n, col(n), new) for n, new in after.items()), F.lit(0).cast("bigint")
        )
        start = F.col(counter) if merge else F.lit(0).cast("bigint")
        df = source_df.select(
            *(after.get(n, col(n)).alias(n) for n in names),
            *(F.col(c) for c in held if c != counter),
            (start + moved).alias(counter),
        )
    schema = T.StructType.fromDDL(LOG_SCHEMA)
    if not entries:
        return df.sparkSession.createDataFrame([], schema)
    totals = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters),
    )
    rows = [_log_entry(i, step, source, counter, schema) for i, (step, counter) in enumerate(entries)]
    silent = [i for i, (step, _) in enumerate(entries) if step.silent_at_zero]
    log = totals.select(F.inline(F.array(*rows)))
    return log.filter(~F.col("step").isin(silent) | (F.col("cells_transformed") > 0)).to(schema)


def _log_entry(
    i: int, step: Step, source: str, counter: str | None, schema: T.StructType
) -> Column:
    values = {"status": "applied", **step.log, "step": i, "stage": "normalize"}
    values |= {"source": source, "action": step.action}
    return F.struct(
        *(
            (
                F.col(counter)
                if f.name == "cells_transformed" and counter
                else F.lit(values.get(f.name))
            )
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        )
    )
