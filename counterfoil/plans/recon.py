"""A reconciliation of two string tables as a set of lazy DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import messages
from ..errors import SpecError
from ..functions import col, java_pattern, list_text
from ..operators import cells as cell_ops
from ..operators import compare as cmp
from ..operators import filters as flt
from ..operators import keys as key_ops
from ..operators import metrics as met
from ..operators import normalize as nrm
from ..sources import profile, read_source
from ..spec import ColumnMapping, ReconSpec
from .storage import drop, keep, new_path

ERROR_SCHEMA = "stage string, error_type string, column string, source string, message string"


class Recon:
    """Two sources and a job; every property and method is a DataFrame to act on.

    Nothing is read before an action, with three exceptions that look at the data
    to choose a plan: patterns are tried on a constant, an outer comparison asks
    whether a side is empty, and the per-key counts ask how many keys repeat.
    """

    def __init__(
        self,
        source_a: DataFrame,
        source_b: DataFrame,
        spec: ReconSpec,
        metrics: Sequence[met.Metric] = (),
        count_type: str = "bigint",
    ) -> None:
        self.source_a = source_a
        self.source_b = source_b
        self.spec = spec
        self.user_metrics = tuple(metrics)
        self.count_type = count_type
        self.spark: SparkSession = source_a.sparkSession
        self._kept: list[str] = []
        spec_keys = ((source_a, spec.key_a, "A"), (source_b, spec.key_b, "B"))
        for df, key, side in spec_keys:
            if key not in df.columns:
                raise SpecError(f"key column {key!r} not found in source {side}: {df.columns}")
        flt.check_patterns(self.spark, self._patterns())

    def _patterns(self) -> list[str]:
        rules = [*self.spec.filters_a, *self.spec.filters_b]
        full = [java_pattern(str(r.value)) for r in rules if r.operator == "matches_regex"]
        found = [java_pattern(m.pattern, full=False) for m in self.spec.mappings if m.pattern]
        return full + found

    # -- tables along the way -----------------------------------------------

    @cached_property
    def filtered_a(self) -> DataFrame:
        return flt.apply_filters(self.source_a, self.spec.filters_a)

    @cached_property
    def filtered_b(self) -> DataFrame:
        return flt.apply_filters(self.source_b, self.spec.filters_b)

    def normalized_a(self, columns: Sequence[str] | None = None) -> DataFrame:
        return nrm.normalize(self.filtered_a, self.spec, columns)

    def normalized_b(self, columns: Sequence[str] | None = None) -> DataFrame:
        return nrm.normalize(self.filtered_b, self.spec, columns)

    @cached_property
    def live_mappings(self) -> list[tuple[int, ColumnMapping]]:
        """Mappings whose columns both sides have; the others are in the error log."""
        return [
            (i, m)
            for i, m in enumerate(self.spec.mappings)
            if m.column_a in self.source_a.columns and m.column_b in self.source_b.columns
        ]

    @cached_property
    def _sides(self) -> tuple[DataFrame, DataFrame]:
        """Both sides normalised, with the key and the mapped columns only."""
        live = [m for _, m in self.live_mappings]
        canonical = [m for m in live if m.compare_on == "canonical"]
        spec = self.spec
        return (
            nrm.normalize(
                self.filtered_a,
                spec,
                [spec.key_a, *(m.column_a for m in live)],
                [m.column_a for m in canonical],
            ),
            nrm.normalize(
                self.filtered_b,
                spec,
                [spec.key_b, *(m.column_b for m in live)],
                [m.column_b for m in canonical],
            ),
        )

    @cached_property
    def pairs(self) -> list[cmp.CellPair]:
        a, b = self._sides
        return cmp.cell_pairs(self.live_mappings, a.schema, b.schema)

    @cached_property
    def join_type(self) -> str:
        """The join of the comparison; an empty side leaves nothing to compare."""
        if self.spec.join_type == "inner":
            return "inner"
        empty = self.filtered_a.isEmpty() or self.filtered_b.isEmpty()
        return "inner" if empty else self.spec.join_type

    # -- keys ---------------------------------------------------------------

    @property
    def key_counts(self) -> DataFrame:
        """``(key, n_a, n_b)``; taken from the per-key table when that is stored already."""
        if "key_cells" in self.__dict__:
            return self.key_cells.select("key", "n_a", "n_b")
        a = nrm.normalize(self.filtered_a, self.spec, [self.spec.key_a])
        b = nrm.normalize(self.filtered_b, self.spec, [self.spec.key_b])
        return key_ops.key_counts(
            a.select(col(self.spec.key_a).alias("key")), b.select(col(self.spec.key_b).alias("key"))
        )

    def key_status(self) -> DataFrame:
        return key_ops.key_status(self.key_counts)

    def unmatched(self) -> DataFrame:
        return key_ops.unmatched(self.key_counts)

    def duplicate_keys(self, side: str, stage: str = "normalized") -> DataFrame:
        """Repeated keys of side ``a`` or ``b``: ``raw`` as read, or ``normalized``."""
        spec = self.spec
        if stage == "raw":
            df = self.source_a if side == "a" else self.source_b
            columns = key_ops.raw_key_columns(df, spec.key_a, spec.key_b)
            return key_ops.duplicate_keys(df, columns, nulls=True)
        key, df = (spec.key_a, self.filtered_a) if side == "a" else (spec.key_b, self.filtered_b)
        return key_ops.duplicate_keys(nrm.normalize(df, spec, [key]), [key], nulls=False)

    # -- cells --------------------------------------------------------------

    def _joined(self, collapse: bool) -> DataFrame:
        a, b = self._sides
        return cmp.joined_rows(
            a, b, self.spec.key_a, self.spec.key_b, self.pairs, self.join_type, collapse
        )

    def details(self, mismatches_only: bool = False, collapse: bool = False) -> DataFrame:
        """One row per joined row and mapping.

        ``collapse`` counts identical rows of a side first and shows each
        judgement once, with the number of row pairs it stands for.
        """
        if not self.pairs:
            return cmp.empty_details(self.source_a)
        return cmp.details(self._joined(collapse), self.pairs, mismatches_only)

    def judgements(self) -> DataFrame:
        """The details counted per key, mapping and judgement (``pairs``), without making a pair of rows."""
        if not self.pairs:
            return cmp.empty_details(self.source_a).select(
                "key", "mapping_idx", "column", "status", "diff_type", F.lit(0).cast(self.count_type).alias("pairs")
            )
        a, b = self._sides
        spec = self.spec
        return cell_ops.judgements(a, b, spec.key_a, spec.key_b, self.pairs, self.key_cells, self.count_type)

    def mismatches(self, collapse: bool = False) -> DataFrame:
        return self.details(mismatches_only=True, collapse=collapse)

    @cached_property
    def key_cells(self) -> DataFrame:
        """Per key: rows per side, joined rows, and agreeing rows per mapping."""
        a, b = self._sides
        return cell_ops.build_key_cells(
            a,
            b,
            self.spec.key_a,
            self.spec.key_b,
            self.pairs,
            self.join_type,
            self._keep,
            self.count_type,
        )

    def stored(self, df: DataFrame) -> DataFrame:
        """The rows, stored until ``close``."""
        return self._keep(df)

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(new_path(self.spark))
        return keep(df, self._kept[-1])

    def close(self) -> None:
        """Remove the stored tables; what was built on them can't be read any more."""
        for path in self._kept:
            drop(self.spark, path)
        self._kept.clear()
        self.__dict__.pop("key_cells", None)

    def __enter__(self) -> Recon:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # -- metrics ------------------------------------------------------------

    @cached_property
    def known_metrics(self) -> dict[str, met.Metric]:
        kept_a = flt.all_rules(self.source_a, self.spec.filters_a)
        kept_b = flt.all_rules(self.source_b, self.spec.filters_b)
        known = met.builtin_metrics(kept_a, kept_b, self.pairs)
        for metric in self.user_metrics:
            if metric.name in known or metric.name in met.TABLE_METRICS:
                raise SpecError(f"metric {metric.name!r} is defined more than once")
            known[metric.name] = metric
        return known

    def _frame(self, name: str) -> DataFrame:
        if name == "cells":
            return self.key_cells
        if name == "keys":
            return self.key_status()
        if name == "details":
            return self.details()
        if name == "collapsed":
            return self.details(collapse=True)
        if name == "judgements":
            return self.judgements()
        return getattr(self, name)

    def metrics(self, entries: Sequence[Any] | None = None) -> DataFrame:
        """One row of scalar metrics; by default those that the report asks for.

        Entries are names, ``{"name", "expression"}`` mappings or ``Metric``s.
        Metrics that are tables are left to ``metric_tables``.
        """
        if entries is None:
            entries = self.spec.requested_stats() or list(self.known_metrics)
        requested, _, ordered = met.resolve(entries, self.known_metrics)
        return met.metrics_row(self.spark, requested, ordered, self._frame)

    def metric_tables(self, entries: Sequence[Any] | None = None) -> dict[str, DataFrame]:
        """The requested metrics that are tables, by name."""
        if entries is None:
            entries = self.spec.requested_stats() or list(met.TABLE_METRICS)
        _, tables, _ = met.resolve(entries, self.known_metrics)
        build = {
            "per_column_stats": self.per_column,
            "high_risk_mismatches": self.high_risk,
            "mismatches_by_column": self.mismatches_by_column,
            "filter_breakdown": self.filter_audit,
        }
        return {name: build[name]() for name in tables}

    def per_column(self) -> DataFrame:
        return met.per_column(self.key_cells, self.pairs)

    def mismatches_by_column(self) -> DataFrame:
        return met.mismatches_by_column(self.per_column())

    def high_risk(self, threshold: int = met.HIGH_RISK) -> DataFrame:
        return met.high_risk(self.key_cells, self.pairs, threshold)

    def summary(self) -> DataFrame:
        rows = F.count(F.lit(1))
        parts = [
            self.source_a.agg(rows.alias("rows_a")),
            self.source_b.agg(rows.alias("rows_b")),
            met.summary_counts(self.key_cells, self.pairs),
        ]
        return met.summary(met.one_row(parts))

    # -- logs ---------------------------------------------------------------

    def profile(self) -> DataFrame:
        return profile(self.source_a, self.source_b)

    def filter_audit(self) -> DataFrame:
        """Rows before and after each filter rule of both sources."""
        return flt.filter_audit(self.source_a, self.spec.filters_a, "source_a").unionByName(
            flt.filter_audit(self.source_b, self.spec.filters_b, "source_b")
        )

    def filter_log(self) -> DataFrame:
        """The filter audit with the warnings on repeated keys."""
        parts = [self._raw_duplicates("a"), self._raw_duplicates("b"), self.filter_audit()]
        parts += [self._normalized_duplicates("a"), self._normalized_duplicates("b")]
        return reduce(DataFrame.unionByName, parts)

    def _raw_duplicates(self, side: str) -> DataFrame:
        df = self.source_a if side == "a" else self.source_b
        columns = key_ops.raw_key_columns(df, self.spec.key_a, self.spec.key_b)
        found = key_ops.sample_text(self.duplicate_keys(side, "raw"), columns, 5)
        message = F.format_string(
            messages.RAW_DUPLICATES, F.lit(side.upper()), F.col("repeated"), list_text(F.col("sample"))
        )
        return self._warning(found, "import", side, "duplicate_keys_warning", message)

    def _normalized_duplicates(self, side: str) -> DataFrame:
        key = self.spec.key_a if side == "a" else self.spec.key_b
        found = key_ops.sample_text(self.duplicate_keys(side), [key], 20)
        message = F.format_string(
            messages.DUPLICATES,
            F.lit(f"source_{side}"),
            F.lit(key),
            F.col("repeated"),
            list_text(F.col("sample")),
            F.when(F.col("repeated") > 20, F.lit(" ...")).otherwise(F.lit("")),
        )
        return self._warning(found, "compare", side, "duplicate_key_warning", message)

    @staticmethod
    def _warning(
        found: DataFrame, stage: str, side: str, action: str, message: Column
    ) -> DataFrame:
        return flt.log_row(
            found,
            stage,
            source=F.lit(f"source_{side}"),
            action=F.lit(action),
            status=F.lit("warning"),
            message=message,
        )

    def normalization_log(self) -> DataFrame:
        return nrm.normalization_audit(self.filtered_a, self.spec, "source_a").unionByName(
            nrm.normalization_audit(self.filtered_b, self.spec, "source_b")
        )

    def error_log(self) -> DataFrame:
        """Mappings that were skipped because a side lacks their column."""
        rows = []
        for m in self.spec.mappings:
            for side, name, df in (("a", m.column_a, self.source_a), ("b", m.column_b, self.source_b)):
                if name not in df.columns:
                    message = messages.MAPPING_SKIPPED.format(
                        column=name, side=side.upper(), columns=df.columns, label=m.label
                    )
                    rows.append(("compare", "column_missing", name, side, message))
        return self.spark.createDataFrame(rows, ERROR_SCHEMA)


def reconcile(
    source_a: DataFrame, source_b: DataFrame, job: Any, **options: Any
) -> Recon:
    """Reconcile two string tables; ``job`` is a ``ReconSpec`` or its mapping."""
    spec = job if isinstance(job, ReconSpec) else ReconSpec.from_dict(job)
    return Recon(source_a, source_b, spec, **options)


def run_job(spark: SparkSession, job: Any, strict_rows: bool = True, **options: Any) -> Recon:
    """Read the two files of a job, check the columns it names, and reconcile them."""
    spec = job if isinstance(job, ReconSpec) else ReconSpec.from_dict(job)
    if set(spec.sources) != {"source_a", "source_b"}:
        raise SpecError("the job names no source files")
    a = read_source(spark, spec.sources["source_a"], strict=strict_rows).table
    b = read_source(spark, spec.sources["source_b"], strict=strict_rows).table
    spec.check(a.columns, b.columns)
    return Recon(a, b, spec, **options)
