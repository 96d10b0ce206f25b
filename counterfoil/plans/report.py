"""The report: one table per section, previews of them, and their sinks."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..functions import col
from ..messages import TITLES
from ..operators.metrics import rate_band
from ..spec import SECTIONS
from .recon import Recon

# Order of the rows of a section; the trailing columns of the mismatches only
# spread the rows of one key over the sorted output.
ORDER = {
    "summary": ("position",),
    "mismatch_details": ("key", "mapping_idx", "value_a", "value_b"),
    "unmatched_records": ("source", "key"),
    "per_column_breakdown": ("column",),
    "normalization_log": ("source", "step"),
    "filter_log": ("stage", "source", "rule_index"),
}
# Rows that a preview shows unless told otherwise (fixed values).
PREVIEW = {
    "unmatched_records": 100,
    "mismatch_details": 500,
    "normalization_log": 200,
    "filter_log": 200,
}
# Sections with as many rows as the job has rules, columns or metrics.
SMALL = ("summary", "per_column_breakdown", "normalization_log", "filter_log")


class Report:
    """Sections of a reconciliation by name."""

    def __init__(self, recon: Recon) -> None:
        self.recon = recon

    def section(self, name: str) -> DataFrame:
        build = {
            "summary": self.recon.summary,
            "mismatch_details": self.recon.mismatches,
            "unmatched_records": self.recon.unmatched,
            "per_column_breakdown": self.recon.per_column,
            "normalization_log": self.recon.normalization_log,
            "filter_log": self.recon.filter_log,
        }
        if name not in build:
            raise SpecError(f"unknown section {name!r}; known: {', '.join(SECTIONS)}")
        return build[name]()

    def preview(self, name: str, n: int | None = None) -> DataFrame:
        """The first ``n`` rows of a section in its order; finds them without a full sort.

        Without ``n`` as many as ``PREVIEW`` names for the section, else 100.
        """
        shown = PREVIEW.get(name, 100) if n is None else n
        return self.section(name).orderBy(*ORDER[name]).limit(shown)

    def size(self, name: str) -> DataFrame:
        """One row: how many rows the whole section has."""
        return self.section(name).agg(F.count(F.lit(1)).alias("rows"))

    def positions(self, name: str) -> DataFrame:
        """The rows of a section with their ``position`` (from 1) in its order, numbered by all tasks.

        The rows are dealt by ranges of the order and stored; each range counts on from the
        number of rows in the ranges before it, which is one row per range.
        """
        order = ORDER[name]
        dealt = self.section(name).repartitionByRange(*order).sortWithinPartitions(*order)
        kept = self.recon.stored(dealt.withColumn("_at", F.monotonically_increasing_id()))
        kept = kept.withColumn("_range", F.shiftright("_at", 33))
        ranges = kept.groupBy("_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        placed = kept.join(F.broadcast(ranges), "_range")  # a row per range, as many as tasks wrote
        position = F.col("_at") - F.col("_first") + F.col("_before") + 1
        return placed.withColumn("position", position).drop("_at", "_range", "_first", "_rows", "_before")

    def page(self, name: str, first: int, n: int) -> DataFrame:
        """Rows ``first`` to ``first + n - 1`` of a section in its order."""
        return self.positions(name).filter(F.col("position").between(first, first + n - 1))

    def banded_breakdown(self) -> DataFrame:
        """The per-column breakdown with its rate as high, medium or low."""
        breakdown = self.recon.per_column()
        return breakdown.withColumn("band", rate_band(F.col("match_rate_percent")))

    def write(
        self,
        folder: str,
        format: str = "csv",
        sections: Sequence[str] | None = None,
        ordered: bool = True,
    ) -> list[str]:
        """Write each enabled section as a dataset below ``folder``.

        Delimited files get titled columns, other formats all columns of the
        section as they are. Large sections are written by all tasks; ``ordered`` sorts them over the
        whole dataset, otherwise each file is sorted by itself, which saves one
        shuffle of the section.
        """
        paths = []
        for name in sections or self.recon.spec.enabled_sections():
            df = self.section(name)
            if name in SMALL:
                df = df.orderBy(*ORDER[name]).coalesce(1)
            elif ordered:
                df = df.orderBy(*ORDER[name])
            else:
                df = df.sortWithinPartitions(*ORDER[name])
            path = f"{folder}/{name}"
            if format == "csv":
                self._csv(_titled(df, name), path)
            else:
                df.write.mode("overwrite").format(format).save(path)
            paths.append(path)
        return paths

    def write_job(self, folder: str, skip_unbuilt: bool = False) -> list[str]:
        """Write what ``report.output`` of the job asks for, below ``folder``.

        Delimited files are datasets in a folder of the given name. The other
        formats are documents that one machine makes of finished tables and are
        not built: they are an error, or with ``skip_unbuilt`` a warning.
        """
        unbuilt = sorted({kind for kind, _ in self.recon.spec.outputs if kind != "csv"})
        if unbuilt:
            told = f"report formats {unbuilt} are not built; write the sections and render those"
            if not skip_unbuilt:
                raise SpecError(told)
            warnings.warn(told, stacklevel=2)
        names = [name for kind, name in self.recon.spec.outputs if kind == "csv"]
        return [path for name in names for path in self.write(f"{folder}/{name}")]

    @staticmethod
    def _csv(df: DataFrame, path: str) -> None:
        writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
        for side in ("ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace"):
            writer = writer.option(side, False)
        writer.option("emptyValue", "").csv(path)


def _titled(df: DataFrame, name: str) -> DataFrame:
    """Columns of the section under their titles; lists as JSON text."""
    titles = TITLES.get(name) or {c: c for c in df.columns}
    lists = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    return df.select(
        *((F.to_json(col(c)) if c in lists else col(c)).alias(t) for c, t in titles.items())
    )
