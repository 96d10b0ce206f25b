"""Reconciliation of two tables on Spark: filter, normalise, join, compare, report."""

from .errors import SourceError, SpecError
from .operators.metrics import Metric, weighted_count
from .operators.normalize import elementwise
from .plans import Recon, Report, reconcile, run_job
from .sources import as_string_table, damaged_cells, decode_audit, profile, read_delimited, read_source
from .spec import ReconSpec

__all__ = [
    "Metric",
    "Recon",
    "ReconSpec",
    "Report",
    "SourceError",
    "SpecError",
    "as_string_table",
    "damaged_cells",
    "decode_audit",
    "elementwise",
    "profile",
    "read_delimited",
    "read_source",
    "reconcile",
    "run_job",
    "weighted_count",
]
