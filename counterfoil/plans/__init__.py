"""Whole jobs: the reconciliation of two tables and its report."""

from .recon import Recon, reconcile, run_job
from .report import Report

__all__ = ["Recon", "Report", "reconcile", "run_job"]
