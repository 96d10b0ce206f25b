"""Operators of a reconciliation, each a plan over DataFrames."""
