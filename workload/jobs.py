"""Jobs that the queries run, as the mappings a job file would hold."""

from __future__ import annotations

from typing import Any

ORDER_COLUMNS = (("status", "state"), ("priority", "prio"), ("price", "amount"), ("odate", "order_date"))
CLEAN_LOWER = {"trim_whitespace": True, "remove_nulls": True, "case_normalize": "lower"}
PRIORITY_ALIASES = (
    {
        "normalized_name": "top",
        "aliases": ["1-URGENT", "2-HIGH"],
        "display_format": "{normalized}({original})",
    },
    {"normalized_name": "rest", "aliases": ["4-Not Specified", "5-LOW"]},
)


def job(
    key: tuple[str, str],
    mappings: Any,
    join_type: str = "inner",
    filters: dict | None = None,
    rules: dict | None = None,
) -> dict[str, Any]:
    """A job mapping; mappings are column pairs or full entries."""
    entries = [
        m if isinstance(m, dict) else {"source_a": m[0], "source_b": m[1], "method": "exact"}
        for m in mappings
    ]
    return {
        "schema_version": "1.0",
        "compare": {
            "key_column": {"source_a": key[0], "source_b": key[1]},
            "join_type": join_type,
            "column_mappings": entries,
        },
        "pre_filters": filters or {},
        "normalization_rules": rules or {},
    }


def orders_job(**options: Any) -> dict[str, Any]:
    return job(("k", "order_ref"), ORDER_COLUMNS, **options)


def rule(column: str, operator: str, value: Any = None, action: str = "keep") -> dict[str, Any]:
    return {"column": column, "operator": operator, "value": value, "action": action}
