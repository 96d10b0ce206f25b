"""Texts of the log entries (templates for ``format`` or ``format_string``) and of the report."""

NO_RULES = "nothing to filter in %s: all %d rows pass"
RULE_SKIPPED = "{source} lacks the column {column!r} of this rule, which lets every row pass; it has {columns}"
COLUMN_RULE_SKIPPED = "no column {column!r} to apply this rule to"
MAPPING_SKIPPED = "{label!r} is not compared: side {side} lacks {column!r}; it has {columns}"
RAW_DUPLICATES = "side %s as read: %d keys stand on several rows, among them %s"
DUPLICATES = "%s, key %s: %d keys stand on several rows and pair up with every partner, among them %s%s"
# Labels and column titles of the report (fixed values).
SUMMARY_LABELS = {
    "rows_a": "Total Rows (Source A)",
    "rows_b": "Total Rows (Source B)",
    "compared": "Keys Compared",
    "full": "Fully Matched Keys",
    "with_mismatches": "Keys with Mismatches",
    "only_a": "Only in Source A",
    "only_b": "Only in Source B",
    "matches": "Cell-Level Matches",
    "mismatches": "Cell-Level Mismatches",
    "rate": "Match Rate (%)",
}
TITLES = {
    "summary": {"metric": "Metric", "value": "Value"},
    "mismatch_details": {
        "key": "Key",
        "column": "Column",
        "value_a": "Value A",
        "value_b": "Value B",
        "diff_type": "Diff Type",
    },
    "unmatched_records": {"source": "Source", "key": "Key"},
    "per_column_breakdown": {
        "column": "Column",
        "matched": "Matched",
        "mismatched": "Mismatched",
        "total_compared": "Total",
        "match_rate_percent": "Match Rate %",
    },
}
