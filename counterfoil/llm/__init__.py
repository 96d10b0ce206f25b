"""Operators for preparing training text: deduplication, scans, quality, tokens, packing, extraction.

Nothing else in the library imports this folder. All operators share these rules: a null
text counts as an empty one, extra input columns are ignored, an empty table gives an empty
result with the same columns, and repeated rows are separate rows.
"""
