"""Column-level building blocks: text, numbers and array cells."""

from .arrays import list_source, list_text, parse_array, set_text
from .numbers import number_text, round2, safe_divide, to_number
from .text import (
    WHITESPACE,
    blank,
    col,
    collapse_spaces,
    fixed_width,
    java_pattern,
    let,
    nz,
    segments,
    strip,
    title_case,
)

__all__ = [
    "WHITESPACE",
    "blank",
    "col",
    "collapse_spaces",
    "fixed_width",
    "java_pattern",
    "let",
    "list_source",
    "list_text",
    "number_text",
    "nz",
    "parse_array",
    "round2",
    "safe_divide",
    "segments",
    "set_text",
    "strip",
    "title_case",
    "to_number",
]
