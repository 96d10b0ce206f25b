"""Sources: delimited files and any other Spark table, as string tables."""

from .delimited import Delimited, damaged_cells, decode_audit, read_delimited, read_source
from .tables import as_string_table, profile

__all__ = [
    "Delimited",
    "as_string_table",
    "damaged_cells",
    "decode_audit",
    "profile",
    "read_delimited",
    "read_source",
]
