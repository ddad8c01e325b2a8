"""Table definitions, readers, and writers."""

from clientele.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, Tables
from clientele.sources.star import star_tables
from clientele.sources.storage import (
    read_csv,
    read_csv_with_rejects,
    read_tables,
    save_bucketed,
    write_tables,
)

__all__ = [
    "FOREIGN_KEYS",
    "PRIMARY_KEYS",
    "SCHEMAS",
    "Tables",
    "read_csv",
    "read_csv_with_rejects",
    "read_tables",
    "save_bucketed",
    "star_tables",
    "write_tables",
]
