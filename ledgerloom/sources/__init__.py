"""Scans of library tables and stored objects, and the versioned vector index."""

from ledgerloom.sources.index import publish, read_published, reindex
from ledgerloom.sources.objects import scan_objects, store_objects, validate_uploads
from ledgerloom.sources.tables import read_table, write_table

__all__ = [
    "publish",
    "read_published",
    "read_table",
    "reindex",
    "scan_objects",
    "store_objects",
    "validate_uploads",
    "write_table",
]
