"""The operators that run on streams."""

from ledgerloom.streaming.ingest import read_stream_index, stream_ingest
from ledgerloom.streaming.jobs import stream_dedupe_jobs, stream_usage
from ledgerloom.streaming.runner import closable, late_rows, run_available, stream_session, write_closing
from ledgerloom.streaming.stateful import stream_progress, stream_rate_limit

__all__ = [
    "closable",
    "late_rows",
    "read_stream_index",
    "run_available",
    "stream_dedupe_jobs",
    "stream_ingest",
    "stream_progress",
    "stream_rate_limit",
    "stream_session",
    "stream_usage",
    "write_closing",
]
