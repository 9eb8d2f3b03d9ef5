"""Incremental evaluation: memoised queries, change logs and span streams."""

from .changes import ChangeLog, watch
from .incremental import Database, IncrementalError
from .spans import stream_call_edges, stream_series

__all__ = ["ChangeLog", "Database", "IncrementalError", "stream_call_edges", "stream_series", "watch"]
