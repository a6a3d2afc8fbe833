"""Size-checked broadcast.

A side is broadcast only when its size is proven small: at most as many rows as
``MAX_BROADCAST_BYTES`` holds at the row width of its schema.  The check is a
``limit(n + 1).count()`` on a frame that is already tiny by construction (crisis table,
window table, parameter rows), so it reads at most ``n + 1`` rows.  Beyond the bound
the frame is returned unchanged and Spark's own planner (AQE, size statistics) chooses
a shuffle join instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Upper bound on what we are willing to ship to every executor.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Bytes of a column by type; a text is taken for 40 bytes (names, keys).
WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4, "bigint": 8, "double": 8, "timestamp": 8, "string": 40}
ROW_OVERHEAD = 16


def broadcast_rows(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> int:
    """The number of rows of ``df`` that may be broadcast."""
    return max_bytes // (ROW_OVERHEAD + sum(WIDTH.get(kind, 64) for _, kind in df.dtypes))


def bounded_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    most = broadcast_rows(df, max_bytes)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
