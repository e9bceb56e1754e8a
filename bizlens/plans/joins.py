"""Join helpers: broadcast only behind a size check.

``checked_broadcast`` reads the optimizer's size estimate for the plan (no job
is run). Parquet scans report file bytes scaled by the projected columns;
joins without CBO report the product of their inputs, so anything that might
be large is never hinted. Beyond the bound the join is left to the planner:
sort-merge, which AQE may still demote to a broadcast once the real
shuffle size is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer estimate of the plan's output size in bytes; -1 if unknown."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(size if isinstance(size, int) else size.toString())
    except Exception:
        return -1


def grows_rows(df: DataFrame) -> bool:
    """Whether the plan explodes rows, which its size estimate does not show."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(name in plan for name in ("Generate ", "Expand ", "MapInArrow", "MapInPandas", "FlatMapGroups"))


def fits_broadcast(df: DataFrame, max_bytes: int | None = None) -> bool:
    """Whether the estimate is within the bound and can be trusted. Plans that make
    more rows than they read are left to run-time sizes (AQE)."""
    if grows_rows(df):
        return False
    limit = DEFAULT_MAX_BROADCAST_BYTES if max_bytes is None else max_bytes
    size = estimated_bytes(df)
    return 0 <= size <= limit


def checked_broadcast(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``broadcast(df)`` when its estimated size is within bound, else ``df``."""
    return F.broadcast(df) if fits_broadcast(df, max_bytes) else df
