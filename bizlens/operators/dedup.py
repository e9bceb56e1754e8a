"""Keep-one-row-per-key operators.

Both are a single ``groupBy(key)`` with ``min_by``/``max_by`` over a struct of
the row: the aggregate is partial (map-side combine), so a key holding a third
of all rows is folded inside each map task before the shuffle, and no group is
ever materialised whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NO_DATE = 2**31 - 1  # ranks after every real date


def dedup_keep_latest(df: DataFrame, key: str, date_col: str, order_col: str) -> DataFrame:
    """Per key keep the row with the latest date; ties and all-NULL keep first seen.

    Equals the sequential fold "replace iff the new date is later, or the kept
    date is NULL and the new one is not". ``order_col`` is the arrival order
    (any orderable column or struct; smaller = seen earlier). Rows with a NULL
    key are dropped, as the fold skips them.
    """
    value_cols = [c for c in df.columns if c not in (key,)]
    rank = F.struct(
        F.coalesce(-F.unix_date(F.col(date_col)), F.lit(_NO_DATE)).alias("d"),
        F.col(order_col).alias("o"),
    )
    # min over one struct (rank first, then the row): a single comparison
    # per input row, still a partial (map-side) aggregate.
    agg = (
        df.filter(F.col(key).isNotNull() & (F.col(key) != ""))
        .groupBy(key)
        .agg(F.min(F.struct(rank.alias("_k"), *[F.col(c) for c in value_cols])).alias("_row"))
    )
    return agg.select(key, *[F.col("_row." + c).alias(c) for c in value_cols])


def latest_by_key(df: DataFrame, key: str, version_col: str, tiebreak: list[str] | None = None) -> DataFrame:
    """A10: newest version per key (ReplacingMergeTree read semantics).

    Ties on the version are broken by the largest ``tiebreak`` columns.
    """
    value_cols = [c for c in df.columns if c != key]
    rank = F.struct(F.col(version_col), *[F.col(c) for c in (tiebreak or [])])
    agg = df.groupBy(key).agg(F.max(F.struct(rank.alias("_k"), *[F.col(c) for c in value_cols])).alias("_row"))
    return agg.select(key, *[F.col("_row." + c).alias(c) for c in value_cols])
