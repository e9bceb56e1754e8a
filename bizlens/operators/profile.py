"""Data-quality profile (A11) and per-source-file report.

One aggregation pass computes every column's null-or-empty count; the
one-row result is then unpivoted, so the cost is a single scan with a
partial aggregate regardless of the number of columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _blank(c: str):
    return F.col(c).isNull() | (F.col(c).cast("string") == "")


def profile_nulls(df: DataFrame, columns) -> DataFrame:
    """(column_name, total_rows, null_count, null_percent) per column.

    NULL and '' both count as missing; the percent is 0.0 on an empty table.
    """
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count_if(_blank(c)).alias(f"_z{i}") for i, c in enumerate(columns)]
    one = df.agg(*aggs)
    stack = ", ".join(f"'{c}', _z{i}" for i, c in enumerate(columns))
    long = one.selectExpr("_n", f"stack({len(columns)}, {stack}) AS (column_name, null_count)")
    return long.select(
        "column_name",
        F.col("_n").cast("long").alias("total_rows"),
        F.col("null_count").cast("long").alias("null_count"),
        F.coalesce(F.try_divide(F.col("null_count") * 100.0, F.col("_n")), F.lit(0.0)).alias("null_percent"),
    )


def profile_distinct(df: DataFrame, status_col: str = "entity_status_description",
                     type_col: str = "entity_type_description") -> DataFrame:
    """Row count and the sorted distinct non-empty statuses and types.

    ``collect_set`` is bounded by the columns' cardinality (tens of values),
    and is combined map-side.
    """
    def values(c):
        return F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), ",")

    return df.agg(
        F.count(F.lit(1)).cast("long").alias("total_rows"),
        values(status_col).alias("distinct_status"),
        values(type_col).alias("distinct_type"),
    )


def per_file_report(df: DataFrame, file_col: str = "source_file", error_col: str | None = None) -> DataFrame:
    """Rows read per source file (and malformed rows when tracked)."""
    aggs = [F.count(F.lit(1)).cast("long").alias("fetched_rows")]
    if error_col:
        aggs.append(F.count_if(F.col(error_col).isNotNull()).cast("long").alias("error_rows"))
    extra = ["error_rows"] if error_col else []
    return (
        df.groupBy(F.col(file_col).alias("resource_id"))
        .agg(*aggs)
        .select(
            "resource_id",
            "fetched_rows",
            F.lit(0).cast("long").alias("first_offset"),
            F.col("fetched_rows").alias("last_offset"),
            *extra,
        )
        .orderBy("resource_id")
    )
