"""Landed API pages -> registry rows, and the per-resource page audit.

A page is ``{success, error, result: {total, records: [ {column: text} ]}}``,
one JSON document per line. Only successful pages count. The HTTP pull
itself is not part of this package: pages are read from storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.schema import KEEP_COLUMNS

PAGE_SCHEMA = T.StructType([
    T.StructField("resource_id", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("result", T.StructType([
        T.StructField("total", T.LongType()),
        T.StructField("records", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    ])),
])


def read_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).option("multiLine", multi_line).json(path)


def page_records(pages: DataFrame, columns=KEEP_COLUMNS) -> DataFrame:
    """Records of successful pages as text columns (unknown keys dropped,
    missing ones NULL), with the arrival order (resource, offset, position)."""
    ok = pages.filter(F.col("success"))
    rec = ok.select("resource_id", "offset", F.posexplode("result.records").alias("pos", "r"))
    return rec.select(
        *[F.col("r").getItem(c).alias(c) for c in columns],
        F.col("resource_id").alias("source_file"),
        F.struct("resource_id", "offset", "pos").alias("_ord"),
    )


def page_audit(pages: DataFrame) -> DataFrame:
    """Per resource: reported total, rows fetched from successful pages, first and
    last offset of the successful pages that held records, failed pages (a page
    that does not say it succeeded has failed)."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    held = F.when(ok, F.coalesce(F.size("result.records"), F.lit(0))).otherwise(0)
    return pages.groupBy("resource_id").agg(
        F.max(F.when(ok, F.col("result.total"))).alias("total_rows"),
        F.sum(F.greatest(held, F.lit(0))).cast("long").alias("fetched_rows"),
        F.min(F.when(held > 0, F.col("offset"))).alias("first_offset"),
        F.max(F.when(held > 0, F.col("offset"))).alias("last_offset"),
        F.count_if(~ok).cast("long").alias("failed_pages"),
    )
