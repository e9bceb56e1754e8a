"""Industry-category taxonomy ({sectors: [...], categories: [...]}).

Read by Spark (multiLine JSON, explicit schema) from any file system. A missing
file gives empty sectors and categories.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKAGED = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "data", "categories.json")

SECTOR = T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType())])
CATEGORY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("sector", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("ssic", T.ArrayType(T.StringType())),
        T.StructField("approx", T.BooleanType()),
    ]
)
TAXONOMY = T.StructType(
    [T.StructField("sectors", T.ArrayType(SECTOR)), T.StructField("categories", T.ArrayType(CATEGORY))]
)


def read_taxonomy(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row: (sectors array, categories array); both empty where there is no file."""
    path = path or PACKAGED
    path = f"file://{path}" if path == PACKAGED else path
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return spark.createDataFrame([([], [])], TAXONOMY)
    found = spark.read.schema(TAXONOMY).option("multiLine", True).json(path)
    return found.select(*[F.coalesce(c, F.array().cast(TAXONOMY[c].dataType)).alias(c) for c in TAXONOMY.names])


def categories(tax: DataFrame) -> DataFrame:
    """(pos, id, label, sector, keywords, ssic, approx); pos = order in the file."""
    return tax.select(F.posexplode("categories").alias("pos", "c")).select(
        "pos", "c.id", "c.label", "c.sector",
        F.coalesce(F.col("c.keywords"), F.array().cast("array<string>")).alias("keywords"),
        F.coalesce(F.col("c.ssic"), F.array().cast("array<string>")).alias("ssic"),
        F.coalesce(F.col("c.approx"), F.lit(False)).alias("approx"),
    )


def sectors(tax: DataFrame) -> DataFrame:
    return tax.select(F.posexplode("sectors").alias("pos", "s")).select("pos", "s.id", "s.label")
