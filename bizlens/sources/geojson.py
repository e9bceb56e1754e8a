"""S3: GeoJSON boundary layers -> dimension rows.

A FeatureCollection becomes one row per feature with its place in the layer
(``seq``), its properties as a string map and the geometry kept as JSON text.
Files are read by Spark, values typed as in the file, wherever the file is. A
layer may have many files: ``seq`` is the file's rank by path, times 2^32, plus
the position in the file, so a layer of one file counts from 0.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PACKAGED_ZONES = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "data", "zones.geojson")

# Property keys tried in order (first non-empty wins).
SUBZONE_KEYS = {
    "id": ["SUBZONE_C", "SUBZONE", "subzone_id", "id"],
    "name": ["SUBZONE_N", "SUBZONE", "subzone", "name"],
    "area": ["PLN_AREA_C", "planning_area_id", "planning_area"],
}
PLANNING_KEYS = {
    "id": ["PLN_AREA_C", "planning_area_id", "id"],
    "name": ["PLN_AREA_N", "planning_area", "name"],
}
# Id keys the point-in-polygon matcher uses per layer.
SUBZONE_MATCH_KEYS = ["SUBZONE_C", "subzone_id", "id"]
PLANNING_MATCH_KEYS = ["PLN_AREA_C", "planning_area_id", "id"]

_FILE_SCHEMA = "features array<struct<properties: map<string, variant>, geometry: variant>>"


def _text(v) -> "F.Column":
    """A property as the reference's loader renders it: text as it is, others as
    Python's ``str`` writes them; null stays null."""
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (kind == "VOID"), F.lit(None).cast("string"))
        .when(kind == "STRING", F.variant_get(v, "$", "string"))
        .when(kind == "BOOLEAN", F.initcap(F.to_json(v)))
        .otherwise(F.to_json(v))
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(seq, properties map<string,string>, geometry JSON text, falsy_keys) per
    feature; ``falsy_keys`` are those whose JSON value is null, false, zero or empty."""
    path = f"file://{path}" if path == PACKAGED_ZONES else path  # shipped with the package
    # the list of files, without their contents; the listing on the driver bounds it
    files = (
        spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
        .select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("rank"))
    )
    raw = spark.read.schema(_FILE_SCHEMA).option("multiLine", True).json(path).select(
        F.col("_metadata.file_path").alias("file"), "features")
    f = raw.join(F.broadcast(files), "file").select("rank", F.posexplode("features").alias("pos", "f")).select(
        (F.shiftleft("rank", 32) + F.col("pos")).alias("seq"),
        F.coalesce("f.properties", F.create_map().cast("map<string,variant>")).alias("p"), "f.geometry",
    )
    falsy = F.map_filter("p", lambda k, v: v.isNull() | F.to_json(v).rlike(r'^(null|false|-?0(\.0*)?([eE].*)?|""|\[\]|\{\})$'))
    return f.select(
        "seq",
        F.transform_values("p", lambda k, v: _text(v)).alias("properties"),
        F.when(F.schema_of_variant("geometry") != "VOID", F.to_json("geometry")).alias("geometry"),
        F.map_keys(falsy).alias("falsy_keys"),
    )


def pick(props: str, keys) -> "F.Column":
    """First key whose value is present and non-empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(F.col(props), F.lit(k)), F.lit("")) for k in keys])


def subzone_dim(features: DataFrame, keys=SUBZONE_KEYS) -> DataFrame:
    """dim_subzone rows: id (else name, else 'unknown'), name (else id), area id, geometry."""
    fid = F.coalesce(pick("properties", keys["id"]), pick("properties", keys["name"]), F.lit("unknown"))
    return features.select(
        "seq",
        fid.alias("subzone_id"),
        F.coalesce(pick("properties", keys["name"]), fid).alias("name"),
        pick("properties", keys["area"]).alias("planning_area_id"),
        "geometry",
    )


def planning_area_dim(features: DataFrame, keys=PLANNING_KEYS) -> DataFrame:
    fid = F.coalesce(pick("properties", keys["id"]), pick("properties", keys["name"]), F.lit("unknown"))
    return features.select(
        "seq",
        fid.alias("planning_area_id"),
        F.coalesce(pick("properties", keys["name"]), fid).alias("name"),
        "geometry",
    )


def match_layer(features: DataFrame, id_keys) -> DataFrame:
    """(seq, feature_id, geometry) for the point matcher: the first id key whose
    value is truthy (so a numeric 0 id does not count, unlike in the dims);
    features without one are skipped."""
    fid = F.coalesce(*[
        F.when(~F.array_contains(F.coalesce("falsy_keys", F.array().cast("array<string>")), F.lit(k)),
               F.try_element_at(F.col("properties"), F.lit(k)))
        for k in id_keys
    ])
    return features.select("seq", fid.alias("feature_id"), "geometry").filter(F.col("feature_id").isNotNull())
