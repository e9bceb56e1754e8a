"""Batch pipelines T1..T4 wired from the operators.

T1 clean_registry   S1/S2 -> P10 -> P7 -> A9 -> S6 (+ A11, A12)
T2 load_warehouse   S1 -> P10 + P6 + P7 -> J1 + P8 + P9 -> S7
T3 geo_enrich       J4 worklist -> coordinates -> J5 x 2 -> S9 -> S8
T4 rebuild_enriched J1 again with the merged geo dim (optionally dropping undated rows)

Each step is a lazy DataFrame; jobs are run by the writers and where lineage is cut (T3).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.operators.clean import clean_for_load, clean_record
from bizlens.operators.dedup import dedup_keep_latest
from bizlens.operators.enrich import enrich_geo, postal_worklist
from bizlens.operators.profile import per_file_report, profile_distinct, profile_nulls
from bizlens.operators.spatial import point_in_polygon
from bizlens.schema import KEEP_COLUMNS
from bizlens.session import cut_lineage


def clean_registry(extract: DataFrame, order_col: str = "_ord") -> dict[str, DataFrame]:
    """Cleaned, de-duplicated table plus its quality profile and file report.

    ``extract`` carries ``source_file`` and ``order_col`` (arrival order) from S1/S2.
    """
    carry = tuple(c for c in ("source_file", order_col) if c in extract.columns)
    cleaned = clean_record(extract, carry=carry)
    deduped = dedup_keep_latest(cleaned.drop("source_file") if "source_file" in carry else cleaned,
                                "uen", "registration_incorporation_date", order_col).select(*KEEP_COLUMNS)
    out = {
        "clean": deduped,
        "profile_nulls": profile_nulls(deduped, KEEP_COLUMNS),
        "profile_distinct": profile_distinct(deduped),
    }
    if "source_file" in carry:
        out["files"] = per_file_report(extract)
    return out


def load_warehouse(extract: DataFrame, postal_geo: DataFrame) -> DataFrame:
    """Loader cleaning, then the enriched fact (write it with ``write_fact``)."""
    return enrich_geo(clean_for_load(extract), postal_geo, codes_cleaned=True)


def geo_enrich(raw: DataFrame, postal_geo: DataFrame, coordinates: DataFrame, subzone_layer: DataFrame,
               planning_layer: DataFrame, updated_at: _dt.datetime, limit: int | None = None,
               mark_failed: bool = True) -> DataFrame:
    """New dim_postal_geo rows for postal codes the dim lacks.

    ``coordinates`` (postal_code, latitude, longitude) replaces the remote
    geocoder; each located code is matched against both boundary layers.
    Codes without coordinates get a row with NULLs when ``mark_failed`` (so
    they leave the worklist). The whole worklist is processed in one job
    unless ``limit`` asks for a batch.
    """
    work = postal_worklist(raw, postal_geo, limit)
    coords = coordinates.groupBy("postal_code").agg(
        F.min_by(F.struct("latitude", "longitude"), F.struct("latitude", "longitude")).alias("c")
    ).select("postal_code", "c.latitude", "c.longitude")
    # Used by both layers and by the rows without coordinates: computed once.
    located = cut_lineage(work.join(coords, "postal_code", "left"))
    found = located.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    sub = point_in_polygon(found, subzone_layer, x_col="longitude", y_col="latitude", key_col="postal_code")
    plan = point_in_polygon(found, planning_layer, x_col="longitude", y_col="latitude", key_col="postal_code")
    ts = F.lit(updated_at).cast("timestamp")
    rows = (
        found.join(sub.withColumnRenamed("feature_id", "subzone_id"), "postal_code", "left")
        .join(plan.withColumnRenamed("feature_id", "planning_area_id"), "postal_code", "left")
        .select("postal_code", "latitude", "longitude", "subzone_id", "planning_area_id", ts.alias("updated_at"))
    )
    if mark_failed:
        failed = located.filter(F.col("latitude").isNull() | F.col("longitude").isNull()).select(
            "postal_code",
            F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
            F.lit(None).cast("string").alias("subzone_id"), F.lit(None).cast("string").alias("planning_area_id"),
            ts.alias("updated_at"),
        )
        rows = rows.unionByName(failed)
    return rows


def upsert_postal_geo(existing: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Append-only; readers take the newest version per code (A10 in J1)."""
    cols = ["postal_code", "latitude", "longitude", "subzone_id", "planning_area_id", "updated_at"]
    return existing.select(*cols).unionByName(new_rows.select(*cols))


def rebuild_enriched(raw: DataFrame, postal_geo: DataFrame, drop_undated: bool = False) -> DataFrame:
    """T4: the enriched fact recomputed against the current geo dim."""
    return enrich_geo(raw, postal_geo, drop_undated=drop_undated, codes_cleaned=True)
