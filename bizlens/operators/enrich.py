"""Geo enrichment joins (J1 enrich, J4 worklist anti-join)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.cleaning import ssic_norm, yyyymm
from bizlens.operators.dedup import latest_by_key
from bizlens.plans.joins import estimated_bytes, fits_broadcast
from bizlens.schema import ENRICHED_COLUMNS, KEEP_COLUMNS

GEO_COLUMNS = ["latitude", "longitude", "subzone_id", "planning_area_id"]


def latest_postal_geo(postal_geo: DataFrame) -> DataFrame:
    """dim_postal_geo as read: newest ``updated_at`` per postal code (A10)."""
    return latest_by_key(
        postal_geo.select("postal_code", *GEO_COLUMNS, "updated_at"),
        "postal_code",
        "updated_at",
        tiebreak=GEO_COLUMNS,
    ).select("postal_code", *GEO_COLUMNS)


#: Rows of the dim that may be broadcast: some 120 bytes each, 64 MB at most.
MAX_BROADCAST_ROWS = 500_000


def left_join_on_key(fact: DataFrame, dim: DataFrame, key: str, max_broadcast_bytes=None) -> DataFrame:
    """Left equi-join where NULL keys never match.

    Small dim: broadcast hash join, no shuffle of the fact. Large dim:
    sort-merge join (AQE may still turn it into a broadcast at run time, and
    splits skewed partitions). NULL keys, which would all hash to one reducer,
    are replaced by a per-row value that can never match (a control-character
    prefix + row hash), so they spread over all reducers in the same scan.
    """
    extra = [c for c in dim.columns if c != key]
    small = fits_broadcast(dim, max_broadcast_bytes)
    if not small and max_broadcast_bytes is None and 0 <= estimated_bytes(dim) < 2**60:
        # The estimate of a dim made by joins is their product, so its rows are counted (not of unknown size).
        small = dim.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    if small:
        return fact.join(F.broadcast(dim), key, "left")
    salted = F.coalesce(
        F.col(key), F.concat(F.lit("\u0001"), F.xxhash64(*[F.col(c) for c in fact.columns]).cast("string"))
    )
    left = fact.withColumn("_jk", salted)
    right = dim.withColumnRenamed(key, "_jk")
    j = left.join(right, "_jk", "left")
    return j.select(*fact.columns, *extra)


def enrich_geo(raw: DataFrame, postal_geo: DataFrame, drop_undated: bool = False,
               max_broadcast_bytes=None, codes_cleaned: bool = False) -> DataFrame:
    """J1 + P8 + P9: raw fact LEFT JOIN latest postal geo -> enriched fact (18 cols).

    ``drop_undated`` reproduces the month-by-month rebuild, which loses rows
    whose registration date is NULL. ``codes_cleaned`` states that the codes
    already went through P4 (our loader); P8 then reduces to '' -> NULL,
    which keeps pushed-down filters on the normalised code small.
    """
    if drop_undated:
        raw = raw.filter(F.col("registration_incorporation_date").isNotNull())
    def norm(c):
        return F.nullif(F.col(c), F.lit("")) if codes_cleaned else ssic_norm(c)

    geo = latest_postal_geo(postal_geo)
    j = left_join_on_key(raw.select(*KEEP_COLUMNS), geo, "postal_code", max_broadcast_bytes)
    return j.select(
        *[F.col(c) for c in KEEP_COLUMNS[:10]],
        norm("primary_ssic_code").alias("primary_ssic_norm"),
        norm("secondary_ssic_code").alias("secondary_ssic_norm"),
        F.col("postal_code"),
        yyyymm("registration_incorporation_date").alias("registration_month"),
        *[F.col(c) for c in GEO_COLUMNS],
    ).select(*ENRICHED_COLUMNS)


def new_postals(raw: DataFrame, postal_geo: DataFrame) -> DataFrame:
    """Distinct non-NULL postal codes of the fact that the geo dim lacks.

    Distinct first (map-side partial aggregate), then a left-anti join; the
    dim's key is non-nullable so NOT IN and NOT EXISTS agree.
    """
    codes = raw.select("postal_code").filter(F.col("postal_code").isNotNull()).distinct()
    known = postal_geo.select("postal_code").filter(F.col("postal_code").isNotNull())
    return codes.join(known, "postal_code", "left_anti")


def remaining_postals(raw: DataFrame, postal_geo: DataFrame) -> DataFrame:
    """How many distinct postal codes still need geocoding (one row)."""
    return new_postals(raw, postal_geo).agg(F.count(F.lit(1)).alias("remaining_postals"))


def postal_worklist(raw: DataFrame, postal_geo: DataFrame, limit: int | None) -> DataFrame:
    """L4: a deterministic batch of the worklist (smallest codes first; None: all)."""
    w = new_postals(raw, postal_geo).orderBy("postal_code")
    return w.limit(limit) if limit else w
