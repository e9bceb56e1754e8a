"""Monthly rollups R1-R4 and the SummingMergeTree-style merge R5.

The rollups are count-by-key data products of the enriched fact; R5 folds a
delta into an existing rollup by summing counts with equal keys, where NULL
and '' in a key are the same key (the reference orders by coalesce(x, '')).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rollup name -> group keys.
ROLLUP_KEYS = {
    "new_entities_monthly_by_ssic": ["registration_month", "primary_ssic_norm", "entity_status_description"],
    "new_entities_monthly_by_subzone": ["registration_month", "subzone_id"],
    "new_entities_monthly_by_planning_area": ["registration_month", "planning_area_id"],
    "top_ssic_by_area_month": ["registration_month", "planning_area_id", "primary_ssic_norm"],
}

COUNT_COL = "new_entities"


def rollup(fact: DataFrame, name: str) -> DataFrame:
    """R1..R4: ``groupBy(keys).count()`` (partial aggregation map-side)."""
    keys = ROLLUP_KEYS[name]
    return fact.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias(COUNT_COL))


def merge_rollup(old: DataFrame, delta: DataFrame, name: str) -> DataFrame:
    """Fold a delta into a rollup (see ``sum_rollups``)."""
    keys = ROLLUP_KEYS[name]
    return sum_rollups(old.select(*keys, COUNT_COL).unionByName(delta.select(*keys, COUNT_COL)), name)


def sum_rollups(parts: DataFrame, name: str) -> DataFrame:
    """R5 over any number of stacked partial rollups: sum counts per key,
    where NULL and '' in a text key are the same key. The merged key is the
    non-empty value, else NULL if any part had NULL, else ''.
    """
    keys = ROLLUP_KEYS[name]
    text_keys = [k for k in keys if k != "registration_month"]
    grouped = parts.groupBy(
        "registration_month", *[F.coalesce(F.col(k), F.lit("")).alias(k) for k in text_keys]
    ).agg(
        F.sum(COUNT_COL).cast("long").alias(COUNT_COL),
        *[F.max(F.col(k).isNull().cast("int")).alias(f"_null_{k}") for k in text_keys],
    )
    out = [F.col("registration_month")]
    for k in text_keys:
        out.append(F.when((F.col(k) == "") & (F.col(f"_null_{k}") == 1), F.lit(None).cast("string"))
                   .otherwise(F.col(k)).alias(k))
    return grouped.select(*out, COUNT_COL).select(*keys, COUNT_COL)
