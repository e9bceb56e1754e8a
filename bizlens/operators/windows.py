"""Counts in a date window answered from the monthly rollups.

A window is split into its whole months, which a rollup answers, and the days
at its edges, which the fact answers (month partitions and dates pruned); both
are added up per key. A rollup fits when its keys cover the group keys and the
filtered columns; the one with the fewest keys is read. Where none fits, or the
window holds no whole month, the fact answers alone. Keys are as in the fact:
a NULL key is a group. Reversed bounds give no rows.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.functions.cleaning import yyyymm_of
from bizlens.operators.filters import MONTH_COL, date_between
from bizlens.operators.rollups import COUNT_COL, ROLLUP_KEYS, rollup
from bizlens.session import cut_lineage

CNT = "count"


def whole_months(lo: _dt.date, hi: _dt.date) -> tuple[_dt.date, _dt.date] | None:
    """First and last day of the whole months in a window, or None."""
    first = lo if lo.day == 1 else (lo.replace(day=1) + _dt.timedelta(days=32)).replace(day=1)
    after = hi + _dt.timedelta(days=1)
    last = after.replace(day=1) - _dt.timedelta(days=1)
    return (first, last) if first <= last else None


def fitting_rollup(columns) -> str | None:
    """The rollup of fewest keys that has all the columns."""
    fits = [name for name, keys in ROLLUP_KEYS.items() if set(columns) <= set(keys)]
    return min(fits, key=lambda name: len(ROLLUP_KEYS[name]), default=None)


class Rollups:
    """R1-R4 as written tables, partitioned by month."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def write(self, fact: DataFrame) -> Rollups:
        for name in ROLLUP_KEYS:
            rollup(fact, name).hint("rebalance", MONTH_COL).write.partitionBy(MONTH_COL).parquet(f"{self.path}/{name}")
        return self

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").select(*ROLLUP_KEYS[name], COUNT_COL)


def geo_deltas(fact: DataFrame, new_geo: DataFrame, name: str) -> DataFrame:
    """What new geo rows change in a rollup: minus each changed row's old keys, plus its new ones.

    ``fact`` is the enriched fact before, ``new_geo`` has one row per postal code.
    Rows are counted per key and postal code first, so a hot code is folded before the join.
    """
    keys = ROLLUP_KEYS[name]
    geo_keys = [k for k in keys if k in ("subzone_id", "planning_area_id")]
    old = fact.groupBy("postal_code", *keys).agg(F.count(F.lit(1)).alias("n"))
    new = new_geo.select("postal_code", *[F.col(k).alias(f"new_{k}") for k in geo_keys])
    hit = old.join(new, "postal_code")
    plus = hit.select(*[F.col(f"new_{k}").alias(k) if k in geo_keys else F.col(k) for k in keys],
                      F.col("n").alias(COUNT_COL))
    return hit.select(*keys, (-F.col("n")).alias(COUNT_COL)).unionByName(plus).groupBy(*keys).agg(
        F.sum(COUNT_COL).alias(COUNT_COL)).filter(F.col(COUNT_COL) != 0)


def stage_refresh(rollups: Rollups, fact: DataFrame, new_geo: DataFrame, stage: str,
                  names=("new_entities_monthly_by_subzone", "new_entities_monthly_by_planning_area",
                         "top_ssic_by_area_month")) -> None:
    """Write the corrected rows of every month that new geo rows change (R2-R4) to ``stage``."""
    for name in names:
        keys = ROLLUP_KEYS[name]
        delta = cut_lineage(geo_deltas(fact, new_geo, name))
        months = delta.select(F.col(MONTH_COL).alias("_month")).distinct()
        old = rollups.read(name)
        old = old.join(months, F.col(MONTH_COL).eqNullSafe(F.col("_month")), "left_semi")
        old.unionByName(delta).groupBy(*keys).agg(F.sum(COUNT_COL).cast("long").alias(COUNT_COL)).filter(
            F.col(COUNT_COL) != 0).hint("rebalance", MONTH_COL).write.partitionBy(MONTH_COL).parquet(f"{stage}/{name}")


def apply_refresh(rollups: Rollups, stage: str,
                  names=("new_entities_monthly_by_subzone", "new_entities_monthly_by_planning_area",
                         "top_ssic_by_area_month")) -> None:
    """Replace the staged months. The stage stays as it is, so a run that dies is repeated with the
    same result; a month keeps its rows when geo changes, so none is left to delete."""
    staged = Rollups(rollups.spark, stage)
    for name in names:
        staged.read(name).hint("rebalance", MONTH_COL).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(MONTH_COL).parquet(f"{rollups.path}/{name}")


def count_in_keys(fact: DataFrame, rollups: Rollups, lo: _dt.date, hi: _dt.date, keys: list[str],
                  filters: dict[str, Column | None] | None = None) -> DataFrame:
    """(keys..., count) of the window; ``filters`` maps a column to the predicate on it."""
    conds = {c: p for c, p in (filters or {}).items() if p is not None}
    name = fitting_rollup([*keys, *conds])
    months = whole_months(lo, hi)

    def kept(df: DataFrame) -> DataFrame:
        return reduce(lambda d, p: d.filter(p), conds.values(), df)

    def from_fact(*spans) -> DataFrame:
        days = reduce(lambda a, b: a | b, [date_between(a, b) for a, b in spans])
        return kept(fact.filter(days)).groupBy(*keys).agg(F.count(F.lit(1)).alias(CNT))

    if name is None or months is None:
        return from_fact((lo, hi))
    first, last = months
    parts = kept(rollups.read(name).filter(F.col(MONTH_COL).between(yyyymm_of(first), yyyymm_of(last)))).select(
        *keys, F.col(COUNT_COL).alias(CNT))
    day = _dt.timedelta(days=1)
    edges = [(a, b) for a, b in [(lo, first - day), (last + day, hi)] if a <= b]
    if edges:
        parts = parts.unionByName(from_fact(*edges))
    return parts.groupBy(*keys).agg(F.sum(CNT).cast("long").alias(CNT))


def top_of(counts: DataFrame, key: str, limit: int | None = 10, alias: str | None = None) -> DataFrame:
    """A3/A4 of given counts: count desc, key asc as tie-break."""
    name = alias or key
    out = counts.select(F.col(key).alias(name), CNT).orderBy(F.col(CNT).desc(), F.col(name).asc_nulls_last())
    return out.limit(limit) if limit else out


def by_month(counts: DataFrame) -> DataFrame:
    """A2 of given counts: (month, count) ascending."""
    return counts.select(F.col(MONTH_COL).alias("month"), CNT).orderBy(F.col("month").asc_nulls_last())
