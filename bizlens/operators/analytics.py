"""Counting analytics over the enriched fact.

Every aggregate is ``groupBy(...).agg(count)``: partial aggregation runs
map-side, so a hot key (one code holding a third of the rows) is folded in
each map task and the shuffle carries one row per key per task. Top-k uses
``orderBy().limit(k)`` (TakeOrderedAndProject: each task keeps k rows).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions.cleaning import yyyymm_of
from bizlens.functions.numeric import python_round
from bizlens.operators.filters import DATE_COL, MONTH_COL, NORM_COL, all_of, date_between
from bizlens.operators.paging import page
from bizlens.session import cut_lineage

CNT = "count"


def count_in_window(fact: DataFrame, cond) -> DataFrame:
    """A1: one row, ``count`` of rows matching ``cond``."""
    return fact.filter(cond).agg(F.count(F.lit(1)).alias(CNT))


def count_by_month(fact: DataFrame, cond, month_col: str = MONTH_COL) -> DataFrame:
    """A2: (month, count) ascending; months without rows are not filled."""
    return (
        fact.filter(cond)
        .groupBy(F.col(month_col).alias("month"))
        .agg(F.count(F.lit(1)).alias(CNT))
        .orderBy(F.col("month").asc_nulls_last())
    )


def top_by_key(fact: DataFrame, cond, key: str, limit: int | None = 10, alias: str | None = None) -> DataFrame:
    """A3/A4: count per key (NULL key is a group), count desc, key asc as tiebreak."""
    name = alias or key
    agg = fact.filter(cond).groupBy(F.col(key).alias(name)).agg(F.count(F.lit(1)).alias(CNT))
    out = agg.orderBy(F.col(CNT).desc(), F.col(name).asc_nulls_last())
    return out.limit(limit) if limit else out


def count_by_month_area(fact: DataFrame, cond, area_col: str = "planning_area_id") -> DataFrame:
    """(month, area, count) ordered by month, area (NULLs last)."""
    return (
        fact.filter(cond)
        .groupBy(F.col(MONTH_COL).alias("month"), F.col(area_col).alias("planning_area_id"))
        .agg(F.count(F.lit(1)).alias(CNT))
        .orderBy(F.col("month").asc_nulls_last(), F.col("planning_area_id").asc_nulls_last())
    )


def with_descriptions(topk: DataFrame, dim_ssic: DataFrame, code_col: str = "ssic_code") -> DataFrame:
    """Attach ``ssic_description`` to a top-k result.

    The dim is first semi-joined against the k codes (broadcasting the k-row
    side, bounded by k), then reduced to one deterministic description per
    code (min), then left-joined back. NULL/'' codes get NULL. The k rows are
    checkpointed first so the fact is not scanned a second time for them.
    """
    topk = cut_lineage(topk)
    codes = topk.select(F.col(code_col).alias("ssic_code")).filter(
        F.col("ssic_code").isNotNull() & (F.col("ssic_code") != "")
    )
    desc = (
        dim_ssic.select("ssic_code", "ssic_description")
        .join(F.broadcast(codes), "ssic_code", "left_semi")
        .groupBy("ssic_code")
        .agg(F.min("ssic_description").alias("ssic_description"))
    )
    return topk.join(F.broadcast(desc), topk[code_col] == desc["ssic_code"], "left").select(
        topk[code_col].alias(code_col), desc["ssic_description"], topk[CNT]
    )


def _prev_year(d: _dt.date) -> _dt.date:
    """Same day one year earlier; Feb 29 -> Feb 28 (add_months semantics)."""
    try:
        return d.replace(year=d.year - 1)
    except ValueError:
        return d.replace(year=d.year - 1, day=28)


def overview(fact: DataFrame, start: _dt.date, end: _dt.date, ssic_cond=None, area_cond=None) -> DataFrame:
    """Q1 / A13-A15 in one scan of the fact.

    Grouping sets over (code), (planning area), (subzone) and () compute the
    current and previous-year totals, the top code and the hottest area in a
    single aggregation; each set's top-1 is then a ``min_by`` (also partial).
    Output: one row.
    """
    pstart, pend = _prev_year(start), _prev_year(end)
    cur = date_between(start, end)
    prev = date_between(pstart, pend)
    in_area = area_cond if area_cond is not None else F.lit(True)
    base = fact.filter(all_of(cur | prev, ssic_cond)).select(
        F.col(NORM_COL),
        F.col("planning_area_id"),
        F.col("subzone_id"),
        F.col(DATE_COL).between(F.lit(start), F.lit(end)).alias("_cur"),
        F.col(DATE_COL).between(F.lit(pstart), F.lit(pend)).alias("_prev"),
        F.coalesce(in_area, F.lit(False)).alias("_area"),
    )
    sets = base.groupingSets(
        [[NORM_COL], ["planning_area_id"], ["subzone_id"], []],
        NORM_COL, "planning_area_id", "subzone_id",
    ).agg(
        F.grouping_id().alias("gid"),
        F.count_if(F.col("_cur") & F.col("_area")).alias("n_cur_area"),
        F.count_if(F.col("_prev") & F.col("_area")).alias("n_prev_area"),
        F.count_if(F.col("_cur")).alias("n_cur"),
    )
    # grouping_id bits follow the column order (code, planning, subzone).
    g_code, g_plan, g_sub, g_all = 3, 5, 6, 7
    keyed = sets.select(
        "gid",
        F.when(F.col("gid") == g_code, F.col(NORM_COL))
        .when(F.col("gid") == g_plan, F.col("planning_area_id"))
        .when(F.col("gid") == g_sub, F.col("subzone_id"))
        .alias("key"),
        F.when(F.col("gid") == g_code, F.col("n_cur_area")).otherwise(F.col("n_cur")).alias("n"),
        "n_cur_area",
        "n_prev_area",
    )
    ranked = keyed.filter((F.col("gid") == g_all) | (F.col("n") > 0))
    rank = F.struct((-F.col("n")).alias("a"), F.col("key").isNull().alias("b"), F.col("key").alias("c"))
    tops = ranked.groupBy("gid").agg(
        F.min_by(F.struct("key", "n"), rank).alias("top"),
        F.max("n_cur_area").alias("total"),
        F.max("n_prev_area").alias("prev_total"),
    )

    def pick(g, field):
        return F.max(F.when(F.col("gid") == g, F.col(field)))

    row = tops.agg(
        F.coalesce(pick(g_all, "total"), F.lit(0)).alias("value"),
        F.coalesce(pick(g_all, "prev_total"), F.lit(0)).alias("prev_value"),
        pick(g_code, "top.key").alias("top_ssic_code"),
        pick(g_code, "top.n").alias("top_ssic_count"),
        pick(g_plan, "top.key").alias("plan_key"),
        pick(g_plan, "top.n").alias("plan_n"),
        pick(g_sub, "top.key").alias("sub_key"),
        pick(g_sub, "top.n").alias("sub_n"),
    )
    plan_ok = F.col("plan_key").isNotNull()
    sub_ok = F.col("sub_key").isNotNull()
    return row.select(
        F.lit(start).alias("period_start"),
        F.lit(end).alias("period_end"),
        F.lit("new_entities_30d").alias("label"),
        F.col("value").cast("long").alias("value"),
        F.col("prev_value").cast("long").alias("prev_value"),
        F.when(F.col("prev_value") != 0,
               python_round((F.col("value") - F.col("prev_value")) / F.col("prev_value") * 100, 2))
        .alias("change_yoy_pct"),
        F.when(F.col("top_ssic_code").isNotNull(), F.col("top_ssic_code")).alias("top_ssic_code"),
        F.when(F.col("top_ssic_code").isNotNull(), F.col("top_ssic_count")).cast("long").alias("top_ssic_count"),
        F.when(plan_ok, F.col("plan_key")).when(sub_ok, F.col("sub_key"))
        .otherwise(F.lit("UNMAPPED")).alias("hottest_area_id"),
        F.when(plan_ok, F.col("plan_n")).when(sub_ok, F.col("sub_n"))
        .otherwise(F.col("value")).cast("long").alias("hottest_count"),
        F.when(plan_ok, F.lit("planning_area")).when(sub_ok, F.lit("subzone"))
        .otherwise(F.lit("unmapped")).alias("hottest_area_type"),
    )


def hotspots(fact: DataFrame, dim_subzone: DataFrame, cond) -> DataFrame:
    """Q4 / J2 + A5: count per subzone, aggregated before the join so the
    polygon text is never shuffled with the fact; inner join because the
    right-side geometry filter (F8) rejects unmatched rows anyway.
    """
    counts = (
        fact.filter(cond & F.col("subzone_id").isNotNull())
        .groupBy("subzone_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    dim = dim_subzone.filter(F.col("geometry").isNotNull() & (F.col("geometry") != ""))
    j = counts.join(dim, "subzone_id", "inner")
    return (
        j.groupBy("subzone_id", "name", "planning_area_id", "geometry")
        .agg(F.sum("n").cast("long").alias(CNT))
        .orderBy(F.col(CNT).desc(), F.col("subzone_id").asc())
    )


def hotspot_intensity(hot: DataFrame) -> DataFrame:
    """Map styling data. intensity = count / max(1, max count over all rows)
    (taken before invalid geometry is dropped); opacity 0.15 + 0.6*intensity.

    The input is one row per subzone (bounded by the boundary layer), so the
    un-partitioned window is bounded too.
    """
    w = Window.partitionBy()
    mx = F.greatest(F.max(CNT).over(w), F.lit(1))
    g = F.col("geometry")
    out = hot.select(
        "subzone_id", "planning_area_id", "geometry", CNT,
        (F.col(CNT) / mx).alias("intensity"),
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("subzone_id"), F.lit("")),
                   F.lit("Unknown")).alias("display_name"),
    )
    valid = g.isNotNull() & (F.length(F.trim(g)) > 0) & F.try_parse_json(g).isNotNull()
    return out.filter(valid).select(
        "subzone_id", "display_name",
        F.coalesce(F.col("planning_area_id"), F.lit("")).alias("planning_area_id"),
        CNT, "intensity", (F.lit(0.15) + F.col("intensity") * 0.6).alias("fill_opacity"),
    )


def search_order(columns) -> list:
    """Newest registration first (NULL dates last), uen and then the rest as tiebreak."""
    return [F.col(DATE_COL).desc_nulls_last(), F.col("uen").asc(),
            *[F.col(c).asc_nulls_last() for c in columns if c not in (DATE_COL, "uen")]]


def search(fact: DataFrame, cond, columns, limit: int = 50, offset: int = 0) -> DataFrame:
    """Q5 page, in search order; deep pages are located by counts (L2)."""
    return page(fact.filter(cond).select(*columns), search_order(columns), limit, offset)


def search_total(fact: DataFrame, cond) -> DataFrame:
    """Q5 total (before paging)."""
    return fact.filter(cond).agg(F.count(F.lit(1)).alias("total"))


def entity_detail(fact: DataFrame, uen: str, columns) -> DataFrame:
    """The entity's row (at most one). Should the key repeat, the
    newest registration wins, then the smallest remaining columns."""
    rows = fact.filter(F.col("uen") == F.lit(uen)).select(*columns)
    order = [F.col(DATE_COL).desc_nulls_last()] + [F.col(c).asc_nulls_last() for c in columns if c != DATE_COL]
    return rows.orderBy(*order).limit(1)


def month_range(lo: _dt.date, hi: _dt.date) -> tuple[int, int]:
    return yyyymm_of(lo), yyyymm_of(hi)


def yyyymm_col(c: str):
    """P9 for a date column, as used by rollups and month listings."""
    return F.coalesce((F.year(c) * 100 + F.month(c)).cast("int"), F.lit(0))
