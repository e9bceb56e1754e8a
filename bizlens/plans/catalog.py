"""Registered queries: one Spark callable (spark, sf_dir) -> DataFrame per
operator of the inventory, plus its DuckDB oracle SQL where one exists.

Keys carry the inventory ID as a prefix (Q2_trend, A9_dedup_keep_latest, ...).
Every query reads the driver tables (or frames Spark derives from them) whole.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.operators import analytics as A
from bizlens.operators import dedup as D
from bizlens.operators import enrich as EN
from bizlens.operators import filters as FL
from bizlens.operators import name_index as NI
from bizlens.operators import profile as PR
from bizlens.operators import questions as QN
from bizlens.operators import rollups as RU
from bizlens.operators import spatial as SP
from bizlens.operators import taxonomy as TX
from bizlens.operators import windows as WN
from bizlens.operators.clean import clean_record as _clean_record
from bizlens.plans import api as API
from bizlens.plans import oracle_sql as O
from bizlens.plans import pipelines as PL
from bizlens.plans import warehouse as W
from bizlens.schema import DETAIL_COLUMNS, ENRICHED_COLUMNS, KEEP_COLUMNS, SEARCH_COLUMNS
from bizlens.session import cut_lineage, shared_dir, tune
from bizlens.sources import api_pages as AP
from bizlens.sources import geojson as GJ
from bizlens.sources import registry_csv as RC
from bizlens.sources import taxonomy as TS
from bizlens.sources import tpch
from bizlens.streaming import rollups as STR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Fixed query parameters (literal bounds; no "today").
WHOLE = (dt.date(1995, 1, 1), dt.date(2001, 12, 31))
YEAR_2000 = (dt.date(2000, 1, 1), dt.date(2000, 12, 31))
SEARCH_Q = "line 7"
DETAIL_UEN = "00004242K"


def register(name: str, sql: str | None = None):
    def deco(fn):
        def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)

        entry.__name__ = fn.__name__
        entry.__doc__ = fn.__doc__
        QUERIES[name] = entry
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _w(lo: dt.date, hi: dt.date) -> str:
    return O.date_window(lo.isoformat(), hi.isoformat())


# ---------------------------------------------------------------- Q1..Q6 ---

@register("Q2_trend", O.with_fact() + f"""
SELECT registration_month AS month, count(*) AS count FROM fact
WHERE {_w(*WHOLE)} GROUP BY 1 ORDER BY 1""")
def q2_trend(spark, sf):
    fact = W.warehouse_fact(spark, sf)
    return API.trends(fact, as_of=WHOLE[1], date_from=WHOLE[0])


@register("Q3_top_ssic", O.with_fact(O.SSIC_DIM) + f"""
, top AS (
  SELECT primary_ssic_norm AS ssic_code, count(*) AS count FROM fact WHERE {_w(*WHOLE)}
  GROUP BY 1 ORDER BY count DESC, ssic_code ASC NULLS LAST LIMIT 10)
SELECT t.ssic_code, d.ssic_description, t.count FROM top t
LEFT JOIN (SELECT ssic_code, min(ssic_description) AS ssic_description FROM ssic_dim
           WHERE ssic_code IS NOT NULL AND ssic_code <> '' GROUP BY 1) d ON t.ssic_code = d.ssic_code""")
def q3_top_ssic(spark, sf):
    fact = W.warehouse_fact(spark, sf)
    return API.top_ssic(fact, W.ssic_dim(spark, sf), as_of=WHOLE[1], date_from=WHOLE[0], limit=10)


_HOT_SQL = O.with_fact(O.SUBZONE) + f"""
, hot AS (
  SELECT s.subzone_id, s.name, s.planning_area_id, s.geometry, count(*) AS count
  FROM fact e LEFT JOIN subzone s ON e.subzone_id = s.subzone_id
  WHERE {_w(*WHOLE).replace('registration', 'e.registration')}
    AND s.geometry IS NOT NULL AND s.geometry <> ''
  GROUP BY 1, 2, 3, 4)"""


@register("Q4_hotspots", _HOT_SQL + " SELECT * FROM hot ORDER BY count DESC, subzone_id")
def q4_hotspots(spark, sf):
    fact = W.warehouse_fact(spark, sf)
    return A.hotspots(fact, W.subzone_dim(spark, sf), FL.date_between(*WHOLE))


@register("W1_hotspot_intensity", _HOT_SQL + """
SELECT subzone_id, coalesce(nullif(name, ''), nullif(subzone_id, ''), 'Unknown') AS display_name,
       coalesce(planning_area_id, '') AS planning_area_id, count,
       count / greatest((SELECT max(count) FROM hot), 1) AS intensity,
       0.15 + count / greatest((SELECT max(count) FROM hot), 1) * 0.6 AS fill_opacity
FROM hot WHERE geometry IS NOT NULL AND length(trim(geometry)) > 0 AND json_valid(geometry)""")
def w1_hotspot_intensity(spark, sf):
    return A.hotspot_intensity(q4_hotspots(spark, sf))


@register("Q1_overview", O.with_fact() + f"""
, cur AS (SELECT * FROM fact WHERE {_w(*YEAR_2000)}),
tot AS (SELECT (SELECT count(*) FROM cur) AS value,
               (SELECT count(*) FROM fact WHERE {_w(dt.date(1999, 1, 1), dt.date(1999, 12, 31))}) AS prev_value),
ts AS (SELECT primary_ssic_norm AS k, count(*) AS n FROM cur GROUP BY 1
       ORDER BY n DESC, k ASC NULLS LAST LIMIT 1),
tp AS (SELECT planning_area_id AS k, count(*) AS n FROM cur GROUP BY 1
       ORDER BY n DESC, k ASC NULLS LAST LIMIT 1),
tz AS (SELECT subzone_id AS k, count(*) AS n FROM cur GROUP BY 1
       ORDER BY n DESC, k ASC NULLS LAST LIMIT 1)
SELECT DATE '2000-01-01' AS period_start, DATE '2000-12-31' AS period_end,
       'new_entities_30d' AS label, value, prev_value,
       CASE WHEN prev_value <> 0 THEN round((value - prev_value) / prev_value * 100, 2) END AS change_yoy_pct,
       (SELECT k FROM ts) AS top_ssic_code,
       CASE WHEN (SELECT k FROM ts) IS NOT NULL THEN (SELECT n FROM ts) END AS top_ssic_count,
       CASE WHEN (SELECT k FROM tp) IS NOT NULL THEN (SELECT k FROM tp)
            WHEN (SELECT k FROM tz) IS NOT NULL THEN (SELECT k FROM tz) ELSE 'UNMAPPED' END AS hottest_area_id,
       CASE WHEN (SELECT k FROM tp) IS NOT NULL THEN (SELECT n FROM tp)
            WHEN (SELECT k FROM tz) IS NOT NULL THEN (SELECT n FROM tz) ELSE value END AS hottest_count,
       CASE WHEN (SELECT k FROM tp) IS NOT NULL THEN 'planning_area'
            WHEN (SELECT k FROM tz) IS NOT NULL THEN 'subzone' ELSE 'unmapped' END AS hottest_area_type
FROM tot""")
def q1_overview(spark, sf):
    fact = W.warehouse_fact(spark, sf)
    return A.overview(fact, *YEAR_2000)


_SEARCH_WHERE = (
    f"(position(lower('{SEARCH_Q}') IN lower(entity_name)) > 0 OR uen = '{SEARCH_Q}') "
    "AND entity_status_description = 'F'"
)
_SEARCH_ORDER = "registration_incorporation_date DESC NULLS LAST, uen ASC, " + ", ".join(
    f"{c} ASC NULLS LAST" for c in SEARCH_COLUMNS if c not in ("registration_incorporation_date", "uen")
)


def _search_cond():
    return FL.all_of(FL.text_search(SEARCH_Q), FL.status_filter("F"))


@register("Q5_search_page", O.with_fact() + f"""
SELECT {', '.join(SEARCH_COLUMNS)} FROM fact WHERE {_SEARCH_WHERE}
ORDER BY {_SEARCH_ORDER} LIMIT 50 OFFSET 10""")
def q5_search_page(spark, sf):
    fact = W.warehouse_fact(spark, sf)
    return API.search(fact, q=SEARCH_Q, status="F", limit=50, offset=10)[1]


@register("Q5_search_total", O.with_fact() + f"""
SELECT count(*) AS total FROM fact WHERE {_SEARCH_WHERE}""")
def q5_search_total(spark, sf):
    return A.search_total(W.warehouse_fact(spark, sf), _search_cond())


# Rare, frequent, short and absent texts, one with a quote, one that is a key.
SEARCH_TEXTS = ["order 123", "RDER 77 ", "line 7", "99", "ne", 'er "5', "order 1 line", "no such name", "00000007K", "12\nline"]


@register("F5_search_by_index", O.with_fact() + """
, asked(q) AS (VALUES """ + ", ".join("('" + t.replace("\n", "' || chr(10) || '") + "')" for t in SEARCH_TEXTS) + """)
SELECT q, uen, entity_name, registration_incorporation_date FROM fact, asked
WHERE position(lower(q) IN lower(entity_name)) > 0 OR uen = q""")
def f5_search_by_index(spark, sf):
    return NI.search_texts(W.name_index(spark, sf), SEARCH_TEXTS)


@register("Q5_search_page_by_index", O.with_fact() + f"""
SELECT {', '.join(SEARCH_COLUMNS)} FROM fact WHERE position('order 12' IN lower(entity_name)) > 0
ORDER BY {_SEARCH_ORDER} LIMIT 50 OFFSET 10""")
def q5_search_page_by_index(spark, sf):
    return API.search(W.warehouse_fact(spark, sf), q="Order 12", limit=50, offset=10, index=W.name_index(spark, sf))[1]


@register("L2_deep_page", O.with_fact() + f"""
SELECT {', '.join(SEARCH_COLUMNS)} FROM fact WHERE entity_status_description = 'F'
ORDER BY {_SEARCH_ORDER} LIMIT 50 OFFSET 15000""")
def l2_deep_page(spark, sf):
    return API.search(W.warehouse_fact(spark, sf), status="F", limit=50, offset=15000)[1]


_DETAIL_ORDER = "registration_incorporation_date DESC NULLS LAST, " + ", ".join(
    f"{c} ASC NULLS LAST" for c in DETAIL_COLUMNS if c != "registration_incorporation_date"
)


@register("Q6_entity_detail", O.with_fact() + f"""
SELECT {', '.join(DETAIL_COLUMNS)} FROM fact WHERE uen = '{DETAIL_UEN}'
ORDER BY {_DETAIL_ORDER} LIMIT 1""")
def q6_entity_detail(spark, sf):
    return API.entity_detail(W.warehouse_fact(spark, sf), DETAIL_UEN)


# ------------------------------------------------- cleaning / dedup / profile ---


_KEEP = ", ".join(KEEP_COLUMNS)


@register("P10_clean_record", "WITH " + O.EXTRACT + f" SELECT {O.clean_cols()} FROM ext")
def p10_clean_record(spark, sf):
    return W.clean_extract(spark, sf)


@register("P7_load_raw", O.with_fact() + f" SELECT {_KEEP} FROM raw")
def p7_load_raw(spark, sf):
    return W.raw_fact(spark, sf)


_DEDUP_SQL = "WITH " + ",".join([O.EXTRACT, O.CLEAN]) + f"""
, dd AS (
  SELECT {_KEEP} FROM (
    SELECT *, row_number() OVER (PARTITION BY uen
        ORDER BY registration_incorporation_date DESC NULLS LAST, {O.ORDER_COLS},
                 {", ".join(c + " ASC NULLS FIRST" for c in KEEP_COLUMNS[1:])}) AS rn
    FROM cln WHERE uen IS NOT NULL AND uen <> '') WHERE rn = 1)"""


def _dedup(spark, sf):
    c = W.clean_extract(spark, sf, with_order=True)
    return D.dedup_keep_latest(c, "uen", "registration_incorporation_date", "_ord").select(*KEEP_COLUMNS)


@register("A9_dedup_keep_latest", _DEDUP_SQL + " SELECT * FROM dd")
def a9_dedup_keep_latest(spark, sf):
    return _dedup(spark, sf)


@register("A10_latest_order_per_customer", """
SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1""")
def a10_latest_order_per_customer(spark, sf):
    o = tpch.table(spark, sf, "orders")
    return D.latest_by_key(o, "o_custkey", "o_orderdate", tiebreak=["o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


_PROFILE_UNION = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total_rows, "
    f"count(*) FILTER (WHERE {c} IS NULL OR CAST({c} AS VARCHAR) = '') AS null_count FROM dd"
    for c in KEEP_COLUMNS
)


@register("A11_profile_nulls", _DEDUP_SQL + f"""
SELECT column_name, total_rows, null_count,
       CASE WHEN total_rows = 0 THEN 0.0 ELSE null_count * 100.0 / total_rows END AS null_percent
FROM ({_PROFILE_UNION})""")
def a11_profile_nulls(spark, sf):
    return PR.profile_nulls(_dedup(spark, sf), KEEP_COLUMNS)


@register("A11_profile_distinct", _DEDUP_SQL + """
SELECT count(*) AS total_rows,
       coalesce(string_agg(DISTINCT nullif(entity_status_description, ''), ','
                ORDER BY nullif(entity_status_description, '')), '') AS distinct_status,
       coalesce(string_agg(DISTINCT nullif(entity_type_description, ''), ','
                ORDER BY nullif(entity_type_description, '')), '') AS distinct_type
FROM dd""")
def a11_profile_distinct(spark, sf):
    return PR.profile_distinct(_dedup(spark, sf))


# ------------------------------------------------------------ enrich / geo ---

@register("J1_enrich_geo", O.with_fact() + " SELECT * FROM fact")
def j1_enrich_geo(spark, sf):
    return W.enriched_fact(spark, sf)


@register("T4_rebuild_enriched", O.with_fact() + " SELECT * FROM fact WHERE registration_incorporation_date IS NOT NULL")
def t4_rebuild_enriched(spark, sf):
    return W.enriched_fact(spark, sf, drop_undated=True)


_NEW_POSTALS = """
SELECT DISTINCT postal_code FROM raw
WHERE postal_code IS NOT NULL AND postal_code NOT IN (SELECT postal_code FROM geo)"""


@register("J4_new_postals", O.with_fact() + _NEW_POSTALS)
def j4_new_postals(spark, sf):
    return EN.new_postals(W.raw_fact(spark, sf), tpch.postal_geo(spark, sf))


@register("A7_remaining_postals", O.with_fact() + f" SELECT count(*) AS remaining_postals FROM ({_NEW_POSTALS})")
def a7_remaining_postals(spark, sf):
    return EN.remaining_postals(W.raw_fact(spark, sf), tpch.postal_geo(spark, sf))


@register("L4_postal_worklist", O.with_fact() + _NEW_POSTALS + " ORDER BY postal_code LIMIT 3")
def l4_postal_worklist(spark, sf):
    return EN.postal_worklist(W.raw_fact(spark, sf), tpch.postal_geo(spark, sf), limit=3)


@register("A8_distinct_months", O.with_fact() + f"""
SELECT DISTINCT {O.month('registration_incorporation_date')} AS month FROM raw
WHERE registration_incorporation_date IS NOT NULL ORDER BY month""")
def a8_distinct_months(spark, sf):
    raw = W.raw_fact(spark, sf)
    return (raw.filter(F.col("registration_incorporation_date").isNotNull())
            .select(A.yyyymm_col("registration_incorporation_date").alias("month"))
            .distinct().orderBy("month"))


# ---------------------------------------------------------------- rollups ---

def _rollup_sql(name: str, where: str = "TRUE") -> str:
    keys = RU.ROLLUP_KEYS[name]
    k = ", ".join(keys)
    return f"SELECT {k}, count(*) AS new_entities FROM fact WHERE {where} GROUP BY {k}"


_ROLLUP_IDS = {
    "R1": "new_entities_monthly_by_ssic",
    "R2": "new_entities_monthly_by_subzone",
    "R3": "new_entities_monthly_by_planning_area",
    "R4": "top_ssic_by_area_month",
}


def _make_rollup(name):
    def fn(spark, sf):
        return RU.rollup(W.warehouse_fact(spark, sf), name)
    return fn


for _rid, _name in _ROLLUP_IDS.items():
    register(f"{_rid}_{_name}", O.with_fact() + " " + _rollup_sql(_name))(_make_rollup(_name))


def _merged_sql(name: str) -> str:
    keys = RU.ROLLUP_KEYS[name]
    text = [k for k in keys if k != "registration_month"]
    sel = ", ".join(
        ["registration_month"]
        + [f"CASE WHEN coalesce({k}, '') = '' AND bool_or({k} IS NULL) THEN NULL "
           f"ELSE coalesce({k}, '') END AS {k}" for k in text]
    )
    grp = ", ".join(["registration_month"] + [f"coalesce({k}, '')" for k in text])
    return f"SELECT {sel}, count(*) AS new_entities FROM fact GROUP BY {grp}"


@register("R5_merge_rollup", O.with_fact() + " " + _merged_sql("top_ssic_by_area_month"))
def r5_merge_rollup(spark, sf):
    name = "top_ssic_by_area_month"
    fact = W.warehouse_fact(spark, sf)
    old = RU.rollup(fact.filter(F.col("registration_month") < 200001), name)
    delta = RU.rollup(fact.filter(F.col("registration_month") >= 200001), name)
    return RU.merge_rollup(old, delta, name)


# ------------------------------------------------------- area comparisons ---

COMPARE_AREAS = ["AMERICA", "ASIA"]
COMPARE_WINDOW = (dt.date(1999, 1, 1), dt.date(2000, 12, 31))


@register("A6_compare_areas", O.with_fact() + f"""
SELECT registration_month AS month, planning_area_id, count(*) AS count FROM fact
WHERE {_w(*COMPARE_WINDOW)} AND planning_area_id IN ('AMERICA', 'ASIA')
  AND starts_with(primary_ssic_norm, '00')
GROUP BY 1, 2 ORDER BY 1, 2""")
def a6_compare_areas(spark, sf):
    fact = W.warehouse_fact(spark, sf)
    cond = FL.all_of(FL.date_between(*COMPARE_WINDOW), FL.area_in(COMPARE_AREAS), FL.ssic_prefix("00"))
    return A.count_by_month_area(fact, cond)


@register("A4_top_planning_areas", O.with_fact() + f"""
SELECT planning_area_id, count(*) AS count FROM fact WHERE {_w(*WHOLE)}
GROUP BY 1 ORDER BY count DESC, planning_area_id ASC NULLS LAST LIMIT 10""")
def a4_top_planning_areas(spark, sf):
    return A.top_by_key(W.warehouse_fact(spark, sf), FL.date_between(*WHOLE), "planning_area_id", 10)


@register("A4_top_subzones_in_area", O.with_fact() + f"""
SELECT subzone_id, count(*) AS count FROM fact WHERE {_w(*WHOLE)} AND planning_area_id = 'ASIA'
GROUP BY 1 ORDER BY count DESC, subzone_id ASC NULLS LAST LIMIT 10""")
def a4_top_subzones_in_area(spark, sf):
    cond = FL.all_of(FL.date_between(*WHOLE), FL.area_filter("ASIA"))
    return A.top_by_key(W.warehouse_fact(spark, sf), cond, "subzone_id", 10)


#: A window that begins and ends inside a month: whole months from R1-R4, edge days from the fact.
EDGED = (dt.date(1995, 3, 17), dt.date(1998, 8, 20))


@register("Q2_trend_by_rollup", O.with_fact() + f"""
SELECT registration_month AS month, count(*) AS count FROM fact
WHERE {_w(*EDGED)} AND planning_area_id = 'ASIA' GROUP BY 1""")
def q2_trend_by_rollup(spark, sf):
    return API.trends(W.warehouse_fact(spark, sf), as_of=EDGED[1], date_from=EDGED[0], area="ASIA",
                      rollups=W.rollups(spark, sf))


@register("Q3_top_ssic_by_rollup", O.with_fact(O.SSIC_DIM) + f"""
, top AS (
  SELECT primary_ssic_norm AS ssic_code, count(*) AS count FROM fact
  WHERE {_w(*EDGED)} AND planning_area_id = 'ASIA'
  GROUP BY 1 ORDER BY count DESC, ssic_code ASC NULLS LAST LIMIT 10)
SELECT t.ssic_code, d.ssic_description, t.count FROM top t
LEFT JOIN (SELECT ssic_code, min(ssic_description) AS ssic_description FROM ssic_dim
           WHERE ssic_code IS NOT NULL AND ssic_code <> '' GROUP BY 1) d ON t.ssic_code = d.ssic_code""")
def q3_top_ssic_by_rollup(spark, sf):
    return API.top_ssic(W.warehouse_fact(spark, sf), W.ssic_dim(spark, sf), as_of=EDGED[1], date_from=EDGED[0],
                        area="ASIA", limit=10, rollups=W.rollups(spark, sf))


@register("A4_top_subzones_by_rollup", O.with_fact() + f"""
SELECT subzone_id, count(*) AS count FROM fact WHERE {_w(*EDGED)}
GROUP BY 1 ORDER BY count DESC, subzone_id ASC NULLS LAST LIMIT 10""")
def a4_top_subzones_by_rollup(spark, sf):
    counts = WN.count_in_keys(W.warehouse_fact(spark, sf), W.rollups(spark, sf), *EDGED, ["subzone_id"])
    return WN.top_of(counts, "subzone_id")


@register("A1_count_in_window", O.with_fact() + f"""
SELECT count(*) AS count FROM fact WHERE {_w(*YEAR_2000)} AND subzone_id = 'NATION_3'""")
def a1_count_in_window(spark, sf):
    cond = FL.all_of(FL.date_between(*YEAR_2000), FL.area_filter("NATION_3", "subzone"))
    return A.count_in_window(W.warehouse_fact(spark, sf), cond)


@register("Q1_overview_area", O.with_fact() + f"""
, cur AS (SELECT * FROM fact WHERE {_w(*YEAR_2000)} AND starts_with(primary_ssic_norm, '001')),
tot AS (SELECT (SELECT count(*) FROM cur WHERE planning_area_id = 'EUROPE') AS value,
               (SELECT count(*) FROM fact WHERE {_w(dt.date(1999, 1, 1), dt.date(1999, 12, 31))}
                  AND starts_with(primary_ssic_norm, '001') AND planning_area_id = 'EUROPE') AS prev_value),
ts AS (SELECT primary_ssic_norm AS k, count(*) AS n FROM cur WHERE planning_area_id = 'EUROPE' GROUP BY 1
       ORDER BY n DESC, k ASC NULLS LAST LIMIT 1),
tp AS (SELECT planning_area_id AS k, count(*) AS n FROM cur GROUP BY 1
       ORDER BY n DESC, k ASC NULLS LAST LIMIT 1),
tz AS (SELECT subzone_id AS k, count(*) AS n FROM cur GROUP BY 1
       ORDER BY n DESC, k ASC NULLS LAST LIMIT 1)
SELECT DATE '2000-01-01' AS period_start, DATE '2000-12-31' AS period_end,
       'new_entities_30d' AS label, value, prev_value,
       CASE WHEN prev_value <> 0 THEN round((value - prev_value) / prev_value * 100, 2) END AS change_yoy_pct,
       (SELECT k FROM ts) AS top_ssic_code,
       CASE WHEN (SELECT k FROM ts) IS NOT NULL THEN (SELECT n FROM ts) END AS top_ssic_count,
       CASE WHEN (SELECT k FROM tp) IS NOT NULL THEN (SELECT k FROM tp)
            WHEN (SELECT k FROM tz) IS NOT NULL THEN (SELECT k FROM tz) ELSE 'UNMAPPED' END AS hottest_area_id,
       CASE WHEN (SELECT k FROM tp) IS NOT NULL THEN (SELECT n FROM tp)
            WHEN (SELECT k FROM tz) IS NOT NULL THEN (SELECT n FROM tz) ELSE value END AS hottest_count,
       CASE WHEN (SELECT k FROM tp) IS NOT NULL THEN 'planning_area'
            WHEN (SELECT k FROM tz) IS NOT NULL THEN 'subzone' ELSE 'unmapped' END AS hottest_area_type
FROM tot""")
def q1_overview_area(spark, sf):
    fact = W.warehouse_fact(spark, sf)
    return A.overview(fact, *YEAR_2000, ssic_cond=FL.ssic_pattern_filter(["001*"]),
                      area_cond=FL.area_filter("EUROPE"))


# --------------------------------------------------------------- taxonomy ---


_TAX = TS.PACKAGED


def _cats(spark):
    return TS.categories(TS.read_taxonomy(spark, _TAX))


@register("J6_category_counts", O.with_fact(O.taxonomy_ctes(_TAX)) + f"""
SELECT c.id AS category_id, c.label AS label,
  (SELECT count(*) FROM fact f WHERE {_w(*WHOLE)} AND EXISTS (
     SELECT 1 FROM pats p WHERE p.category_id = c.id AND (
       (p.pattern LIKE '%*' AND starts_with(f.primary_ssic_norm, rtrim(p.pattern, '*')))
       OR (p.pattern NOT LIKE '%*' AND f.primary_ssic_norm = p.pattern)))) AS count
FROM cats c""")
def j6_category_counts(spark, sf):
    fact = W.warehouse_fact(spark, sf)
    return TX.category_counts(fact, _cats(spark), FL.date_between(*WHOLE))


@register("F2_category_trend", O.with_fact() + f"""
SELECT registration_month AS month, count(*) AS count FROM fact
WHERE {_w(*WHOLE)} AND (starts_with(primary_ssic_norm, '0062') OR primary_ssic_norm = '00620')
GROUP BY 1 ORDER BY 1""")
def f2_category_trend(spark, sf):
    fact = W.warehouse_fact(spark, sf)
    pats = FL.resolve_ssic_patterns(None, "software", _cats(spark))
    return A.count_by_month(fact, FL.all_of(FL.date_between(*WHOLE), FL.ssic_pattern_filter(pats)))


@register("Q10_taxonomy_search", "WITH " + O.taxonomy_ctes(_TAX) + "," + O.TERMS + """
SELECT t.query, coalesce(c.sector, 'other') AS sector,
       coalesce(s.label, coalesce(c.sector, 'other')) AS sector_label,
       c.id AS category_id, c.label AS category_label
FROM terms t JOIN cats c ON (
    contains(lower(c.label), lower(trim(t.query)))
    OR EXISTS (SELECT 1 FROM (SELECT unnest(c.keywords) AS k) kk WHERE contains(lower(kk.k), lower(trim(t.query)))))
LEFT JOIN secs s ON s.id = c.sector""")
def q10_taxonomy_search(spark, sf):
    tax = TS.read_taxonomy(spark, _TAX)
    return TX.taxonomy_search(tpch.search_terms(spark, sf), TS.categories(tax), TS.sectors(tax))


@register("Q11_resolve_category", "WITH " + O.taxonomy_ctes(_TAX) + "," + O.TERMS + """
, lh AS (SELECT lower(label) AS k, arg_min(id, pos) AS id FROM cats GROUP BY 1),
kh AS (SELECT lower(kw) AS k, arg_min(id, pos) AS id FROM (SELECT id, pos, unnest(keywords) AS kw FROM cats) GROUP BY 1)
SELECT t.query AS text,
  CASE WHEN trim(t.query) = '' THEN 'none' WHEN lh.id IS NOT NULL THEN 'label' WHEN kh.id IS NOT NULL THEN 'keyword'
       WHEN regexp_full_match(trim(t.query), '[0-9]+') THEN 'ssic' ELSE 'none' END AS match_type,
  CASE WHEN trim(t.query) = '' THEN NULL ELSE coalesce(lh.id, kh.id) END AS category_id,
  CASE WHEN coalesce(lh.id, kh.id) IS NULL AND regexp_full_match(trim(t.query), '[0-9]+') THEN trim(t.query) END AS ssic
FROM terms t LEFT JOIN lh ON lh.k = lower(trim(t.query)) LEFT JOIN kh ON kh.k = lower(trim(t.query))""")
def q11_resolve_category(spark, sf):
    return TX.resolve_category(tpch.search_terms(spark, sf, col="text"), _cats(spark))


# -------------------------------------------------------------- questions ---


AS_OF = dt.date.fromisoformat(tpch.AS_OF)
_PARSED_COLS = ["question_id", "intent", "start_date", "end_date", "ssic", "area", "area_1", "area_2", "uen", "error"]
_Q_BASE = O.with_fact() + "," + O.parse_sql(tpch.AS_OF)
_DETAIL_ORDER_NL = "registration_incorporation_date DESC NULLS LAST, " + ", ".join(
    f"{c} ASC NULLS LAST" for c in DETAIL_COLUMNS if c not in ("uen", "registration_incorporation_date")
)


def _parsed(spark, sf, materialise: bool = False):
    parsed = QN.parse_questions(tpch.questions(spark, sf), AS_OF)
    return cut_lineage(parsed) if materialise else parsed


@register("N8_parse_questions", "WITH " + O.parse_sql(tpch.AS_OF) + f" SELECT {', '.join(_PARSED_COLS)} FROM parsed")
def n8_parse_questions(spark, sf):
    return _parsed(spark, sf).select(*_PARSED_COLS)


@register("N16_answer_questions", _Q_BASE + O.answers_sql() + " SELECT * FROM ans")
def n16_answer_questions(spark, sf):
    return QN.answer_rows(_parsed(spark, sf), W.warehouse_fact(spark, sf))


@register("N13_entity_lookups", _Q_BASE + O.lookups_sql(DETAIL_COLUMNS, _DETAIL_ORDER_NL) + " SELECT * FROM lk")
def n13_entity_lookups(spark, sf):
    return QN.entity_lookups(_parsed(spark, sf, materialise=True), W.warehouse_fact(spark, sf))


@register("N15_narratives", _Q_BASE + O.answers_sql() + O.lookups_sql(DETAIL_COLUMNS, _DETAIL_ORDER_NL)
          + O.NARRATIVES + " SELECT * FROM nar")
def n15_narratives(spark, sf):
    parsed = _parsed(spark, sf, materialise=True)
    fact = W.warehouse_fact(spark, sf)
    return QN.narratives(parsed, QN.answer_rows(parsed, fact), QN.entity_lookups(parsed, fact))


@register("Q9_chat", _Q_BASE + O.answers_sql() + O.lookups_sql(DETAIL_COLUMNS, _DETAIL_ORDER_NL)
          + O.NARRATIVES + " SELECT * FROM nar")
def q9_chat(spark, sf):
    return API.chat(tpch.questions(spark, sf), W.warehouse_fact(spark, sf), AS_OF)["narratives"]


# ---------------------------------------------------------------- spatial ---


def _layer(spark, id_keys):
    return GJ.match_layer(GJ.read_features(spark, GJ.PACKAGED_ZONES), id_keys)


def _postal_points(spark, sf):
    return tpch.supplier_points(spark, sf)


@register("J5_point_in_polygon_subzone",
          O.pip_sql(O.POSTAL_POINTS, GJ.PACKAGED_ZONES, GJ.SUBZONE_MATCH_KEYS, "subzone_id")
          + " SELECT pid AS postal_code, subzone_id FROM hit")
def j5_pip_subzone(spark, sf):
    hits = SP.point_in_polygon(_postal_points(spark, sf), _layer(spark, GJ.SUBZONE_MATCH_KEYS),
                               x_col="longitude", y_col="latitude", key_col="postal_code")
    return hits.withColumnRenamed("feature_id", "subzone_id")


@register("J5_point_in_polygon_planning",
          O.pip_sql(O.POSTAL_POINTS, GJ.PACKAGED_ZONES, GJ.PLANNING_MATCH_KEYS, "planning_area_id")
          + " SELECT pid AS postal_code, planning_area_id FROM hit")
def j5_pip_planning(spark, sf):
    hits = SP.point_in_polygon(_postal_points(spark, sf), _layer(spark, GJ.PLANNING_MATCH_KEYS),
                               x_col="longitude", y_col="latitude", key_col="postal_code")
    return hits.withColumnRenamed("feature_id", "planning_area_id")


#: Areas of one landed file.
FILE_AREAS = 25
#: Areas made of suppliers, their corners, and customers as points on a grid of quarter units.
_AREAS_SQL = """
WITH area AS (
  SELECT s_suppkey AS k, s_suppkey * 4 AS x0,
         CASE WHEN s_suppkey % 50 = 0 THEN 0 ELSE s_suppkey * 91 % 100 END AS y0,
         CASE WHEN s_suppkey % 50 = 0 THEN 400 ELSE 1 + s_suppkey % 7 END AS w,
         CASE WHEN s_suppkey % 50 = 0 THEN 100 ELSE 1 + s_suppkey % 11 END AS h FROM supplier),
place AS (
  SELECT c_custkey, (c_custkey * 16 // 15) / 4.0 AS x, (c_custkey * 104729 % 400) / 4.0 AS y FROM customer)"""


def _write_areas(spark, sf) -> str:
    """Land an area per supplier, every fiftieth a large one, in files of ``FILE_AREAS``."""
    k = F.col("s_suppkey").cast("long")
    large = k % 50 == 0
    x0, y0 = k * 4, F.when(large, F.lit(0)).otherwise(k * 91 % 100)
    x1 = x0 + F.when(large, F.lit(400)).otherwise(1 + k % 7)
    y1 = y0 + F.when(large, F.lit(100)).otherwise(1 + k % 11)
    ring = F.to_json(F.array(*[F.array(x, y) for x, y in [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"SUBZONE_C":"'), k.cast("string"),
                       F.lit('"},"geometry":{"type":"Polygon","coordinates":['), ring, F.lit("]}}"))
    root = shared_dir(spark, "areas")
    # at most FILE_AREAS features per group
    listed = F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), feature.alias("f")))), lambda x: x["f"])
    tpch.table(spark, sf, "supplier").groupBy(
        F.lpad(F.floor(k / FILE_AREAS).cast("string"), 12, "0").alias("file")
    ).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}"))
          .alias("value")).write.partitionBy("file").text(root)
    return root


@register("S3_layer_of_files", _AREAS_SQL + f"""
SELECT (k // {FILE_AREAS} - min(k // {FILE_AREAS}) OVER ()) * 4294967296
         + row_number() OVER (PARTITION BY k // {FILE_AREAS} ORDER BY k) - 1 AS seq,
       CAST(k AS VARCHAR) AS feature_id FROM area""")
def s3_layer_of_files(spark, sf):
    return GJ.match_layer(GJ.read_features(spark, _write_areas(spark, sf)), GJ.SUBZONE_MATCH_KEYS).drop("geometry")


@register("J5_areas_of_files", _AREAS_SQL + """
SELECT c_custkey, CAST(min(k) AS VARCHAR) AS feature_id FROM place JOIN area
ON x > x0 AND x < x0 + w AND y > y0 AND y < y0 + h GROUP BY c_custkey""")
def j5_areas_of_files(spark, sf):
    layer = GJ.match_layer(GJ.read_features(spark, _write_areas(spark, sf)), GJ.SUBZONE_MATCH_KEYS)
    key = F.col("c_custkey").cast("long")
    places = tpch.table(spark, sf, "customer").select(
        "c_custkey", (F.floor(key * 16 / 15) / 4.0).alias("x"), (key * 104729 % 400 / 4.0).alias("y"))
    return SP.point_in_polygon(places, layer, key_col="c_custkey")


# ------------------------------------------------------------- pipelines ---


GEO_UPDATED_AT = dt.datetime(2024, 6, 1)


def _new_geo(spark, sf):
    return PL.geo_enrich(
        W.raw_fact(spark, sf), tpch.postal_geo(spark, sf), tpch.supplier_points(spark, sf),
        _layer(spark, GJ.SUBZONE_MATCH_KEYS), _layer(spark, GJ.PLANNING_MATCH_KEYS), GEO_UPDATED_AT,
    )


_T3_SQL = (
    O.with_fact() + ",\n" + O.POSTAL_POINTS + ","
    + O.pip_ctes(GJ.PACKAGED_ZONES, GJ.SUBZONE_MATCH_KEYS, "subzone_id", "s") + ","
    + O.pip_ctes(GJ.PACKAGED_ZONES, GJ.PLANNING_MATCH_KEYS, "planning_area_id", "p") + """,
work AS (SELECT DISTINCT postal_code FROM raw
         WHERE postal_code IS NOT NULL AND postal_code NOT IN (SELECT postal_code FROM geo)),
newgeo AS (
  SELECT w.postal_code, p.y AS latitude, p.x AS longitude, hs.subzone_id, hp.planning_area_id
  FROM work w LEFT JOIN pts p ON p.pid = w.postal_code
  LEFT JOIN hit_s hs ON hs.pid = w.postal_code LEFT JOIN hit_p hp ON hp.pid = w.postal_code)"""
)


@register("T3_geo_enrich", _T3_SQL + " SELECT * FROM newgeo")
def t3_geo_enrich(spark, sf):
    return _new_geo(spark, sf).drop("updated_at")


@register("T3_rollup_after_geo", _T3_SQL + """,
geo2 AS (SELECT postal_code, latitude, longitude, subzone_id, planning_area_id FROM lgeo
         UNION ALL SELECT * FROM newgeo)
SELECT """ + O.month("r.registration_incorporation_date") + """ AS registration_month, g.planning_area_id,
       count(*) AS new_entities
FROM raw r LEFT JOIN geo2 g ON r.postal_code = g.postal_code GROUP BY 1, 2""")
def t3_rollup_after_geo(spark, sf):
    geo = PL.upsert_postal_geo(tpch.postal_geo(spark, sf), _new_geo(spark, sf))
    fact = PL.rebuild_enriched(W.raw_fact(spark, sf), geo)
    return RU.rollup(fact, "new_entities_monthly_by_planning_area")


@register("R4_refresh_by_deltas", _T3_SQL + """,
geo2 AS (SELECT postal_code, subzone_id, planning_area_id FROM lgeo
         UNION ALL SELECT postal_code, subzone_id, planning_area_id FROM newgeo)
SELECT """ + O.month("r.registration_incorporation_date") + """ AS registration_month, g.planning_area_id,
       r.primary_ssic_norm, count(*) AS new_entities
FROM (SELECT registration_incorporation_date, postal_code, primary_ssic_norm FROM fact) r
LEFT JOIN geo2 g ON r.postal_code = g.postal_code GROUP BY 1, 2, 3""")
def r4_refresh_by_deltas(spark, sf):
    fact = W.warehouse_fact(spark, sf)
    name = "top_ssic_by_area_month"
    rollups = WN.Rollups(spark, shared_dir(spark, "rollups-refreshed")).write(fact)
    stage = shared_dir(spark, "rollups-stage")
    WN.stage_refresh(rollups, fact, cut_lineage(_new_geo(spark, sf)), stage, [name])
    WN.apply_refresh(rollups, stage, [name])
    return rollups.read(name)


# ------------------------------------------------------ sources (round trip) ---


def _write_registry_csv(spark, sf) -> str:
    """Land the registry extract as CSV files the way a source system might:
    two batches with different header orders, one lacking a column, one
    folder per registration year."""
    root = shared_dir(spark, "registry-csv")
    ext = tpch.registry_extract(spark, sf, with_order=True).withColumn(
        "_year", F.substring("registration_incorporation_date", 1, 4))
    iso = F.col("registration_incorporation_date").contains("-")
    a_cols = list(reversed(KEEP_COLUMNS))
    b_cols = [c for c in KEEP_COLUMNS if c != "company_type_description"]
    # A key's rows land in one file per batch and year, in line order, so that
    # arrival order is a matter of the data and not of task timing.
    placed = ext.repartition("uen").sortWithinPartitions("_year", "uen", "_ord", *KEEP_COLUMNS)
    for name, which, cols in (("batch_a", iso, a_cols), ("batch_b", ~iso, b_cols)):
        placed.filter(which).select(*cols, "_year").write.partitionBy("_year").options(
            **RC.WRITE_DIALECT).csv(f"{root}/{name}")
    return root


_S1_CLEAN = O.clean_cols().replace(
    f"{O.na('company_type_description')} AS company_type_description",
    f"CASE WHEN contains(registration_incorporation_date, '-') THEN {O.na('company_type_description')} "
    "END AS company_type_description")


@register("S1_read_registry_csv", "WITH " + O.EXTRACT + f" SELECT {_S1_CLEAN} FROM ext")
def s1_read_registry_csv(spark, sf):
    raw = RC.read_registry_csv(spark, _write_registry_csv(spark, sf))
    return _clean_record(raw)


@register("S1_read_split_csv", "WITH " + O.EXTRACT + f" SELECT {_S1_CLEAN} FROM ext")
def s1_read_split_csv(spark, sf):
    """The same files, the large ones cut into ranges that begin anywhere."""
    root = _write_registry_csv(spark, sf)
    size = max(1024, max(n for _, n in RC.list_files(spark, root)) // 3)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        raw = cut_lineage(RC.read_registry_csv(spark, root, split_above=size))
    finally:
        spark.conf.set(name, before)
    return _clean_record(raw)


@register("A12_per_file_report", "WITH " + O.EXTRACT + """
SELECT CASE WHEN contains(registration_incorporation_date, '-') THEN 'batch_a' ELSE 'batch_b' END
       || '/' || substr(registration_incorporation_date, 1, 4) AS resource_id,
       count(*) AS fetched_rows, CAST(0 AS BIGINT) AS error_rows
FROM ext GROUP BY 1""")
def a12_per_file_report(spark, sf):
    raw = RC.read_registry_csv(spark, _write_registry_csv(spark, sf))
    folder = F.regexp_extract("source_file", r"(batch_[ab])/_year=([0-9]{4})/", 0)
    rep = PR.per_file_report(raw.withColumn("source_file", F.regexp_replace(
        F.regexp_replace(folder, "/_year=", "/"), "/$", "")), error_col=RC.CORRUPT)
    return rep.select("resource_id", "fetched_rows", "error_rows")


# Arrival order of a key's rows: batch a before b, its folders by year, rows by line order.
_T1_SQL = "WITH " + ",".join([O.EXTRACT]) + f"""
, cln AS (SELECT {_S1_CLEAN}, contains(ext.registration_incorporation_date, '-') AS batch_a,
                 substr(ext.registration_incorporation_date, 1, 4) AS folder, {O.ORDER_COLS} FROM ext)
SELECT {_KEEP} FROM (
  SELECT *, row_number() OVER (PARTITION BY uen
      ORDER BY registration_incorporation_date DESC NULLS LAST, batch_a DESC, folder, {O.ORDER_COLS},
               {", ".join(c + " ASC NULLS FIRST" for c in KEEP_COLUMNS[1:])}) AS rn
  FROM cln WHERE uen IS NOT NULL AND uen <> '') WHERE rn = 1"""


@register("T1_clean_registry", _T1_SQL)
def t1_clean_registry(spark, sf):
    raw = RC.read_registry_csv(spark, _write_registry_csv(spark, sf))
    return PL.clean_registry(raw)["clean"]


def _write_pages(spark, sf) -> str:
    """Land the extract as API pages: 100 order keys per page, one resource per
    10,000 keys. Every 7th page and each resource's first and last page failed (every
    other of them does not say so but lacks ``success``), and each resource ends
    with a successful page without records."""
    root = shared_dir(spark, "api-pages")
    ext = tpch.registry_extract(spark, sf, with_order=True)
    key = F.expr("CAST(substring(uen, 1, length(uen) - 1) AS BIGINT)")
    # Records are listed in line order within a page (a page is at most 100
    # order keys, so the per-page list is bounded). They are grouped as plain
    # values; the column names join them behind the shuffle.
    in_order = F.array_sort(
        F.collect_list(F.struct(F.col("_ord").alias("o"), *KEEP_COLUMNS)),
        lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0),
    )

    def named(x):
        return F.create_map(*[v for c in KEEP_COLUMNS for v in (F.lit(c), x[c])], F.lit("extra_col"), F.lit("dropped"))

    failed = (F.col("page") % 7 == 3) | (F.col("page") % 100).isin(0, 99)
    resource = F.concat(F.lit("res"), (F.col("page") / 100).cast("long").cast("string")).alias("resource_id")
    # dealt by page before they are listed: no task sorts lists of what it then sends on
    placed = ext.withColumn("page", (key / 100).cast("long"))
    pages = (
        placed.repartition("page").groupBy("page").agg(in_order.alias("listed"))
        .select(
            resource,
            ((F.col("page") % 100) * 1000).alias("offset"),
            F.when(failed & (F.col("page") % 2 == 1), F.lit(None).cast("boolean")).otherwise(~failed).alias("success"),
            F.when(failed, F.lit("HTTP 503")).alias("error"),
            F.transform("listed", named).alias("records"),
        )
    )
    # a resource's rows are counted without listing them
    totals = placed.groupBy(resource).agg(F.count(F.lit(1)).alias("total"))
    closing = totals.select(
        "resource_id", F.lit(100_000).cast("long").alias("offset"), F.lit(True).alias("success"),
        F.lit(None).cast("string").alias("error"), F.slice(F.array(F.create_map(F.lit(""), F.lit(""))), 1, 0).alias("records"))
    pages.unionByName(closing).join(totals, "resource_id").select(
        "resource_id", "offset", "success", "error",
        F.struct(F.col("total").cast("long").alias("total"), "records").alias("result"),
    ).write.option("compression", "gzip").json(root)
    return root


_PAGE_KEY = "CAST(substring(uen, 1, length(uen) - 1) AS BIGINT) // 100"
_PAGE_FAILED = f"(({_PAGE_KEY}) % 7 = 3 OR ({_PAGE_KEY}) % 100 IN (0, 99))"


@register("S2_read_api_pages", "WITH " + O.EXTRACT + f" SELECT {O.clean_cols()} FROM ext WHERE NOT {_PAGE_FAILED}")
def s2_read_api_pages(spark, sf):
    pages = AP.read_pages(spark, _write_pages(spark, sf))
    return _clean_record(AP.page_records(pages))


@register("S2_page_audit", "WITH " + O.EXTRACT + f"""
, pg AS (SELECT ({_PAGE_KEY}) AS page, NOT {_PAGE_FAILED} AS good, count(*) AS n FROM ext GROUP BY 1, 2)
SELECT 'res' || CAST(page // 100 AS VARCHAR) AS resource_id,
       CAST(sum(n) AS BIGINT) AS total_rows,
       CAST(coalesce(sum(n) FILTER (WHERE good), 0) AS BIGINT) AS fetched_rows,
       min((page % 100) * 1000) FILTER (WHERE good) AS first_offset,
       max((page % 100) * 1000) FILTER (WHERE good) AS last_offset,
       CAST(count(*) FILTER (WHERE NOT good) AS BIGINT) AS failed_pages
FROM pg GROUP BY 1""")
def s2_page_audit(spark, sf):
    return AP.page_audit(AP.read_pages(spark, _write_pages(spark, sf)))


@register("S4_read_ssic_csv", "WITH " + O.SSIC_DIM.lstrip() + " SELECT * FROM ssic_dim")
def s4_read_ssic_csv(spark, sf):
    root = shared_dir(spark, "ssic-csv")
    tpch.dim_ssic(spark, sf).toDF("SSIC_CODE", "SSIC_DESCRIPTION", "SECTION", "DIVISION").write.options(
        **RC.WRITE_DIALECT).csv(root)
    return RC.read_ssic_csv(spark, root)


@register("S6_write_clean_csv", _DEDUP_SQL + " SELECT " + ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}" if c in ("registration_incorporation_date", "uen_issue_date") else c
    for c in KEEP_COLUMNS) + " FROM dd")
def s6_write_clean_csv(spark, sf):
    path = shared_dir(spark, "clean-csv")
    RC.write_clean(_dedup(spark, sf), path)
    return spark.read.option("header", True).options(**RC.DIALECT).option("multiLine", True).csv(path).select(
        *KEEP_COLUMNS)


def _write_boundaries(spark, sf) -> str:
    """Land the nations as a boundary layer: numeric ids (the first is 0), one
    feature without an id and one with a blank id, and one without geometry."""
    na = tpch.nation_areas(spark, sf)
    key = F.col("n_nationkey")
    props = F.concat_ws(
        ",",
        F.when(key == 2, F.lit('"SUBZONE_C":""')).when(key != 1, F.concat(F.lit('"SUBZONE_C":'), key.cast("string"))),
        F.concat(F.lit('"SUBZONE_N":"'), F.col("n_name"), F.lit('"')),
        F.concat(F.lit('"PLN_AREA_C":"'), F.col("r_name"), F.lit('"')),
    )
    point = F.concat(F.lit('{"type":"Point","coordinates":['), key.cast("string"), F.lit(",1.5]}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{'), props, F.lit('},"geometry":'),
                       F.when(key == 3, F.lit("null")).otherwise(point), F.lit("}"))
    # 25 nations, whatever the scale
    listed = F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), feature.alias("f")))), lambda x: x["f"])
    root = shared_dir(spark, "boundaries")
    na.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}"))
           .alias("value")).coalesce(1).write.text(root)
    return root


@register("S3_subzone_dim", """
SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS seq,
       CASE WHEN n_nationkey IN (1, 2) THEN n_name ELSE CAST(n_nationkey AS VARCHAR) END AS subzone_id,
       n_name AS name, r_name AS planning_area_id, n_nationkey <> 3 AS has_geometry
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def s3_subzone_dim(spark, sf):
    dim = GJ.subzone_dim(GJ.read_features(spark, _write_boundaries(spark, sf)))
    return dim.withColumn("has_geometry", F.col("geometry").isNotNull()).drop("geometry")


@register("S3_match_layer", """
SELECT seq, CAST(n_nationkey AS VARCHAR) AS feature_id FROM (
  SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS seq
  FROM nation JOIN region ON n_regionkey = r_regionkey)
WHERE n_nationkey NOT IN (0, 1, 2)""")
def s3_match_layer(spark, sf):
    feats = GJ.read_features(spark, _write_boundaries(spark, sf))
    return GJ.match_layer(feats, GJ.SUBZONE_MATCH_KEYS).drop("geometry")


# -------------------------------------------------------------- streaming ---


def _make_stream(name):
    def fn(spark, sf):
        return STR.stream_rollup(spark, W.warehouse_path(spark, sf), W.enriched_schema(spark, sf), name,
                                 shared_dir(spark, "st-out"), shared_dir(spark, "st-ckpt"), max_files_per_trigger=16)
    return fn


for _sid, _rid in (("ST1", "R1"), ("ST2", "R2"), ("ST3", "R3")):
    register(f"{_sid}_stream_{_ROLLUP_IDS[_rid]}", O.with_fact() + " " + _rollup_sql(_ROLLUP_IDS[_rid]))(
        _make_stream(_ROLLUP_IDS[_rid]))


@register("ST4_stream_rollup", O.with_fact() + " " + _rollup_sql("top_ssic_by_area_month"))
def st4_stream_rollup(spark, sf):
    src = W.warehouse_path(spark, sf)
    return STR.stream_rollup(spark, src, W.enriched_schema(spark, sf), "top_ssic_by_area_month",
                             shared_dir(spark, "st-out"), shared_dir(spark, "st-ckpt"), max_files_per_trigger=16,
                             mode="complete")


@register("ST5_stream_rollup_deltas", O.with_fact() + " " + _merged_sql("new_entities_monthly_by_ssic"))
def st5_stream_rollup_deltas(spark, sf):
    src = W.warehouse_path(spark, sf)
    return STR.stream_rollup_deltas(spark, src, W.enriched_schema(spark, sf), "new_entities_monthly_by_ssic",
                                    shared_dir(spark, "st5-out"), shared_dir(spark, "st5-ckpt"),
                                    max_files_per_trigger=16)


REBUILD_MONTHS = [199800 + m for m in range(1, 13)]


@register("S8_rebuild_months", _T3_SQL + """,
geo2 AS (SELECT postal_code, latitude, longitude, subzone_id, planning_area_id FROM lgeo
         UNION ALL SELECT * FROM newgeo),
f2 AS (
  SELECT f.uen, f.registration_month,
         CASE WHEN f.registration_month BETWEEN 199801 AND 199812 THEN g.subzone_id ELSE f.subzone_id END AS subzone_id,
         CASE WHEN f.registration_month BETWEEN 199801 AND 199812 THEN g.planning_area_id
              ELSE f.planning_area_id END AS planning_area_id
  FROM fact f LEFT JOIN geo2 g ON f.postal_code = g.postal_code)
SELECT registration_month, subzone_id, planning_area_id, count(*) AS new_entities FROM f2 GROUP BY 1, 2, 3""")
def s8_rebuild_months(spark, sf):
    path = shared_dir(spark, "warehouse-copy")
    W.write_fact(W.enriched_fact(spark, sf), path)
    geo = PL.upsert_postal_geo(tpch.postal_geo(spark, sf), _new_geo(spark, sf))
    W.rebuild_partitions(PL.rebuild_enriched(W.raw_fact(spark, sf), geo), path, REBUILD_MONTHS)
    f = spark.read.parquet(path)
    return f.groupBy("registration_month", "subzone_id", "planning_area_id").agg(
        F.count(F.lit(1)).cast("long").alias("new_entities"))


# ------------------------------------------------ API surface with categories ---

_REST = "(starts_with(primary_ssic_norm, '0010') OR primary_ssic_norm = '00200' OR primary_ssic_norm = '00201')"


@register("Q1_overview_category", O.with_fact() + f"""
, cur AS (SELECT * FROM fact WHERE {_w(*YEAR_2000)} AND {_REST}),
tot AS (SELECT (SELECT count(*) FROM cur WHERE planning_area_id = 'ASIA') AS value,
               (SELECT count(*) FROM fact WHERE {_w(dt.date(1999, 1, 1), dt.date(1999, 12, 31))}
                  AND {_REST} AND planning_area_id = 'ASIA') AS prev_value),
ts AS (SELECT primary_ssic_norm AS k, count(*) AS n FROM cur WHERE planning_area_id = 'ASIA' GROUP BY 1
       ORDER BY n DESC, k ASC NULLS LAST LIMIT 1),
tp AS (SELECT planning_area_id AS k, count(*) AS n FROM cur GROUP BY 1 ORDER BY n DESC, k ASC NULLS LAST LIMIT 1),
tz AS (SELECT subzone_id AS k, count(*) AS n FROM cur GROUP BY 1 ORDER BY n DESC, k ASC NULLS LAST LIMIT 1)
SELECT DATE '2000-01-01' AS period_start, DATE '2000-12-31' AS period_end,
       'new_entities_30d' AS label, value, prev_value,
       CASE WHEN prev_value <> 0 THEN round((value - prev_value) / prev_value * 100, 2) END AS change_yoy_pct,
       (SELECT k FROM ts) AS top_ssic_code,
       CASE WHEN (SELECT k FROM ts) IS NOT NULL THEN (SELECT n FROM ts) END AS top_ssic_count,
       CASE WHEN (SELECT k FROM tp) IS NOT NULL THEN (SELECT k FROM tp)
            WHEN (SELECT k FROM tz) IS NOT NULL THEN (SELECT k FROM tz) ELSE 'UNMAPPED' END AS hottest_area_id,
       CASE WHEN (SELECT k FROM tp) IS NOT NULL THEN (SELECT n FROM tp)
            WHEN (SELECT k FROM tz) IS NOT NULL THEN (SELECT n FROM tz) ELSE value END AS hottest_count,
       CASE WHEN (SELECT k FROM tp) IS NOT NULL THEN 'planning_area'
            WHEN (SELECT k FROM tz) IS NOT NULL THEN 'subzone' ELSE 'unmapped' END AS hottest_area_type
FROM tot""")
def q1_overview_category(spark, sf):
    return API.overview(W.warehouse_fact(spark, sf), as_of=YEAR_2000[1], date_from=YEAR_2000[0],
                        ssic_category="restaurants", area="ASIA", categories=_cats(spark))


@register("Q4_hotspots_category", O.with_fact(O.SUBZONE) + """
SELECT s.subzone_id, s.name, s.planning_area_id, s.geometry, count(*) AS count,
       199901 AS month_start, 200112 AS month_end
FROM fact e JOIN subzone s ON e.subzone_id = s.subzone_id
WHERE e.registration_incorporation_date BETWEEN DATE '1999-01-01' AND DATE '2001-12-31'
  AND starts_with(e.primary_ssic_norm, '01') AND s.geometry IS NOT NULL AND s.geometry <> ''
GROUP BY 1, 2, 3, 4""")
def q4_hotspots_category(spark, sf):
    return API.hotspots(W.warehouse_fact(spark, sf), W.subzone_dim(spark, sf), as_of=dt.date(2001, 12, 31),
                        date_from=dt.date(1999, 1, 1), ssic_category="hardware_retail", categories=_cats(spark))


@register("Q3_top_ssic_typed_code", O.with_fact(O.SSIC_DIM) + f"""
, top AS (
  SELECT primary_ssic_norm AS ssic_code, count(*) AS count FROM fact
  WHERE {_w(*WHOLE)} AND primary_ssic_norm = '00042' AND subzone_id = 'NATION_1'
  GROUP BY 1 ORDER BY count DESC, ssic_code ASC NULLS LAST LIMIT 15)
SELECT t.ssic_code, d.ssic_description, t.count FROM top t
LEFT JOIN (SELECT ssic_code, min(ssic_description) AS ssic_description FROM ssic_dim
           WHERE ssic_code IS NOT NULL AND ssic_code <> '' GROUP BY 1) d ON t.ssic_code = d.ssic_code""")
def q3_top_ssic_typed_code(spark, sf):
    return API.top_ssic(W.warehouse_fact(spark, sf), W.ssic_dim(spark, sf), as_of=WHOLE[1], date_from=WHOLE[0],
                        ssic=" 00042 ", area="NATION_1", area_type="subzone", limit=15)


_T2_FACT = O.ENRICHED.replace("fact AS (", "fact_csv AS (").replace("FROM raw r LEFT JOIN", "FROM raw_csv r LEFT JOIN")
_T2_RAW = O.RAW.replace("raw AS (", "raw_csv AS (").replace("company_type_description, registration_incorporation_date",
    "CASE WHEN registration_incorporation_date IS NOT NULL AND NOT iso_a THEN NULL "
    "ELSE company_type_description END AS company_type_description, registration_incorporation_date")


@register("T2_load_warehouse_from_csv", O.with_fact().replace(
    "cln AS (\n  SELECT ", "cln AS (\n  SELECT contains(registration_incorporation_date, '-') AS iso_a, ", 1).replace(
    "FROM ext\n)", "FROM ext\n)", 1) + "," + _T2_RAW + "," + _T2_FACT + " SELECT * FROM fact_csv")
def t2_load_warehouse_from_csv(spark, sf):
    raw = RC.read_registry_csv(spark, _write_registry_csv(spark, sf))
    fact = PL.load_warehouse(raw, tpch.postal_geo(spark, sf))
    path = shared_dir(spark, "warehouse-from-csv")
    W.write_fact(fact, path)
    return spark.read.parquet(path).select(*ENRICHED_COLUMNS)



@register("T1_clean_registry_from_pages", _DEDUP_SQL.replace(
    "FROM cln WHERE uen IS NOT NULL AND uen <> ''",
    f"FROM cln WHERE uen IS NOT NULL AND uen <> '' AND NOT {_PAGE_FAILED}") + " SELECT * FROM dd")
def t1_clean_registry_from_pages(spark, sf):
    records = AP.page_records(AP.read_pages(spark, _write_pages(spark, sf)))
    return PL.clean_registry(records)["clean"]


@register("ST1_stream_events_by_day_type", """
SELECT CAST(year(ts) * 100 + month(ts) AS INTEGER) AS month, CAST(ts AS DATE) AS day, event_type,
       count(*) AS n
FROM events GROUP BY 1, 2, 3""")
def st1_stream_events_by_day_type(spark, sf):
    schema = tpch.table(spark, sf, "events").schema
    keys = [
        (F.year("ts") * 100 + F.month("ts")).cast("int").alias("month"),
        F.col("ts").cast("date").alias("day"),
        F.col("event_type"),
    ]
    return STR.stream_counts(spark, sf, "events.parquet", schema, keys,
                             shared_dir(spark, "st-events-out"), shared_dir(spark, "st-events-ckpt"))
