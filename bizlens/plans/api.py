"""The analyst-facing query surface (Q1..Q7, Q9) with the reference's parameters.

Each function takes the enriched fact (normally ``warehouse.warehouse_fact``)
and returns a lazy DataFrame. Bad parameters raise ``FilterError`` (the
reference answers them with HTTP 400). ``as_of`` replaces "today".
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.operators import analytics as A
from bizlens.operators import filters as FL
from bizlens.operators import windows as WN
from bizlens.operators import questions as QN
from bizlens.operators.name_index import NameIndex
from bizlens.schema import DETAIL_COLUMNS, SEARCH_COLUMNS
from bizlens.session import cut_lineage


def _ssic_cond(ssic, ssic_category, categories):
    pats = FL.resolve_ssic_patterns(ssic, ssic_category, categories)
    return FL.ssic_pattern_filter(pats)


def _area_cond(area, area_type, area_dim):
    """F3; with ``area_dim`` (a dim with the area's id and name columns) a
    name is also accepted (``resolve_names``); default: id equality."""
    if area_dim is None:
        return FL.area_filter(area, area_type)
    return FL.area_filter_resolved(area, area_type, area_dim)


def overview(fact: DataFrame, as_of, date_from=None, date_to=None, ssic=None, ssic_category=None,
             area=None, area_type="planning_area", categories=None, area_dim=None) -> DataFrame:
    """Q1: one row -- window total and year-on-year change, top code, hottest area."""
    lo, hi = FL.resolve_window(date_from, date_to, as_of, FL.DEFAULT_DAYS["overview"])
    return A.overview(fact, lo, hi, ssic_cond=_ssic_cond(ssic, ssic_category, categories),
                      area_cond=_area_cond(area, area_type, area_dim))


def trends(fact: DataFrame, as_of, date_from=None, date_to=None, ssic=None, ssic_category=None,
           area=None, area_type="planning_area", categories=None, area_dim=None,
           rollups: WN.Rollups | None = None) -> DataFrame:
    """Q2: (month, count) of new entities; with ``rollups``, whole months come from them."""
    lo, hi = FL.resolve_window(date_from, date_to, as_of, FL.DEFAULT_DAYS["trend"])
    code, place = _ssic_cond(ssic, ssic_category, categories), _area_cond(area, area_type, area_dim)
    if rollups is not None:
        return WN.by_month(WN.count_in_keys(fact, rollups, lo, hi, [FL.MONTH_COL], {
            FL.NORM_COL: code, FL.ALLOWED_AREA_TYPES.get(area_type): place}))
    return A.count_by_month(fact, FL.all_of(FL.date_between(lo, hi), code, place))


def top_ssic(fact: DataFrame, dim_ssic: DataFrame, as_of, date_from=None, date_to=None, ssic=None,
             ssic_category=None, area=None, area_type="planning_area", limit: int = 10,
             categories=None, area_dim=None, rollups: WN.Rollups | None = None) -> DataFrame:
    """Q3: (ssic_code, ssic_description, count), top ``limit`` codes; with ``rollups``,
    whole months come from them."""
    lo, hi = FL.resolve_window(date_from, date_to, as_of, FL.DEFAULT_DAYS["ranking"])
    code, place = _ssic_cond(ssic, ssic_category, categories), _area_cond(area, area_type, area_dim)
    if rollups is not None:
        counts = WN.count_in_keys(fact, rollups, lo, hi, [FL.NORM_COL], {
            FL.NORM_COL: code, FL.ALLOWED_AREA_TYPES.get(area_type): place})
        return A.with_descriptions(WN.top_of(counts, FL.NORM_COL, limit, alias="ssic_code"), dim_ssic)
    cond = FL.all_of(FL.date_between(lo, hi), code, place)
    return A.with_descriptions(A.top_by_key(fact, cond, "primary_ssic_norm", limit, alias="ssic_code"), dim_ssic)


def hotspots(fact: DataFrame, dim_subzone: DataFrame, as_of, date_from=None, date_to=None, ssic=None,
             ssic_category=None, categories=None) -> DataFrame:
    """Q4: (subzone_id, name, planning_area_id, geometry, count, month_start, month_end)."""
    lo, hi = FL.resolve_window(date_from, date_to, as_of, FL.DEFAULT_DAYS["hotspots"])
    cond = FL.all_of(FL.date_between(lo, hi), _ssic_cond(ssic, ssic_category, categories))
    m0, m1 = A.month_range(lo, hi)
    return A.hotspots(fact, dim_subzone, cond).withColumn("month_start", F.lit(m0)).withColumn(
        "month_end", F.lit(m1))


def search(fact: DataFrame, q=None, ssic=None, ssic_category=None, status=None, limit: int = 50,
           offset: int = 0, categories=None, index: NameIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """Q5: (total, page) -- the total before paging and the requested page. With a
    name index of the fact only the text's candidates are read."""
    if index is not None and q:
        fact = index.rows(q)
    cond = FL.all_of(FL.text_search(q), FL.status_filter(status), _ssic_cond(ssic, ssic_category, categories))
    return A.search_total(fact, cond), A.search(fact, cond, SEARCH_COLUMNS, limit=limit, offset=offset)


def entity_detail(fact: DataFrame, uen: str) -> DataFrame:
    """Q6: the entity's 17 detail columns (empty when not found)."""
    return A.entity_detail(fact, uen, DETAIL_COLUMNS)


def categories_table(tax: DataFrame) -> DataFrame:
    """Q7: the taxonomy as served (sectors and categories arrays, one row)."""
    return tax


def chat(questions: DataFrame, fact: DataFrame, as_of: _dt.date) -> dict[str, DataFrame]:
    """Q8/Q9: intent + slots, answer rows, entity rows and one narrative per question."""
    parsed = cut_lineage(QN.parse_questions(questions, as_of))  # parsed once for all outputs
    answers = QN.answer_rows(parsed, fact)
    lookups = QN.entity_lookups(parsed, fact)
    return {"parsed": parsed, "answers": answers, "lookups": lookups,
            "narratives": QN.narratives(parsed, answers, lookups)}
