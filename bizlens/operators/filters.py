"""Predicates F1..F10 over the enriched fact.

Each returns a ``Column`` so callers compose them with ``&`` and Catalyst
pushes them to the Parquet scan (``PushedFilters``).
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.cleaning import yyyymm_of

DATE_COL = "registration_incorporation_date"
MONTH_COL = "registration_month"
NORM_COL = "primary_ssic_norm"

# Default look-back windows (days) per endpoint.
DEFAULT_DAYS = {"overview": 30, "trend": 730, "ranking": 365, "hotspots": 365}

ALLOWED_AREA_TYPES = {"planning_area": "planning_area_id", "subzone": "subzone_id"}


class FilterError(ValueError):
    """Invalid filter parameter (the reference answers these with HTTP 400)."""


def to_date(value) -> _dt.date | None:
    if value is None or value == "":
        return None
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    try:
        return _dt.datetime.fromisoformat(str(value)).date()
    except ValueError as exc:
        raise FilterError("Invalid date format; use YYYY-MM-DD") from exc


def resolve_window(date_from, date_to, as_of, default_days: int) -> tuple[_dt.date, _dt.date]:
    """F1 bounds: ``to`` defaults to ``as_of``; ``from`` to ``to - default_days``."""
    end = to_date(date_to) or to_date(as_of)
    if end is None:
        raise FilterError("as_of (or to) is required")
    start = to_date(date_from) or (end - _dt.timedelta(days=default_days))
    return start, end


def date_between(lo: _dt.date, hi: _dt.date, date_col: str = DATE_COL,
                 month_col: str | None = MONTH_COL) -> Column:
    """inclusive date window; NULL dates excluded; reversed bounds -> empty.

    Adds the implied ``registration_month`` range so a month-partitioned
    fact is pruned (the date filter alone does not prune partitions).
    """
    cond = F.col(date_col).between(F.lit(lo), F.lit(hi))
    if month_col:
        cond = cond & F.col(month_col).between(yyyymm_of(lo), yyyymm_of(hi))
    return cond


def ssic_pattern_filter(patterns, column: str = NORM_COL) -> Column | None:
    """F2 core: OR of ``startswith`` (pattern ending in '*') or equality."""
    clauses = []
    for p in patterns:
        p = str(p)
        if p.endswith("*"):
            clauses.append(F.col(column).startswith(p[:-1]))
        else:
            clauses.append(F.col(column) == F.lit(p))
    return reduce(lambda a, b: a | b, clauses) if clauses else None


def resolve_ssic_patterns(ssic: str | None, category: str | None, categories=None) -> list[str]:
    """F2 parameters: a typed code wins (digits only, matched exactly); else the
    category's pattern list; blank -> no filter.

    ``categories``: a DataFrame of the taxonomy's categories (id, ssic[]); only
    the one requested row is fetched.
    """
    if ssic:
        cleaned = ssic.strip()
        if cleaned == "":
            return []
        if not (cleaned.isascii() and cleaned.isdigit()):
            raise FilterError("ssic must be digits")
        return [cleaned]
    if category:
        if categories is None:
            raise FilterError("Unknown ssic_category")
        rows = categories.filter(F.col("id") == F.lit(category)).select("ssic").limit(1).collect()
        if not rows:
            raise FilterError("Unknown ssic_category")
        return [str(x) for x in (rows[0]["ssic"] or [])]
    return []


def area_filter(area: str | None, area_type: str = "planning_area") -> Column | None:
    """equality on planning_area_id (default) or subzone_id."""
    if not area:
        return None
    if area_type not in ALLOWED_AREA_TYPES:
        raise FilterError("area_type must be planning_area or subzone")
    return F.col(ALLOWED_AREA_TYPES[area_type]) == F.lit(area)


def resolve_area(area: str | None, area_dim: DataFrame | None, id_col: str = "planning_area_id",
                 name_col: str = "name") -> list[str] | None:
    """Area names the UI/questions supply -> ids (the reference compares the
    text to ids only). Returns the ids whose name equals ``area`` (case-
    insensitive) plus ``area`` itself; only that one name's rows are fetched."""
    if not area:
        return None
    if area_dim is None:
        return [area]
    rows = area_dim.filter(F.lower(F.col(name_col)) == F.lower(F.lit(area))).select(id_col).distinct().collect()
    return sorted({area, *[r[0] for r in rows if r[0] is not None]})


def area_filter_resolved(area: str | None, area_type: str = "planning_area", area_dim: DataFrame | None = None):
    """F3 with name resolution: ``isin`` over the resolved ids."""
    ids = resolve_area(area, area_dim, ALLOWED_AREA_TYPES.get(area_type, "planning_area_id"))
    if ids is None:
        return None
    if area_type not in ALLOWED_AREA_TYPES:
        raise FilterError("area_type must be planning_area or subzone")
    return F.col(ALLOWED_AREA_TYPES[area_type]).isin(ids)


def status_filter(status: str | None) -> Column | None:
    """F4."""
    return (F.col("entity_status_description") == F.lit(status)) if status else None


def text_search(q: str | None) -> Column | None:
    """case-insensitive substring of the name, or exact uen.

    ``contains`` (not LIKE), so % and _ in the query are literal characters.
    """
    if not q:
        return None
    return F.lower(F.col("entity_name")).contains(F.lower(F.lit(q))) | (F.col("uen") == F.lit(q))


def ssic_prefix(prefix: str | None, column: str = NORM_COL) -> Column | None:
    """template prefix match (typed digits are a prefix here)."""
    return F.col(column).startswith(F.lit(prefix)) if prefix else None


def area_in(areas, column: str = "planning_area_id") -> Column:
    """membership in a list of area ids."""
    return F.col(column).isin(list(areas))


def has_geometry(column: str = "geometry") -> Column:
    """F8: geometry present and non-empty."""
    return F.col(column).isNotNull() & (F.col(column) != "")


def uen_equals(uen: str) -> Column:
    """F9."""
    return F.col("uen") == F.lit(uen)


def all_of(*conds) -> Column:
    conds = [c for c in conds if c is not None]
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)
