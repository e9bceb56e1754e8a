"""The driver contract: entry() runs; registered queries equal their DuckDB oracle
on the smallest test tables."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

CHECKED = ["Q1_overview", "Q2_trend", "Q3_top_ssic", "Q4_hotspots", "A9_dedup_keep_latest",
           "J5_point_in_polygon_subzone", "J6_category_counts", "N8_parse_questions", "R4_top_ssic_by_area_month",
           "A11_profile_nulls", "Q11_resolve_category", "S1_read_registry_csv", "S6_write_clean_csv",
           "T1_clean_registry"]


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    return str(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="test tables not present")
def test_entry(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="test tables not present")
def test_every_query_has_an_oracle():
    assert set(E.catalog.QUERIES) <= set(E.queries())
    assert set(E.catalog.QUERIES) == set(E.catalog.ORACLE)


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="test tables not present")
@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _canon(df.columns, [tuple(r) for r in df.collect()]) == _canon(dcols, res.fetchall())
