"""Hot keys: one key holding a third of all rows is folded map-side and
answers stay exact."""

import datetime as dt

from pyspark.sql import functions as F

from bizlens.operators.dedup import dedup_keep_latest
from bizlens.operators.enrich import enrich_geo
from bizlens.operators.rollups import rollup
from bizlens.schema import KEEP_COLUMNS


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(n_hot=3000, n_other=6000):
    hot = [("HOT", f"h{i}", dt.date(2020, 1, 1) + dt.timedelta(days=i % 500), i) for i in range(n_hot)]
    other = [(f"K{i % 2000}", f"o{i}", dt.date(2019, 1, 1) + dt.timedelta(days=i % 300), n_hot + i)
             for i in range(n_other)]
    return hot + other


def test_dedup_hot_key_is_partial_and_exact(spark):
    df = spark.createDataFrame(_rows(), "uen string, entity_name string, d date, ord long").repartition(8)
    out = dedup_keep_latest(df, "uen", "d", "ord")
    plan = _plan(out)
    assert "partial_min" in plan  # map-side combine before the shuffle
    got = {r.uen: r.entity_name for r in out.collect()}
    assert got["HOT"] == "h499" and len(got) == 2001


def test_rollup_hot_month_is_partial(spark):
    rows = [(202401, "X", "L")] * 3000 + [(202400 + (i % 12) + 1, str(i % 50), "L") for i in range(6000)]
    df = spark.createDataFrame(rows, "registration_month int, primary_ssic_norm string, "
                               "entity_status_description string")
    out = rollup(df, "new_entities_monthly_by_ssic")
    assert "partial_count" in _plan(out)
    assert {(r.registration_month, r.primary_ssic_norm): r.new_entities for r in out.collect()}[(202401, "X")] == 3000


def test_geo_join_hot_postal_broadcasts(spark, tmp_path):
    n = 3000
    raw = spark.createDataFrame(
        [(f"U{i}", "n", "s", "t", "c", None, dt.date(2020, 1, 1), None, "1", "2",
          "000001" if i % 3 == 0 else f"{i + 10:06d}") for i in range(n)],
        ", ".join(f"{c} {'date' if c.endswith('_date') else 'string'}" for c in KEEP_COLUMNS))
    geo = spark.createDataFrame([("000001", 1.0, 2.0, "S1", "P1", dt.datetime(2024, 1, 1))],
                                "postal_code string, latitude double, longitude double, subzone_id string, "
                                "planning_area_id string, updated_at timestamp")
    # unknown size (in-memory rows): no broadcast; the salted sort-merge path
    # keeps NULL keys off a single reducer and stays exact
    raw_nulls = raw.withColumn("postal_code", F.when(F.col("uen").endswith("1"), None)
                               .otherwise(F.col("postal_code")))
    out = enrich_geo(raw_nulls, geo, codes_cleaned=True)
    assert "SortMergeJoin" in _plan(out) and "xxhash64" in _plan(out)
    assert out.count() == n and out.filter(F.col("subzone_id") == "S1").count() == len(
        [i for i in range(0, n, 3) if not str(i).endswith("1")])
    # known, small size (Parquet): broadcast hash join, the fact is not shuffled
    geo.write.parquet(str(tmp_path / "geo"))
    out = enrich_geo(raw, spark.read.parquet(str(tmp_path / "geo")), codes_cleaned=True)
    assert "BroadcastHashJoin" in _plan(out)
    assert out.filter(F.col("subzone_id") == "S1").count() == n // 3
