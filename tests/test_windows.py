"""Windows answered from monthly rollups equal the fact's own counts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from bizlens.operators.filters import date_between
from bizlens.operators.rollups import COUNT_COL, ROLLUP_KEYS, rollup
from bizlens.operators.windows import (
    Rollups, apply_refresh, count_in_keys, fitting_rollup, stage_refresh, whole_months,
)

D = dt.date


def test_whole_months():
    assert whole_months(D(2024, 1, 1), D(2024, 2, 29)) == (D(2024, 1, 1), D(2024, 2, 29))
    assert whole_months(D(2023, 12, 2), D(2024, 2, 28)) == (D(2024, 1, 1), D(2024, 1, 31))
    assert whole_months(D(2024, 1, 2), D(2024, 2, 28)) is None
    assert whole_months(D(2024, 1, 5), D(2024, 1, 9)) is None
    assert whole_months(D(2024, 5, 1), D(2024, 3, 1)) is None


def test_fitting_rollup():
    assert fitting_rollup(["registration_month"]) in ROLLUP_KEYS
    assert fitting_rollup(["primary_ssic_norm", "planning_area_id"]) == "top_ssic_by_area_month"
    assert fitting_rollup(["subzone_id", "primary_ssic_norm"]) is None


def _fact(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        # a third of all rows in one month, code and area; some undated
        day = D(2020, 6, rng.randrange(1, 31)) if rng.random() < 0.33 else D(2020, 1, 1) + dt.timedelta(rng.randrange(400))
        hot = rng.random() < 0.33
        rows.append((None, None, "1", "x", "z", "p") if rng.random() < 0.02 else (
            day, day.year * 100 + day.month, "46111" if hot else rng.choice(["46112", "56111", "", None]),
            rng.choice(["Live", None]), rng.choice(["Z1", "Z2", None]), "P1" if hot else rng.choice(["P2", "", None])))
    return spark.createDataFrame(
        rows, "registration_incorporation_date date, registration_month int, primary_ssic_norm string, "
              "entity_status_description string, subzone_id string, planning_area_id string")


def test_windows_equal_the_fact(spark, tmp_path):
    fact = _fact(spark).cache()
    rollups = Rollups(spark, str(tmp_path / "r")).write(fact)
    windows = [(D(2020, 1, 1), D(2020, 12, 31)), (D(2020, 2, 10), D(2020, 7, 5)), (D(2020, 3, 3), D(2020, 3, 9)),
               (D(2020, 3, 1), D(2020, 4, 2)), (D(2020, 5, 2), D(2020, 6, 30)), (D(2020, 9, 1), D(2020, 2, 1))]
    code, area = F.col("primary_ssic_norm"), F.col("planning_area_id")
    cases = [(["registration_month"], {}), (["subzone_id"], {}), (["planning_area_id"], {"primary_ssic_norm": code.startswith("46")}),
             (["primary_ssic_norm"], {"planning_area_id": area == "P1", "primary_ssic_norm": None}),
             (["subzone_id"], {"primary_ssic_norm": code == "46111"})]  # no rollup has both
    for lo, hi in windows:
        for keys, filters in cases:
            want = fact.filter(date_between(lo, hi))
            for p in filters.values():
                want = want.filter(p) if p is not None else want
            got = {r[0]: r["count"] for r in count_in_keys(fact, rollups, lo, hi, keys, filters).collect()}
            assert got == {r[0]: r["count"] for r in want.groupBy(*keys).count().collect()}, (lo, hi, keys)


def test_whole_months_leave_the_fact_alone(spark, tmp_path):
    fact = _fact(spark)
    path = str(tmp_path / "f")
    fact.write.parquet(path)
    read = spark.read.parquet(path)
    rollups = Rollups(spark, str(tmp_path / "r")).write(read)
    files = count_in_keys(read, rollups, D(2020, 1, 1), D(2020, 12, 31), ["subzone_id"]).inputFiles()
    assert files and not any(f"{path}/part" in f for f in files)


def test_refresh_by_deltas_equals_a_rebuild(spark, tmp_path):
    # one hot code; codes without any geo before, changed geo, geo that stays; undated rows
    rows = [(m, "46111", "Live", z, a, p) for m, z, a, p, n in [
        (202001, None, None, "100", 40), (202002, "Z1", "P1", "200", 5), (202003, "Z3", "P3", "300", 4),
        (None, None, None, "100", 2), (202004, "Z4", "P4", None, 3), (202005, "Z5", "P5", "500", 1)] for _ in range(n)]
    fact = spark.createDataFrame(rows, "registration_month int, primary_ssic_norm string, "
                                       "entity_status_description string, subzone_id string, "
                                       "planning_area_id string, postal_code string")
    geo = spark.createDataFrame([("100", "Z1", "P1"), ("200", "Z2", "P1"), ("500", "Z5", "P5"), ("900", "Z9", "P9")],
                                "postal_code string, subzone_id string, planning_area_id string")
    rollups = Rollups(spark, str(tmp_path / "r")).write(fact)
    stage = str(tmp_path / "stage")
    stage_refresh(rollups, fact, geo, stage)
    for _ in range(2):  # a repeated run changes nothing more
        apply_refresh(rollups, stage)
    g = geo.select("postal_code", F.col("subzone_id").alias("z"), F.col("planning_area_id").alias("a"))
    after = fact.join(g, "postal_code", "left").withColumns({
        "subzone_id": F.coalesce("z", "subzone_id"), "planning_area_id": F.coalesce("a", "planning_area_id")})

    def listed(df):
        return sorted(map(str, df.collect()))

    for name, keys in ROLLUP_KEYS.items():
        assert listed(rollups.read(name)) == listed(rollup(after, name).select(*keys, COUNT_COL)), name
    months = [r[0] for r in spark.read.parquet(f"{stage}/new_entities_monthly_by_planning_area")
              .select("registration_month").distinct().collect()]
    assert set(months) == {202001, None}  # the others keep their files
