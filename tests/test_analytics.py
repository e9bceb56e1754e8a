"""Overview KPI with its fallbacks, hotspot intensity, rollup merge, category counts."""

import datetime as dt

from pyspark.sql import functions as F

from bizlens.operators import analytics as A
from bizlens.operators import filters as FL
from bizlens.operators.rollups import merge_rollup, rollup
from bizlens.operators.taxonomy import category_counts, resolve_category, taxonomy_search
from bizlens.sources.taxonomy import categories, read_taxonomy, sectors

COLS = ("registration_incorporation_date date, registration_month int, primary_ssic_norm string, "
        "planning_area_id string, subzone_id string, entity_status_description string")


def _fact(spark, rows):
    return spark.createDataFrame(rows, COLS)


def test_overview_planning_area(spark):
    d = dt.date(2024, 3, 1)
    p = dt.date(2023, 3, 1)
    rows = [(d, 202403, "56101", "EAST", "E1", "L")] * 3 + [(d, 202403, "62011", "WEST", "W1", "L")] \
        + [(p, 202303, "56101", "EAST", "E1", "L")] * 2
    ov = A.overview(_fact(spark, rows), dt.date(2024, 1, 1), dt.date(2024, 12, 31)).first()
    assert (ov.value, ov.prev_value, ov.change_yoy_pct) == (4, 2, 100.0)
    assert (ov.top_ssic_code, ov.top_ssic_count) == ("56101", 3)
    assert (ov.hottest_area_id, ov.hottest_count, ov.hottest_area_type) == ("EAST", 3, "planning_area")


def test_overview_fallbacks(spark):
    d = dt.date(2024, 3, 1)
    # top planning group is NULL -> subzone fallback
    rows = [(d, 202403, None, None, "S9", "L")] * 3 + [(d, 202403, "1", "EAST", None, "L")]
    ov = A.overview(_fact(spark, rows), dt.date(2024, 1, 1), dt.date(2024, 12, 31)).first()
    assert (ov.hottest_area_id, ov.hottest_count, ov.hottest_area_type) == ("S9", 3, "subzone")
    assert ov.top_ssic_code is None and ov.change_yoy_pct is None  # NULL top code -> no answer
    # both NULL -> UNMAPPED with the (area-filtered) total
    rows = [(d, 202403, "1", None, None, "L")] * 2
    ov = A.overview(_fact(spark, rows), dt.date(2024, 1, 1), dt.date(2024, 12, 31)).first()
    assert (ov.hottest_area_id, ov.hottest_count, ov.hottest_area_type) == ("UNMAPPED", 2, "unmapped")


def test_overview_area_filter_not_applied_to_hottest(spark):
    d = dt.date(2024, 3, 1)
    rows = [(d, 202403, "1", "EAST", "E1", "L")] * 3 + [(d, 202403, "2", "WEST", "W1", "L")]
    ov = A.overview(_fact(spark, rows), dt.date(2024, 1, 1), dt.date(2024, 12, 31),
                    area_cond=FL.area_filter("WEST")).first()
    assert (ov.value, ov.top_ssic_code, ov.hottest_area_id) == (1, "2", "EAST")


def test_prev_window_feb29(spark):
    rows = [(dt.date(2023, 2, 28), 202302, "1", "A", "S", "L")]
    ov = A.overview(_fact(spark, rows), dt.date(2024, 2, 29), dt.date(2024, 2, 29)).first()
    assert ov.prev_value == 1


def test_merge_rollup_null_and_empty_collapse(spark):
    schema = "registration_month int, subzone_id string, new_entities long"
    old = spark.createDataFrame([(202401, None, 2), (202401, "A", 1)], schema)
    delta = spark.createDataFrame([(202401, "", 3), (202401, "A", 4), (202402, "B", 1)], schema)
    got = sorted((tuple(r) for r in merge_rollup(old, delta, "new_entities_monthly_by_subzone").collect()), key=str)
    assert got == sorted([(202401, None, 5), (202401, "A", 5), (202402, "B", 1)], key=str)


def test_rollup_equals_groupby(spark):
    d = dt.date(2024, 3, 1)
    rows = [(d, 202403, "1", "E", "S", "L"), (d, 202403, "1", "E", "S", "L"), (d, 202403, None, "E", "S", "X")]
    got = sorted((tuple(r) for r in rollup(_fact(spark, rows), "new_entities_monthly_by_ssic").collect()), key=str)
    assert got == sorted([(202403, "1", "L", 2), (202403, None, "X", 1)], key=str)


def test_hotspot_intensity(spark):
    hot = spark.createDataFrame(
        [("A", "Alpha", "P", '{"type":"Polygon","coordinates":[]}', 10),
         ("B", "", "P", "not json", 20),
         ("C", None, None, '{"type":"Polygon","coordinates":[]}', 5)],
        "subzone_id string, name string, planning_area_id string, geometry string, count long")
    got = {r.subzone_id: r for r in A.hotspot_intensity(hot).collect()}
    assert set(got) == {"A", "C"}
    assert got["A"].intensity == 0.5 and abs(got["A"].fill_opacity - 0.45) < 1e-12
    assert got["C"].display_name == "C" and got["C"].planning_area_id == ""


def test_category_counts_equal_or_filter(spark):
    cats = categories(read_taxonomy(spark))
    codes = ["00100", "00105", "00620", "00629", "01000", "19999", "00999", None, "00200"]
    fact = spark.createDataFrame([(c,) for c in codes] * 2, "primary_ssic_norm string")
    got = {r.category_id: r["count"] for r in category_counts(fact, cats).collect()}
    for row in cats.collect():
        cond = FL.ssic_pattern_filter(row.ssic)
        assert got[row.id] == fact.filter(cond).count(), row.id


def test_taxonomy_search_and_resolve(spark):
    tax = read_taxonomy(spark)
    q = spark.createDataFrame([("Coffee",), ("",), ("zzz",)], "query string")
    res = taxonomy_search(q, categories(tax), sectors(tax)).collect()
    coffee = [(r.category_id, r.sector, r.sector_label) for r in res if r.query == "Coffee"]
    assert coffee == [("cafes", "food_services", "Food & Beverage")]
    assert len([r for r in res if r.query == ""]) == categories(tax).count()
    assert not [r for r in res if r.query == "zzz"]
    unsectored = [r for r in res if r.query == "" and r.category_id == "misc_codes"]
    assert unsectored[0].sector == "other" and unsectored[0].sector_label == "other"
    t = spark.createDataFrame([("banking",), (" BOLT ",), ("56111",), ("nope",)], "text string")
    got = {r.text: (r.match_type, r.category_id, r.ssic) for r in resolve_category(t, categories(tax)).collect()}
    assert got == {"banking": ("label", "banking", None), " BOLT ": ("keyword", "hardware_retail", None),
                   "56111": ("ssic", None, "56111"), "nope": ("none", None, None)}
    assert F is not None


def test_api_parameter_errors(spark):
    import pytest

    from bizlens.plans import api

    fact = _fact(spark, [(dt.date(2024, 3, 1), 202403, "1", "E", "S", "L")])
    cats = categories(read_taxonomy(spark))
    with pytest.raises(FL.FilterError):
        api.trends(fact, as_of=dt.date(2024, 6, 1), ssic="56a")
    with pytest.raises(FL.FilterError):
        api.trends(fact, as_of=dt.date(2024, 6, 1), ssic_category="nope", categories=cats)
    with pytest.raises(FL.FilterError):
        api.trends(fact, as_of=dt.date(2024, 6, 1), area="E", area_type="region")
    with pytest.raises(FL.FilterError):
        api.trends(fact, as_of=dt.date(2024, 6, 1), date_from="2024/01/01")
    # defaults: trend window is 730 days back from as_of; blank ssic means no filter
    assert api.trends(fact, as_of=dt.date(2024, 6, 1), ssic="  ").collect()[0]["count"] == 1
    assert api.trends(fact, as_of=dt.date(2026, 6, 1)).count() == 0
    # reversed bounds are not swapped -> empty
    assert api.trends(fact, as_of=dt.date(2024, 6, 1), date_from="2024-12-31", date_to="2024-01-01").count() == 0


def test_area_name_resolution(spark):
    from bizlens.plans import api

    d = dt.date(2024, 3, 1)
    fact = _fact(spark, [(d, 202403, "1", "PA1", "S", "L"), (d, 202403, "1", "PA2", "S", "L")])
    dim = spark.createDataFrame([("PA1", "North Shore"), ("PA2", "South Bank")], "planning_area_id string, name string")
    as_of = dt.date(2024, 6, 1)
    assert api.trends(fact, as_of, area="north shore").count() == 0  # reference: ids only
    got = api.trends(fact, as_of, area="north shore", area_dim=dim).collect()
    assert [(r.month, r["count"]) for r in got] == [(202403, 1)]
    assert api.trends(fact, as_of, area="PA2", area_dim=dim).collect()[0]["count"] == 1


def test_yoy_rounds_like_python(spark):
    d, p = dt.date(2024, 3, 1), dt.date(2023, 3, 1)
    # (33 - 32) / 32 * 100 = 3.125 exactly: Python rounds half-to-even -> 3.12
    rows = [(d, 202403, "1", "E", "S", "L")] * 33 + [(p, 202303, "1", "E", "S", "L")] * 32
    ov = A.overview(_fact(spark, rows), dt.date(2024, 1, 1), dt.date(2024, 12, 31)).first()
    assert ov.change_yoy_pct == round(1 / 32 * 100, 2) == 3.12


def test_tag_categories_matches_or_filter(spark):
    from bizlens.operators.taxonomy import tag_categories

    cats = categories(read_taxonomy(spark))
    codes = ["00100", "00620", "00629", "01000", "19999", None, "00200", "ABC"]
    fact = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "row_id int, primary_ssic_norm string")
    got = sorted((r.row_id, r.category_id) for r in tag_categories(fact, cats).collect())
    want = sorted((r.row_id, c.id) for c in cats.collect()
                  for r in fact.filter(FL.ssic_pattern_filter(c.ssic)).collect())
    assert got == want
