"""T3 geo enrichment end to end on a small fixture; S9 upsert: newest version wins."""

import datetime as dt

from bizlens.operators.enrich import latest_postal_geo
from bizlens.plans.pipelines import geo_enrich, upsert_postal_geo
from bizlens.sources.geojson import (
    PACKAGED_ZONES,
    PLANNING_MATCH_KEYS,
    SUBZONE_MATCH_KEYS,
    match_layer,
    read_features,
)

GEO = ("postal_code string, latitude double, longitude double, subzone_id string, planning_area_id string, "
       "updated_at timestamp")


def test_geo_enrich_and_upsert(spark):
    raw = spark.createDataFrame([("000001",), ("000002",), ("000003",), ("000004",), (None,), ("000002",)],
                                "postal_code string")
    known = spark.createDataFrame([("000001", 1.0, 1.0, "OLD", "OLDP", dt.datetime(2024, 1, 1))], GEO)
    coords = spark.createDataFrame(
        [("000002", -0.2, -0.35), ("000003", 0.2, 0.2), ("000009", 0.0, 0.0)],  # (postal, lat, lon)
        "postal_code string, latitude double, longitude double")
    feats = read_features(spark, PACKAGED_ZONES)
    new = geo_enrich(raw, known, coords, match_layer(feats, SUBZONE_MATCH_KEYS),
                     match_layer(feats, PLANNING_MATCH_KEYS), dt.datetime(2024, 6, 1))
    got = {r.postal_code: (r.subzone_id, r.planning_area_id, r.latitude) for r in new.collect()}
    # 000002: lon -0.35, lat -0.2 -> West Zone; 000003: lon 0.2, lat 0.2 -> second part of East Zone
    assert got == {"000002": ("WZ", "WEST", -0.2), "000003": ("EZ", "EAST", 0.2), "000004": (None, None, None)}
    merged = upsert_postal_geo(known, new)
    moved = spark.createDataFrame([("000001", 2.0, 2.0, "NEW", "NEWP", dt.datetime(2024, 7, 1))], GEO)
    latest = {r.postal_code: r.subzone_id for r in latest_postal_geo(upsert_postal_geo(merged, moved)).collect()}
    assert latest["000001"] == "NEW" and latest["000002"] == "WZ" and "000004" in latest
