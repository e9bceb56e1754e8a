"""J5 point-in-polygon: holes, multi-parts, overlaps (first in file order),
boundary points (not contained), features without id."""

import json

from bizlens.operators.spatial import point_in_polygon
from bizlens.sources.geojson import SUBZONE_MATCH_KEYS, match_layer, read_features, subzone_dim

LAYER = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "properties": {"SUBZONE_C": "HOLE"},
         "geometry": {"type": "Polygon", "coordinates": [
             [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]}},
        {"type": "Feature", "properties": {"SUBZONE_C": "MULTI"},
         "geometry": {"type": "MultiPolygon", "coordinates": [
             [[[20, 0], [30, 0], [30, 10], [20, 10], [20, 0]]],
             [[[40, 0], [50, 0], [50, 10], [40, 10], [40, 0]]]]}},
        {"type": "Feature", "properties": {"SUBZONE_C": "OVER"},
         "geometry": {"type": "Polygon", "coordinates": [[[5, 5], [25, 5], [25, 8], [5, 8], [5, 5]]]}},
        {"type": "Feature", "properties": {"name": "no id"},
         "geometry": {"type": "Polygon", "coordinates": [[[60, 0], [70, 0], [70, 10], [60, 10], [60, 0]]]}},
        {"type": "Feature", "properties": {"SUBZONE_C": "TRI"},
         "geometry": {"type": "Polygon", "coordinates": [[[80, 0], [90, 0], [85, 10], [80, 0]]]}},
    ],
}

POINTS = [
    ("in_shell", 1.0, 1.0, "HOLE"),
    ("in_hole", 5.5, 5.5, "OVER"),       # inside the hole of HOLE, but inside OVER
    ("in_hole_only", 4.5, 4.5, None),    # in the hole, outside OVER
    ("overlap", 8.0, 6.0, "HOLE"),       # HOLE and OVER overlap: first in file wins
    ("multi_a", 25.0, 2.0, "MULTI"),
    ("multi_b", 45.0, 5.0, "MULTI"),
    ("gap", 35.0, 5.0, None),
    ("on_edge", 0.0, 5.0, None),          # left edge of HOLE
    ("on_vertex", 10.0, 10.0, None),
    ("on_hole_edge", 5.0, 4.0, None),     # on the hole's bottom edge; OVER starts at y=5
    ("no_id_feature", 65.0, 5.0, None),   # only feature without an id
    ("tri_in", 85.0, 5.0, "TRI"),
    ("tri_slope_edge", 82.5, 5.0, None),  # on the sloped edge of TRI
]


def _layer(spark, tmp_path):
    p = tmp_path / "layer.geojson"
    p.write_text(json.dumps(LAYER))
    return read_features(spark, str(p))


def test_point_in_polygon_cases(spark, tmp_path):
    feats = _layer(spark, tmp_path)
    pts = spark.createDataFrame([(k, x, y) for k, x, y, _ in POINTS], "point_id string, x double, y double")
    for cell in (None, 3.0, 100.0):
        got = {r.point_id: r.feature_id
               for r in point_in_polygon(pts, match_layer(feats, SUBZONE_MATCH_KEYS), cell=cell).collect()}
        want = {k: v for k, _, _, v in POINTS if v is not None}
        assert got == want, cell


def test_subzone_dim_keys(spark, tmp_path):
    rows = {r.seq: r for r in subzone_dim(_layer(spark, tmp_path)).collect()}
    assert rows[0].subzone_id == "HOLE" and rows[0].name == "HOLE"
    assert rows[3].subzone_id == "no id" and rows[3].name == "no id"
    assert json.loads(rows[1].geometry)["type"] == "MultiPolygon"


def test_falsy_ids_skipped_by_matcher_not_by_dim(spark, tmp_path):
    layer = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"SUBZONE_C": 0, "id": "ALT"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {"SUBZONE_C": 0},
         "geometry": {"type": "Polygon", "coordinates": [[[2, 0], [3, 0], [3, 1], [2, 1], [2, 0]]]}},
    ]}
    p = tmp_path / "z.geojson"
    p.write_text(json.dumps(layer))
    feats = read_features(spark, str(p))
    assert [r.subzone_id for r in subzone_dim(feats).orderBy("seq").collect()] == ["0", "0"]
    ids = [r.feature_id for r in match_layer(feats, SUBZONE_MATCH_KEYS).orderBy("seq").collect()]
    assert ids == ["ALT"]


def _boxes_file(path, boxes):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"SUBZONE_C": name}, "geometry": {"type": "Polygon", "coordinates": [
            [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]}}
        for name, x, y, w, h in boxes]}))


def test_layer_of_many_files(spark, tmp_path):
    # both files have a feature 0; a point on an edge of one lies inside the other
    _boxes_file(tmp_path / "a.geojson", [("A0", 0, 0, 10, 10), ("A1", 50, 0, 10, 10)])
    _boxes_file(tmp_path / "b.geojson", [("B0", 5, 10, 10, 10), ("B1", 8, 2, 10, 10), ("B2", 2, 5, 6, 10)])
    feats = read_features(spark, str(tmp_path))
    layer = match_layer(feats, SUBZONE_MATCH_KEYS)
    assert [(r.seq >> 32, r.seq & 0xFFFFFFFF, r.feature_id) for r in layer.orderBy("seq").collect()] == [
        (0, 0, "A0"), (0, 1, "A1"), (1, 0, "B0"), (1, 1, "B1"), (1, 2, "B2")]
    pts = spark.createDataFrame([("edge", 6.0, 10.0), ("tie", 9.0, 5.0), ("far", 55.0, 5.0), ("none", 40.0, 5.0)],
                                "point_id string, x double, y double")
    got = dict(point_in_polygon(pts, layer).collect())
    assert got == {"edge": "B2", "tie": "A0", "far": "A1"}


def test_levels_of_very_different_sizes(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(5)
    boxes = [(f"s{k}", rng.randrange(240) / 4, rng.randrange(240) / 4, rng.choice([0.25, 1, 3]), rng.choice([0.5, 2]))
             for k in range(1500)]
    boxes.insert(700, ("huge", -1e6, -1e6, 2e6, 2e6))
    boxes.insert(1200, ("tiny", 500.0, 500.0, 2.0**-40, 2.0**-40))
    boxes.insert(3, ("flat", 1.0, 1.0, 0.0, 0.0))
    _boxes_file(tmp_path / "z.geojson", boxes)
    pts = [(k, rng.randrange(480) / 8, rng.randrange(480) / 8) for k in range(800)]
    pts += [(-1, 500.0 + 2.0**-41, 500.0 + 2.0**-41), (-2, 2e7, 0.0), (-3, None, 1.0)]
    layer = match_layer(read_features(spark, str(tmp_path)), SUBZONE_MATCH_KEYS)
    got = dict(point_in_polygon(spark.createDataFrame(pts, "point_id long, x double, y double"), layer).collect())
    want = {}
    for k, px, py in pts:
        for name, x, y, w, h in boxes:
            if px is not None and x < px < x + w and y < py < y + h:
                want[k] = name
                break
    assert got == want and len(set(want.values())) > 100 and "huge" in want.values()
    assert point_in_polygon(spark.createDataFrame(pts, "point_id long, x double, y double"),
                            layer.filter(F.lit(False))).collect() == []


def test_points_of_a_large_layer_are_not_broadcast(spark, tmp_path, monkeypatch):
    from bizlens.operators import spatial

    _boxes_file(tmp_path / "z.geojson", [("a", 0, 0, 2, 2), ("b", 1, 1, 4, 4), ("c", 90, 90, 64, 64)])
    layer = match_layer(read_features(spark, str(tmp_path / "z.geojson")), SUBZONE_MATCH_KEYS)
    spark.createDataFrame([(1, 1.5, 1.5), (2, 3.0, 3.0), (3, 99.0, 95.0), (4, 50.0, 50.0)],
                          "point_id long, x double, y double").write.parquet(str(tmp_path / "p"))
    pts = spark.read.parquet(str(tmp_path / "p"))

    def joins():
        found = spatial.point_in_polygon(pts, layer)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert dict(found.collect()) == {1: "a", 2: "b", 3: "c"}
        return [line for line in plan.splitlines() if "Join" in line and "cx" in line]

    assert "BroadcastHashJoin" in joins()[0]
    monkeypatch.setattr(spatial, "MAX_BROADCAST_CELLS", 0)
    assert "SortMergeJoin" in joins()[0]
