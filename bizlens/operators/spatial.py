"""Point-in-polygon join (J5): first feature, in file order, that strictly
contains the point (points on a boundary are not contained).

Plan, all equi-joins:

* every feature's rings become an edge table (seq, feature_id, x1, y1, x2, y2);
* every feature gets the grid level that fits its own extent: cells are powers
  of two, between a quarter and a half of the longer side, so that a feature
  covers at most 5 x 5 cells however much the layer's features differ in size;
* candidates: features are fanned out to the cells that their bounding box
  covers, each point to its one cell of every level present -> join on
  (size, cx, cy), keep bbox hits;
* refinement: edges are fanned out to the horizontal bands (a quarter of the
  feature's cell) that their y-range covers, a candidate pair joins its feature's edges on
  (seq, band of the point) -> even-odd crossing count of a ray to +x, plus
  an exact on-edge test;
* inside = odd crossings and not on an edge; ``min_by(feature_id, seq)``
  picks the first match per point.

Holes and multi-part polygons fall out of the even-odd rule. ``seq`` must be
unique over the whole layer (``read_features`` makes it so over many files).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.plans.joins import checked_broadcast

_POLY = "array<array<array<double>>>"
_MULTI = "array<array<array<array<double>>>>"


def feature_edges(layer: DataFrame) -> DataFrame:
    """(seq, feature_id, x1, y1, x2, y2) for every ring edge of Polygon and
    MultiPolygon geometries (other geometry types contain no point)."""
    gtype = F.get_json_object("geometry", "$.type")
    coords = F.get_json_object("geometry", "$.coordinates")
    rings = (
        F.when(gtype == "Polygon", F.from_json(coords, _POLY))
        .when(gtype == "MultiPolygon", F.flatten(F.from_json(coords, _MULTI)))
    )
    r = layer.select("seq", "feature_id", F.explode(rings).alias("ring"))
    edges = F.transform(
        F.sequence(F.lit(0), F.size("ring") - 2),
        lambda i: F.struct(
            F.get(F.col("ring"), i)[0].alias("x1"), F.get(F.col("ring"), i)[1].alias("y1"),
            F.get(F.col("ring"), i + 1)[0].alias("x2"), F.get(F.col("ring"), i + 1)[1].alias("y2"),
        ),
    )
    return r.filter(F.size("ring") >= 2).select("seq", "feature_id", F.inline(edges))


#: Least cell exponent: cells of 2^-30 units keep cell numbers in 64 bits.
LEAST_LEVEL = -30


#: Cells that may be broadcast, counted: rows of some 100 bytes, 10 MB.
MAX_BROADCAST_CELLS = 100_000


def _cell(v, size):
    return F.floor(v / size).cast("long")


def _boxes(edges: DataFrame, cell: float | None) -> DataFrame:
    """(seq, feature_id, bounding box, size): a feature without extent holds no point and has no row."""
    longer = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    level = F.greatest(F.ceil(F.log2(longer)) - 2, F.lit(LEAST_LEVEL))
    size = F.lit(float(cell)) if cell else F.pow(F.lit(2.0), level.cast("double"))
    return edges.groupBy("seq", "feature_id").agg(
        F.min(F.least("x1", "x2")).alias("xmin"), F.max(F.greatest("x1", "x2")).alias("xmax"),
        F.min(F.least("y1", "y2")).alias("ymin"), F.max(F.greatest("y1", "y2")).alias("ymax"),
    ).filter(longer > 0).withColumn("size", size)


def point_in_polygon(points: DataFrame, layer: DataFrame, x_col: str = "x", y_col: str = "y",
                     key_col: str = "point_id", cell: float | None = None) -> DataFrame:
    """(key, feature_id) for every point contained in some feature
    (first in file order); points outside every feature get no row. ``cell``
    puts all features on one grid of that size."""
    edges = feature_edges(layer)
    boxes = _boxes(edges, cell)
    # the levels present: a double has some 2,000 exponents, real layers have a few
    span = lambda lo, hi: _cell(F.col(hi), F.col("size")) - _cell(F.col(lo), F.col("size")) + 1
    levels = boxes.groupBy("size").agg(F.sum(span("xmin", "xmax") * span("ymin", "ymax")).alias("n")).collect()
    sizes = sorted(r["size"] for r in levels)
    feat_cells = boxes.select(
        "*", F.explode(F.sequence(_cell(F.col("xmin"), F.col("size")), _cell(F.col("xmax"), F.col("size")))).alias("cx"),
    ).select("*", F.explode(F.sequence(_cell(F.col("ymin"), F.col("size")), _cell(F.col("ymax"), F.col("size")))).alias("cy"))
    pts = points.select(F.col(key_col).alias("pid"), F.col(x_col).cast("double").alias("x"),
                        F.col(y_col).cast("double").alias("y")).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    pts = pts.select("*", F.explode(F.lit(sizes).cast("array<double>") if sizes else F.array().cast("array<double>"))
                     .alias("size"))
    pts = pts.select("*", _cell(F.col("x"), F.col("size")).alias("cx"), _cell(F.col("y"), F.col("size")).alias("cy"))
    # A layer of few cells goes to the points. Otherwise neither side may be broadcast: a
    # point has a row per level, which the planner's estimate (the points' files) does not show.
    band = F.col("size") / 4
    if sum(r["n"] or 0 for r in levels) <= MAX_BROADCAST_CELLS:
        met = pts.join(F.broadcast(feat_cells), ["size", "cx", "cy"])
    else:
        met = pts.hint("merge").join(feat_cells, ["size", "cx", "cy"])
    cand = met.filter(
        F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    ).select("pid", "x", "y", "seq", "feature_id", _cell(F.col("y"), band).alias("band"))
    edge_bands = edges.join(checked_broadcast(boxes.select("seq", "size")), "seq").select(
        "seq", "x1", "y1", "x2", "y2",
        F.explode(F.sequence(_cell(F.least("y1", "y2"), band), _cell(F.greatest("y1", "y2"), band))).alias("band"),
    )
    x, y = F.col("x"), F.col("y")
    x1, y1, x2, y2 = F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")
    crosses = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    on_edge = (
        ((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1))
        & x.between(F.least(x1, x2), F.greatest(x1, x2))
        & y.between(F.least(y1, y2), F.greatest(y1, y2))
    )
    tested = cand.join(checked_broadcast(edge_bands), ["seq", "band"]).groupBy("pid", "seq", "feature_id").agg(
        F.count_if(crosses).alias("n_cross"), F.max(on_edge.cast("int")).alias("on_edge")
    )
    inside = tested.filter((F.col("n_cross") % 2 == 1) & (F.col("on_edge") == 0))
    return inside.groupBy("pid").agg(F.min_by("feature_id", "seq").alias("feature_id")).withColumnRenamed(
        "pid", key_col
    )
