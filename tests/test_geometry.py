"""Predicates, projections, joins."""

import random

import pytest
from pyspark.sql import functions as F

from swathline.functions import geo
from swathline.operators import spatial

SQUARE = "POLYGON((0 0, 5 0, 5 5, 0 5, 0 0))"
POINTS = [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 6.0, 6.0), (4, 2.0, 2.0)]


def layers(spark, wkts):
    polygons = spark.createDataFrame(list(enumerate(wkts)), "zone_id bigint, wkt string")
    return spatial.parse_polygons(polygons)


@pytest.mark.parametrize("predicate,expected", [("within", {1, 4}), ("contains", {1, 4}), ("intersects", {1, 2, 4})])
def test_square(spark, predicate, expected):
    points = spark.createDataFrame(POINTS, "point_id bigint, px double, py double")
    hits = spatial.points_in_polygons(points, layers(spark, [SQUARE]), predicate, cell=2.0)
    assert sorted(r.point_id for r in hits.collect()) == sorted(expected)


def test_wkt(spark):
    rows = spark.createDataFrame([("POINT(1.5 -2)",), ("POLYGON ((0 0, 4e1 0, 40 3, 0 0))",)], "wkt string")
    got = [r.p for r in rows.select(geo.wkt_points(F.col("wkt")).alias("p")).collect()]
    assert [(p.x, p.y) for p in got[0]] == [(1.5, -2.0)]
    assert [(p.x, p.y) for p in got[1]] == [(0, 0), (40, 0), (40, 3), (0, 0)]


def test_concave_polygon_by_hand(spark):
    ring = "POLYGON((0 0, 10 0, 10 10, 5 4, 0 10, 0 0))"
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate([(5, 3), (5, 5), (1, 8), (9, 8), (5, 4), (-1, 0)])]
    frame = spark.createDataFrame(points, "point_id bigint, px double, py double")
    for cell in (1.0, 3.0, 100.0):
        inside = spatial.points_in_polygons(frame, layers(spark, [ring]), "within", cell=cell)
        assert sorted(r.point_id for r in inside.collect()) == [0, 2, 3]
    fixed = frame.filter(geo.inside_fixed_rings(F.col("px"), F.col("py"), geo.parse_rings(ring)))
    assert sorted(r.point_id for r in fixed.collect()) == [0, 2, 3]


def test_box_join_against_all_pairs(spark):
    rng = random.Random(3)
    boxes = {
        side: [(i, x := rng.randint(-40, 40), y := rng.randint(-40, 40), x + rng.randint(0, 15), y + rng.randint(0, 15)) for i in range(40)]
        for side in "ab"
    }
    want = sorted(
        (a[0], b[0]) for a in boxes["a"] for b in boxes["b"] if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    )

    def frame(rows, name):
        raw = spark.createDataFrame([tuple(float(v) if k else v for k, v in enumerate(r)) for r in rows], "i bigint, x0 double, y0 double, x1 double, y1 double")
        return raw.select(F.col("i").alias(name), F.struct("x0", "y0", "x1", "y1").alias("box"))

    for cell in (4, 16):
        got = spatial.boxes_intersecting(frame(boxes["a"], "left_id"), frame(boxes["b"], "right_id"), cell)
        assert sorted((r.left_id, r.right_id) for r in got.collect()) == want


def test_footprint(spark):
    box = F.struct(*[F.lit(v).alias(n) for n, v in (("x0", 76.5), ("y0", 12.1), ("x1", 76.7), ("y1", 12.3))])
    footprints = spark.range(1).select(F.col("id").alias("left_id"), box.alias("box"))
    point = spark.createDataFrame([(7, 76.55, 12.15), (8, 77.0, 12.15)], "point_id bigint, px double, py double")
    assert [r.point_id for r in spatial.footprint_lookup(point, footprints, 1.0).collect()] == [7]


def test_projections_return(spark):
    rows = spark.createDataFrame([(91.7, 26.1), (93.0, 0.5), (95.9, 60.0)], "lon double, lat double")
    e, n = geo.lonlat_to_utm(F.col("lon"), F.col("lat"), 46)
    there = rows.select("lon", "lat", e.alias("e"), n.alias("n"))
    lon, lat = geo.utm_to_lonlat(F.col("e"), F.col("n"), 46)
    for r in there.select("lon", "lat", "e", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert r.lon2 == pytest.approx(r.lon, abs=1e-8) and r.lat2 == pytest.approx(r.lat, abs=1e-8)
        if r.lon == 93.0:
            assert r.e == pytest.approx(500000.0, abs=1e-6)
    mx, my = geo.lonlat_to_mercator(F.col("lon"), F.col("lat"))
    lon, lat = geo.mercator_to_lonlat(mx, my)
    for r in rows.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert (r.a, r.b) == (pytest.approx(r.lon), pytest.approx(r.lat))


def test_unknown_projection_is_refused(spark):
    with pytest.raises(ValueError):
        geo.project_bounds("EPSG:2154", *[F.lit(0.0)] * 4)
