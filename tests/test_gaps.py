"""NULL, NaN, holes, missing cells and other coverage that the registered fixtures don't have."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from swathline.functions import geo
from swathline.functions.ranking import histogram
from swathline.operators import catalog, change, cube, focal, spatial
from swathline.schema import Affine, Header
from swathline.session import scratch_path
from swathline.sources import documents, raster

NAN = float("nan")
HOLED = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 8 2, 8 8, 2 8, 2 2))"
PARTS = "MULTIPOLYGON(((0 0, 3 0, 3 3, 0 3, 0 0)), ((6 6, 9 6, 9 9, 6 9, 6 6), (7 7, 8 7, 8 8, 7 8, 7 7)))"


def in_holed(x, y):
    return 0 < x < 10 and 0 < y < 10 and not (2 <= x <= 8 and 2 <= y <= 8)


def in_parts(x, y):
    return (0 < x < 3 and 0 < y < 3) or (6 < x < 9 and 6 < y < 9 and not (7 <= x <= 8 and 7 <= y <= 8))


def pixels(spark, rows):
    return spark.createDataFrame(rows, "y bigint, x bigint, value double")


@pytest.mark.parametrize("wkt,inside", [(HOLED, in_holed), (PARTS, in_parts)])
def test_holes_and_parts(spark, wkt, inside):
    points = [(20 * i + j, i * 0.5 + 0.25, j * 0.5) for i in range(20) for j in range(20)]
    frame = spark.createDataFrame(points, "point_id bigint, px double, py double")
    zones = spatial.parse_polygons(spark.createDataFrame([(1, wkt)], "zone_id bigint, wkt string"))
    want = {p for p, x, y in points if inside(x, y)}
    assert {r.point_id for r in spatial.points_in_polygons(frame, zones, cell=3.0).collect()} == want
    fixed = frame.filter(geo.inside_fixed_rings(F.col("px"), F.col("py"), geo.parse_rings(wkt)))
    assert {r.point_id for r in fixed.collect()} == want


def test_indented_geojson_with_holes_and_parts(spark):
    square = [[0, 0], [4, 0], [4, 4], [0, 0]]
    hole = [[1, 1], [2, 1], [2, 2], [1, 1]]
    shapes = [("Polygon", [square, hole]), ("MultiPolygon", [[square], [hole, square]])]
    features = [
        {"type": "Feature", "properties": {"value": i}, "geometry": {"type": kind, "coordinates": c}}
        for i, (kind, c) in enumerate(shapes)
    ]
    text = json.dumps({"type": "FeatureCollection", "features": features}, indent=2)
    path = scratch_path(spark, "geojson")
    documents.write_each(spark.createDataFrame([(1, text)], "k int, doc string"), path, "k")
    got = {r.value: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in documents.read_features(spark, path).collect()}
    as_points = lambda ring: [(float(x), float(y)) for x, y in ring]
    assert got == {0: [as_points(square), as_points(hole)], 1: [as_points(square), as_points(hole), as_points(square)]}


def test_broken_geojson_raises(spark):
    path = scratch_path(spark, "geojson")
    documents.write_each(spark.createDataFrame([(1, '{"type": "FeatureCollection", "features": [')], "k int, doc string"), path, "k")
    with pytest.raises((PySparkException, Py4JJavaError)):
        documents.read_features(spark, path).collect()


def test_absent_lists_in_documents(spark):
    ball = {"batter": "a", "bowler": "b", "runs": {"batter": 1, "total": 2}, "wickets": None}
    innings = [{"team": "t", "overs": None}, {"team": "u", "overs": [{"over": 3, "deliveries": [ball]}, {"over": 4}]}, None]
    docs = [json.dumps({"info": {"match_id": i}, "innings": inn}) for i, inn in enumerate([innings, None, []])]
    parsed = documents.parse_matches(spark.createDataFrame([(d,) for d in docs], "doc string"))
    rows = documents.with_wickets(documents.balls(parsed)).collect()
    assert [(r.match_id, r.batting_team, r.over_num, r.total, r.wicket_kind) for r in rows] == [(0, "u", 3, 2, None)]


def test_moving_mean_with_null_and_nan(spark):
    frame = pixels(spark, [(0, 0, 4.0), (0, 1, None), (0, 2, NAN), (0, 9, None)])
    got = {r.x: (r.mean, r.n) for r in focal.boxcar(frame, "value", 3, 4).collect()}
    assert got == {0: (4.0, 1), 1: (2.0, 2), 2: (0.0, 1), 9: (None, 0)}


def test_lee_and_coherence_skip_nan(spark):
    frame = pixels(spark, [(0, 0, 4.0), (0, 1, NAN), (1, 0, 4.0), (1, 1, None)])
    got = {(r.y, r.x): (r.filtered, r.n) for r in focal.lee_filter(frame, tile=4).collect()}
    assert got == {(0, 0): (4.0, 2), (1, 0): (4.0, 2), (0, 1): (None, 2), (1, 1): (None, 2)}
    pair = frame.select("y", "x", F.col("value").alias("a1"), F.lit(0.1).alias("p1"), F.lit(2.0).alias("a2"), F.lit(0.1).alias("p2"))
    assert all(r.coherence == pytest.approx(1.0) and r.n == 2 for r in focal.coherence(pair, tile=4).collect())


def test_windows_at_negative_indices(spark):
    frame = pixels(spark, [(y, x, 1.0) for y in (-3, -1, 0) for x in (-2, 0)])
    assert {(r.y, r.x): r.n for r in focal.boxcar(frame, "value", 3, 4).collect()} == {
        (-3, -2): 1, (-3, 0): 1, (-1, -2): 2, (-1, 0): 2, (0, -2): 2, (0, 0): 2
    }


def test_resampling_weighs_valid_pixels_only(spark):
    frame = pixels(spark, [(0, 0, 4.0), (0, 1, None), (0, 2, NAN), (0, 3, -1.0), (0, 4, 8.0)])
    got = {r.x: (r.value, r.n) for r in cube.reproject_bilinear(frame, 1.0, 0.5, nodata=-1.0).filter("y = 0").collect()}
    assert got == {-1: (4.0, 1), 0: (4.0, 1), 1: (None, 0), 2: (None, 0), 3: (8.0, 1), 4: (8.0, 1)}


def test_calibration_keeps_every_pixel(spark):
    frame = spark.createDataFrame([(g, k) for g in ("a", "b", None) for k in (-5, 0, 3, 10, 64, 99, None)], "g string, k bigint")
    nodes = spark.createDataFrame([("a", 0, 0.0), ("a", 10, 100.0), ("a", 64, 7.0)], "g string, node bigint, lut double")
    want = {-5: 0.0, 0: 0.0, 3: 30.0, 10: 100.0, 64: 7.0, 99: 7.0, None: None}
    got = [(r.g, r.k, r.lut) for r in cube.interpolate_table(frame, "k", nodes, 8, ["g"]).collect()]
    assert len(got) == 21
    assert all(lut == pytest.approx(want[k]) if g == "a" else lut is None for g, k, lut in got if k is not None or g != "a")
    plain = {r.k: r.lut for r in cube.interpolate_table(frame.filter("g = 'a'").drop("g"), "k", nodes.drop("g"), 8).collect()}
    assert plain == pytest.approx({k: v for k, v in want.items() if k is not None} | {None: None})


def test_comparison_reports_what_is_missing(spark):
    def band(rows):
        return spark.createDataFrame([(1, 0, x, v) for x, v in rows], "band int, y bigint, x bigint, value double")

    base = band([(0, 1.0), (1, 2.0), (2, None), (3, None), (4, NAN), (5, 1.0), (6, 1.0)])
    other = band([(0, 1.0), (1, 2.5), (2, None), (3, 1.0), (4, NAN), (7, 1.0)])
    r = change.compare(base, other).first()
    assert (r.n, r.only_base, r.only_other, r.mismatched, r.max_abs_diff, r.base_max) == (5, 2, 1, 2, 0.5, 2.0)


def test_distribution_distance_without_nan(spark):
    first, second = pixels(spark, [(0, 0, 1.0), (0, 1, NAN)]), pixels(spark, [(0, 0, 1.0), (0, 1, None)])
    r = change.ks_two_sample(first, second).first()
    assert (r.ks, r.n_first, r.n_second) == (0.0, 1, 1)


def test_histogram_of_a_constant_band(spark):
    rows = histogram(pixels(spark, [(0, 0, 3.0), (0, 1, 3.0), (0, 2, NAN), (0, 3, None)]), "value", 200).collect()
    assert [(r.bin, r.n) for r in rows] == [(0, 2)]


def test_both_forms_of_change_give_the_same_states(spark):
    head = Header(8, 2, Affine(0.0, 1.0, 0.0, -1.0))
    # Tile 0: alike. Tile 1: as many pixels, but others. Tile 2: after only. Tile 3: before only.
    pre = pixels(spark, [(0, 0, 1.0), (0, 1, 1.0), (0, 2, 1.0), (0, 6, 1.0)])
    post = pixels(spark, [(0, 0, 1.0), (0, 1, 0.1), (0, 3, 1.0), (0, 4, 1.0)])
    plain = {r.tile_id: (r.status, r.pixel_count) for r in change.flood_tiles(pre, post, head, 2).collect()}
    chunks = [raster.rechunk(p, 2, 8) for p in (pre, post)]
    assert plain == {r.tile_id: (r.status, r.pixel_count) for r in change.flood_tiles_chunked(*chunks, head, 2).collect()}
    assert [plain[k][0] for k in range(4)] == ["SUCCESS", "ERROR : shape mismatch", "EMPTY_TILE", "ERROR : shape mismatch"]


def test_zone_without_pixels(spark):
    zones = spatial.parse_polygons(spark.createDataFrame([(1, "POLYGON((0 0, 5 0, 5 5, 0 5, 0 0))"), (2, PARTS)], "zone_id bigint, wkt string"))
    frame = spark.createDataFrame([(4.0, 4.0, 1)], "px double, py double, mask int")
    assert {r.zone_id: (r.pixels, r.flooded) for r in spatial.zone_stats(frame, zones).collect()} == {1: (1, 1), 2: (0, 0)}


def test_last_status_holds(spark):
    jobs = spark.createDataFrame([(1, "CREATED"), (2, "CREATED")], "job_id bigint, job_status string")
    updates = spark.createDataFrame([(1, "RUNNING", 1), (1, "FAILED", 2)], "job_id bigint, new_status string, seq int")
    got = {r.job_id: r.job_status for r in catalog.set_status(jobs, updates, "seq").collect()}
    assert got == {1: "FAILED", 2: "CREATED"}
    with pytest.raises(PySparkException):
        catalog.set_status(jobs, updates).collect()
