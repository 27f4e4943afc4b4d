"""What a task holds: operators on tiles keep no hash table over all the pixels of a partition."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from swathline.operators import cube, focal, ml, vectorize


def plan(frame):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain()
    return text.getvalue()


def pixels(spark, rows):
    return spark.createDataFrame(rows, "y bigint, x bigint, value double")


@pytest.fixture(scope="module")
def grid(spark):
    return pixels(spark, [(y, x, float((y * 31 + x * 17) % 23)) for y in range(-3, 15) for x in range(12) if (y + 2 * x) % 7])


def test_windows_hold_one_tile(spark, grid):
    pair = grid.select("y", "x", F.col("value").alias("a1"), F.lit(0.1).alias("p1"), F.lit(2.0).alias("a2"), F.lit(0.3).alias("p2"))
    for made in (focal.boxcar(grid), focal.lee_filter(grid), focal.interferogram(pair), focal.coherence(pair)):
        text = plan(made)
        assert "FlatMapGroupsInArrow" in text and "Aggregate" not in text


def test_patches_hold_one_tile(spark, grid):
    frame = grid.select("y", "x", F.lit(0).alias("tile_id"), F.lit(1).alias("label"), F.col("value").alias("pre"), F.col("value").alias("post"))
    text = plan(ml.patch_features(frame, 4, 15, 12))
    assert "FlatMapGroupsInArrow" in text and "Aggregate" not in text
    # The spread of a tile is taken before its rows are widened by 27 columns.
    assert text.index("FlatMapGroupsInArrow") < text.index("Window")


def test_spread_of_a_tile_leaves_the_halo_out(spark, grid):
    frame = grid.select("y", "x", F.lit(0).alias("tile_id"), F.lit(1).alias("label"), F.col("value").alias("pre"), F.col("value").alias("post"))
    held = {(r.y, r.x): r.value for r in grid.collect()}
    rows = ml.patch_features(frame, 4, 15, 12).collect()
    assert rows
    for r in rows:
        tile = [v for (y, x), v in held.items() if y // 4 == r.y // 4 and x // 4 == r.x // 4]
        mean = sum(tile) / len(tile)
        assert r.f30 == pytest.approx(sum((v - mean) ** 2 for v in tile) / len(tile))


def test_pixels_given_twice(spark):
    frame = pixels(spark, [(0, 0, 1.0), (0, 0, 3.0), (0, 1, None), (0, 1, None), (0, 2, 5.0)])
    got = {r.x: (r.value, r.n, r.mean) for r in focal.boxcar(frame, "value", 3, 2).collect()}
    assert got == {0: (3.0, 2, 2.0), 1: (None, 3, 3.0), 2: (5.0, 1, 5.0)}
    got = {r.x: (r.value_3, r.value_4, r.value_5) for r in focal.patches(frame, ["value"], 2).collect()}
    assert got == {0: (0.0, 3.0, 0.0), 1: (3.0, 0.0, 5.0), 2: (0.0, 5.0, 0.0)}


def test_resampling_holds_one_tile(spark, grid):
    assert "Aggregate" not in plan(cube.reproject_bilinear(grid, 1.0, 0.5))
    held = {(r.y, r.x): r.value for r in grid.collect()}
    for scale, shift in ((1.0, 0.5), (0.01, -1.3037), (3.0, 0.25)):
        want = {}
        for (y, x), v in held.items():
            for ty in range(int((y - 1 - shift) // scale) + 1, int(-((shift - y - 1) // scale))):
                for tx in range(int((x - 1 - shift) // scale) + 1, int(-((shift - x - 1) // scale))):
                    if not (0 <= ty < 300 and 120 <= tx < 140):
                        continue
                    w = (1 - abs(y - (ty * scale + shift))) * (1 - abs(x - (tx * scale + shift)))
                    total, weight, n = want.get((ty, tx), (0.0, 0.0, 0))
                    want[ty, tx] = total + v * w, weight + w, n + 1
        rows = cube.reproject_bilinear(grid, scale, shift, 300, 140).filter("x >= 120").collect()
        assert {(r.y, r.x): r.n for r in rows} == {k: n for k, (_, _, n) in want.items()}
        assert all(r.value == pytest.approx(want[r.y, r.x][0] / want[r.y, r.x][1]) for r in rows)


def test_edges_hold_one_tile(spark):
    cells = {(y, x): "ab"[(y * 5 + x * 3) % 11 > 4] for y in range(-5, 9) for x in range(9) if (y * x) % 5 != 1} | {(2, 3): None, (2, 4): None}
    frame = spark.createDataFrame([(k, y, x) for (y, x), k in cells.items()], "label string, y bigint, x bigint")
    edges = vectorize.boundary_edges(frame, "label", 4)
    assert "Aggregate" not in plan(edges)
    want = {
        (k, y, x, side)
        for (y, x), k in cells.items()
        for side, (dy, dx) in enumerate(((-1, 0), (0, -1), (1, 0), (0, 1)))
        if cells.get((y + dy, x + dx), "none") != k
    }
    rows = [(r.label, r.y, r.x, r.side) for r in edges.collect()]
    assert len(rows) == len(want) and set(rows) == want
