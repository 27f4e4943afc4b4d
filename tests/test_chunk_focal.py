"""Focal operators on chunks against the pixel form."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.operators import chunk_focal, chunks, focal

WIDTH, HEIGHT, TILE = 21, 26, 8


def cells(seed):
    rng = random.Random(seed)
    return {(y, x) for y in range(HEIGHT) for x in range(WIDTH) if rng.random() < 0.8 and not (8 <= y < 16 and x < 8)}


@pytest.fixture(scope="module")
def rasters(spark):
    """Two scenes of four bands with holes, an empty tile and NaN."""
    rng, rows = random.Random(1), []
    for scene in (3, 4):
        for y, x in sorted(cells(scene)):
            value = math.nan if rng.random() < 0.03 else 0.0 if rng.random() < 0.05 else rng.uniform(0.1, 9)
            rows.append((scene, y, x, value, rng.uniform(-3, 3), rng.uniform(0, 5), rng.uniform(-3, 3)))
    frame = spark.createDataFrame(rows, "scene long, y long, x long, a1 double, p1 double, a2 double, p2 double").cache()
    long = frame.selectExpr("scene", "y", "x", "stack(4, 1, a1, 2, p1, 3, a2, 4, p2) AS (band, value)")
    return frame, chunks.to_chunks(long, WIDTH, TILE).cache()


def table(frame, *names):
    return {
        (r.scene, r.y, r.x): tuple(None if r[n] is None or math.isnan(r[n]) else round(r[n], 9) for n in names) for r in frame.collect()
    }


def by_scene(frame, make, *names):
    out = {}
    for scene in (3, 4):
        out |= table(make(frame.filter(F.col("scene") == scene).drop("scene")).withColumn("scene", F.lit(scene)), *names)
    return out


@pytest.mark.parametrize("size", [1, 3, 4, 10])
def test_boxcar(rasters, size):
    frame, stored = rasters
    want = by_scene(frame, lambda f: focal.boxcar(f.withColumnRenamed("a1", "value"), "value", size, TILE), "mean", "n")
    if size > 9:
        assert size // 2 <= TILE
    got = table(chunks.pixels(chunk_focal.boxcar(stored, TILE, WIDTH, size), TILE, {1: "mean", 2: "n"}), "mean", "n")
    assert got == want


def test_lee(rasters):
    frame, stored = rasters
    want = by_scene(frame, lambda f: focal.lee_filter(f.withColumnRenamed("a1", "value"), 4.0, 3, TILE), "filtered")
    got = table(chunks.pixels(chunk_focal.lee_filter(stored, TILE, WIDTH, 4.0), TILE, {1: "filtered", 2: "n"}), "filtered")
    want = {k: v for k, v in want.items()}
    assert set(got) == set(want)
    for k, (v,) in want.items():
        assert got[k][0] == (None if v is None else pytest.approx(v, abs=1e-7))


def test_interferogram_and_coherence(rasters):
    frame, stored = rasters
    want = by_scene(frame, lambda f: focal.interferogram(f, 4, TILE), "phase")
    got = table(chunks.pixels(chunk_focal.interferogram(stored, TILE, WIDTH, 4), TILE, {1: "phase"}), "phase")
    want = {k: v for k, v in want.items() if v[0] is not None}
    assert set(got) == set(want) and all(got[k][0] == pytest.approx(want[k][0], abs=1e-7) for k in got)
    want = by_scene(frame, lambda f: focal.coherence(f, 3, 6, TILE), "coherence", "n")
    got = table(chunks.pixels(chunk_focal.coherence(stored, TILE, WIDTH, 3, 6), TILE, {1: "coherence", 2: "n"}), "coherence", "n")
    assert set(got) == set(want)
    for k, (v, n) in want.items():
        assert got[k][1] == n and (got[k][0] is None) == (v is None) and (v is None or got[k][0] == pytest.approx(v, abs=1e-6))


def test_window_sums_of_special_values():
    rng = np.random.default_rng(0)
    values = rng.random((20, 30))
    values[3, 4], values[10, 10], values[10, 12], values[15, 20] = np.inf, -np.inf, np.inf, np.nan
    before, after = (2, 1), (1, 3)
    got = chunk_focal.window_sum(values, before, after)
    with np.errstate(invalid="ignore"):
        want = np.array([[values[y : y + 4, x : x + 5].sum() for x in range(26)] for y in range(17)])
    assert got.shape == want.shape and np.allclose(got, want, equal_nan=True)


def test_limits_empty_and_strips_only(spark, rasters, tmp_path):
    _, stored = rasters
    with pytest.raises(ValueError):
        chunk_focal.boxcar(stored, TILE, WIDTH, 18)
    assert chunk_focal.boxcar(stored.limit(0), TILE, WIDTH, 3).count() == 0
    stored.write.bucketBy(4, "scene", "tile_id").sortBy("scene", "tile_id").mode("overwrite").option(
        "path", str(tmp_path / "chunks")
    ).saveAsTable("focal_chunks")
    plan = chunk_focal.boxcar(spark.table("focal_chunks"), TILE, WIDTH, 10)._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE focal_chunks")
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("reach,cell", [(25.0, (10.0, 7.0)), (3.0, (1.0, 1.0)), (0.0, (1.0, 1.0)), (7.9, (1.0, 2.5))])
def test_buffer_distances(spark, reach, cell):
    held = {(0, 0), (7, 7), (8, 20), (25, 3), (16, 8)}
    rows = [(s, 1, y, x, 1.0) for s in (1, 2) for y, x in held if s == 1 or y > 10]
    frame = spark.createDataFrame(rows, "scene long, band int, y long, x long, value double")
    found = chunk_focal.buffer(chunks.to_chunks(frame, WIDTH, TILE), TILE, WIDTH, HEIGHT, reach, cell)
    got = {(r.scene, r.y, r.x): r.distance for r in found.collect()}
    want = {}
    for s in (1, 2):
        own = [p for p in held if s == 1 or p[0] > 10]
        for y in range(HEIGHT):
            for x in range(WIDTH):
                near = min(math.hypot((y - a) * cell[0], (x - b) * cell[1]) for a, b in own)
                if near <= reach:
                    want[s, y, x] = pytest.approx(near)
    assert got == want
