"""Detection rules, nodata rules and golden cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.functions.radiometry import below, change_db, db_clipped, db_masked
from swathline.functions.tiling import tile_grid
from swathline.operators import change, otsu
from swathline.schema import Affine, Header
from swathline.sources import fixtures, raster

AFFINE = Affine(0.0, 1.0, 0.0, -1.0)


def grid(spark, values):
    return spark.createDataFrame([(y, x, float(v)) for (y, x), v in values.items()], "y bigint, x bigint, value double")


def test_db_floor_and_nan(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, float("nan")), (1.0, 0.1)], "pre double, post double")
    got = rows.select(
        db_clipped(F.col("pre")).alias("p"), below(change_db(F.col("pre"), F.col("post")), -5.5).alias("m")
    ).collect()
    assert got[0].p == pytest.approx(-60.0) and got[0].m == 0
    assert got[1].m == 0
    assert got[2].m == 1


def test_masked_db_skips_zero_nan_and_negative(spark):
    rows = spark.createDataFrame([(0.0,), (float("nan"),), (-1.0,), (10.0,)], "v double")
    got = [r.d for r in rows.select(db_masked(F.col("v")).alias("d")).collect()]
    assert got[:3] == [None, None, None] and got[3] == pytest.approx(10.0)


def test_tile_states(spark):
    pre = grid(spark, {(0, 0): 1.0, (0, 1): 1.0, (0, 2): 0.0, (0, 3): 0.0, (0, 4): 5.0})
    post = grid(spark, {(0, 0): 0.1, (0, 1): 1.0, (0, 2): 3.0, (0, 3): 0.0})
    tiles = tile_grid(spark, 2, 8, 2).select("tile_id")
    got = {r.tile_id: (r.status, r.pixel_count, r.min_lon) for r in change.flood_tiles(
        pre, post, Header(8, 2, AFFINE), tile=2, grid=tiles).collect()}
    assert got[0] == ("SUCCESS", 1, 0.0)
    assert got[1] == ("EMPTY_LAND", 0, None)
    assert got[2] == ("ERROR : shape mismatch", 0, None)
    assert got[3] == ("EMPTY_TILE", 0, None)


def test_edge_tiles(spark):
    rows = tile_grid(spark, 411, 256, 64).collect()
    assert len(rows) == 28
    assert {r.h for r in rows if r.tile_id >= 24} == {27}


def test_total_does_not_depend_on_tile_size(spark, folder):
    pre, post = fixtures.pre_raster(spark, folder), fixtures.post_raster(spark, folder)
    head = fixtures.header(spark, folder)
    totals = {
        size: change.flood_total(change.flood_tiles(pre, post, head, size)).first().flooded_pixels for size in (64, 128, 256)
    }
    assert set(totals.values()) == {1609}


def test_flagship_stays_in_the_jvm(spark, folder):
    head = fixtures.header(spark, folder)
    tiles = change.flood_tiles(fixtures.pre_raster(spark, folder), fixtures.post_raster(spark, folder), head, 64)
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_map_algebra_has_the_given_sign(spark):
    dark, bright = grid(spark, {(0, 0): 0.1}), grid(spark, {(0, 0): 1.0})
    from swathline.plans.flood import ALGEBRA

    assert change.map_algebra(dark, bright, ALGEBRA).first().value == 1
    assert change.map_algebra(bright, dark, ALGEBRA).first().value == 0


def plain_otsu(diff, bins=256):
    """Threshold by trying every split of the histogram."""
    low, high = min(diff), max(diff)
    if low == high:
        return low
    counts, centres = np.zeros(bins), [low + (i + 0.5) * (high - low) / bins for i in range(bins)]
    for d in diff:
        counts[min(bins - 1, math.floor((d - low) / (high - low) * bins))] += 1
    best, where = -1.0, None
    for i in range(bins - 1):
        left, right = counts[: i + 1].sum(), counts[i + 1 :].sum()
        m1 = (counts[: i + 1] * centres[: i + 1]).sum() / left
        m2 = (counts[i + 1 :] * centres[i + 1 :]).sum() / right
        score = round(left * right * (m1 - m2) ** 2 / len(diff) ** 2, 9)
        if score > best:
            best, where = score, centres[i]
    return where


def test_otsu_against_all_splits(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for tile in range(5):
        pre = [rng.uniform(1, 50) for _ in range(300)]
        post = [p * (rng.uniform(0.01, 0.05) if rng.random() < 0.3 else rng.uniform(0.8, 1.2)) for p in pre]
        rows += [(tile, a, b) for a, b in zip(pre, post)]
        want[tile] = plain_otsu([10 * math.log10(b) - 10 * math.log10(a) for a, b in zip(pre, post)])
    rows += [(9, 2.0, 1.0)] * 4 + [(8, 0.0, 1.0)] * 3 + [(7, 1.0, float("nan"))]
    limits = otsu.thresholds(otsu.histograms(spark.createDataFrame(rows, "tile_id bigint, pre double, post double")))
    got = {r.tile_id: r for r in limits.collect()}
    for tile, limit in want.items():
        assert got[tile].threshold == pytest.approx(limit, abs=1e-9)
        inside = [10 * math.log10(b) - 10 * math.log10(a) < limit for t, a, b in rows if t == tile]
        assert got[tile].n_under == sum(inside)
    assert got[9].threshold == pytest.approx(10 * math.log10(0.5))
    status = {r.tile_id: r.status for r in otsu.flood_tiles(limits).collect()}
    assert status[0] == "SUCCESS_OTSU" and status[8] == "EMPTY_OR_NODATA" and status[7] == "SUCCESS_FIXED"
    assert status[9] == "SUCCESS_OTSU"


def test_otsu_fallback(spark):
    rows = [(1, 1.0, 0.7), (1, 1.0, 0.9), (1, 1.0, 0.2)] + [(1, 1.0, 0.95)] * 20
    limits = otsu.thresholds(otsu.histograms(spark.createDataFrame(rows, "tile_id bigint, pre double, post double")))
    got = otsu.flood_tiles(limits).first()
    if limits.first().threshold < -3.0:
        assert got.status == "SUCCESS_OTSU"
    else:
        assert (got.status, got.threshold, got.pixel_count) == ("SUCCESS_FALLBACK", -5.5, 1)


def test_chunk_form_equals_pixel_form(spark, folder):
    pixels = fixtures.pre_raster(spark, folder)
    back = raster.unchunk(raster.rechunk(pixels, 64, 256)).select("y", "x", "value")
    assert back.exceptAll(pixels).isEmpty() and pixels.exceptAll(back).isEmpty()


def test_window_reads_prune(spark, folder, tmp_path):
    path = str(tmp_path / "raster")
    raster.store_raster(fixtures.bands(spark, folder).select("band", "y", "x", "value"), path, 16)
    window = raster.read_window(spark.read.parquet(path), 16, 2, 5, 30, 20, 40)
    plan = window._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "(band" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(tile_y" in scan.split("PushedFilters")[1]
    want = fixtures.post_raster(spark, folder).filter("y >= 5 and y < 25 and x >= 30 and x < 70").count()
    assert window.count() == want


def test_mosaic_and_flip(spark):
    first, second = grid(spark, {(0, 0): 0.0, (0, 1): 2.0}), grid(spark, {(0, 0): 5.0, (0, 1): 9.0})
    got = {(r.y, r.x): (r.value, r.source) for r in raster.mosaic_first([first, second]).collect()}
    assert got == {(0, 0): (5.0, 1), (0, 1): (2.0, 0)}
    assert raster.flipped_affine(Affine(0.0, 1.0, 10.0, 2.0), 5) == Affine(0.0, 1.0, 20.0, -2.0)
    assert [r.y for r in raster.flip_north_up(first, 4).collect()] == [3, 3]


def test_chunked_detection_needs_no_exchange(spark, folder):
    from swathline.plans.flood import flood_tiles_chunked

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tiles = flood_tiles_chunked(spark, folder)
        plan = tiles._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    assert sum(r.pixel_count for r in tiles.collect()) == 1609


def test_chunked_states(spark):
    pre = grid(spark, {(0, 0): 1.0, (0, 1): 1.0, (0, 2): 0.0, (0, 3): 0.0, (0, 4): 5.0, (0, 6): 1.0})
    post = grid(spark, {(0, 0): 0.1, (0, 1): 1.0, (0, 2): 3.0, (0, 3): 0.0, (0, 7): 1.0})
    got = change.flood_tiles_chunked(raster.rechunk(pre, 2, 8), raster.rechunk(post, 2, 8), Header(8, 2, AFFINE), 2)
    assert {r.tile_id: (r.status, r.pixel_count) for r in got.collect()} == {
        0: ("SUCCESS", 1),
        1: ("EMPTY_LAND", 0),
        2: ("ERROR : shape mismatch", 0),
        3: ("ERROR : shape mismatch", 0),
    }
