"""Dense chunks against the pixel form, scene by scene."""

import math
import random

import pytest
from pyspark.sql import functions as F

from swathline.functions.tiling import tile_grid
from swathline.operators import change, chunks, otsu
from swathline.schema import Affine, Header

WIDTH, TILE, HEIGHTS = 22, 8, {5: 19, 6: 30, 7: 3}
AFFINE = Affine(x0=10.0, a=0.5, y0=60.0, e=-0.5)


@pytest.fixture(scope="module")
def scenes(spark):
    rng = random.Random(4)
    rows = []
    for scene, height in HEIGHTS.items():
        for y in range(height):
            for x in range(WIDTH):
                if scene == 6 and 8 <= y < 16:
                    continue
                level = 0.0 if y >= 24 else rng.choice([0.5, 1.0, 2.0, 4.0]) * (1 + x / 50)
                rows.append((scene, 1, y, x, level))
                if not (scene == 5 and x > 16):
                    rows.append((scene, 2, y, x, level * rng.choice([0.05, 0.1, 0.9, 1.0])))
    rows += [(7, 3, 0, 0, 9.0)]
    pixel = spark.createDataFrame(rows, "scene int, band int, y int, x int, value double").cache()
    heads = spark.createDataFrame(list(HEIGHTS.items()), "scene long, height long")
    return pixel, chunks.to_chunks(pixel, WIDTH, TILE).cache(), heads


def band(pixel, scene, k):
    return pixel.filter((F.col("scene") == scene) & (F.col("band") == k)).select(*[F.col(c).cast("bigint").alias(c) for c in "yx"], "value")


def test_flood_tiles_as_pixel_form(spark, scenes):
    pixel, stored, heads = scenes
    got = chunks.flood_tiles(stored, heads, WIDTH, AFFINE, TILE).collect()
    for scene, height in HEIGHTS.items():
        head = Header(width=WIDTH, height=height, affine=AFFINE)
        grid = tile_grid(spark, height, WIDTH, TILE)
        want = change.flood_tiles(band(pixel, scene, 1), band(pixel, scene, 2), head, TILE, grid=grid).collect()
        assert sorted(tuple(r)[1:] for r in got if r.scene == scene) == sorted(tuple(r) for r in want)
    assert {r.status for r in got} == {"SUCCESS", "EMPTY_TILE", "EMPTY_LAND", "ERROR : shape mismatch"}


def test_otsu_as_pixel_form(scenes):
    pixel, stored, heads = scenes
    got = {(r.scene, r.tile_id): r for r in chunks.flood_tiles_otsu(stored, heads, WIDTH, TILE).collect()}
    assert len(got) == sum(-(-h // TILE) * 3 for h in HEIGHTS.values())
    for scene in HEIGHTS:
        pairs = change.align(band(pixel, scene, 1), band(pixel, scene, 2), how="inner").withColumn(
            "tile_id", F.floor(F.col("y") / TILE) * 3 + F.floor(F.col("x") / TILE)
        )
        for r in otsu.flood_tiles(otsu.thresholds(otsu.histograms(pairs))).collect():
            one = got.pop((scene, r.tile_id))
            assert (one.pixel_count, one.status) == (r.pixel_count, r.status)
            assert one.threshold == pytest.approx(r.threshold) and (one.mask_path is None) == (r.mask_path is None)
    assert {r.status for r in got.values()} == {"EMPTY_OR_NODATA"}


def test_mask_pixels(scenes):
    pixel, stored, _ = scenes
    names = {chunks.DIFF: "diff_db", chunks.MASK: "mask"}
    got = {(r.scene, r.y, r.x): (r.diff_db, r.mask) for r in chunks.pixels(chunks.flood_mask(stored), TILE, names).collect()}
    want = {}
    for scene in HEIGHTS:
        pairs = change.with_change(change.align(band(pixel, scene, 1), band(pixel, scene, 2), how="inner"))
        want |= {(scene, r.y, r.x): (pytest.approx(r.diff_db, abs=1e-12), r.mask) for r in pairs.collect()}
    assert got == want


def test_values_kept_and_awkward_rows(spark):
    rows = [
        (1, 1, 0, 0, 3.0), (1, 1, 0, 0, 2.0), (1, 1, 0, 1, None), (1, 1, 0, 2, math.nan), (1, 1, 0, 3, math.inf),
        (1, 1, 0, 4, -math.inf), (1, 1, 0, 5, math.nan), (1, 1, 0, 5, 4.0), (1, 1, 0, 6, None), (1, 1, 0, 6, 5.0),
        (1, 2, 9, 9, 1.0), (2, 2, 0, 0, None),
    ]
    frame = spark.createDataFrame(rows, "scene long, band int, y long, x long, value double").withColumns(
        {c: F.lit("x") for c in ("tile_id", "bands", "y0")}
    )
    stored = chunks.to_chunks(frame, WIDTH, TILE)
    got = {(r.scene, r.y, r.x): (r.a, r.b) for r in chunks.pixels(stored, TILE, {1: "a", 2: "b"}).collect()}
    nan = got.pop((1, 0, 2))
    assert math.isnan(nan[0]) and nan[1] is None
    assert got == {
        (1, 0, 0): (2.0, None), (1, 0, 3): (math.inf, None), (1, 0, 4): (-math.inf, None), (1, 0, 5): (4.0, None),
        (1, 0, 6): (5.0, None), (1, 9, 9): (None, 1.0),
    }
    heads = spark.createDataFrame([(1, 10), (3, 4), (4, 0)], "scene long, height long")
    report = {(r.scene, r.tile_id): r.status for r in chunks.flood_tiles(stored, heads, WIDTH, AFFINE, TILE).collect()}
    assert len(report) == 9 and report[1, 0] == "ERROR : shape mismatch" and report[3, 0] == "EMPTY_TILE"
    none = chunks.to_chunks(frame.limit(0), WIDTH, TILE)
    assert chunks.flood_mask(none).count() == 0 and chunks.flood_tiles(none, heads.limit(0), WIDTH, AFFINE, TILE).count() == 0


def test_no_exchange_of_pixels_after_storing(spark, scenes, tmp_path):
    _, stored, _ = scenes
    stored.write.parquet(str(tmp_path / "chunks"))
    plan = chunks.flood_mask(spark.read.parquet(str(tmp_path / "chunks")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
