"""Cells come straight from the worker that makes them: no second worker gathers whole chunks first."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from swathline.operators import chunk_focal, chunks


def plan(frame):
    with contextlib.redirect_stdout(io.StringIO()) as text:
        frame.explain()
    return text.getvalue()


@pytest.fixture(scope="module")
def stored(spark):
    rows = [(0, b, y, x, float((y * 7 + x * b) % 11) + 1) for b in (1, 2) for y in range(10) for x in range(8) if (y + x * b) % 5]
    return chunks.to_chunks(spark.createDataFrame(rows, "scene long, band int, y long, x long, value double"), 8, 4).cache()


def test_mask_in_one_pass(stored):
    names = {chunks.DIFF: "diff", chunks.MASK: "mask"}
    direct = chunks.flood_mask(stored, -1.0, tile=4, names=names)
    assert plan(direct).count("MapInArrow") == 1
    assert sorted(direct.collect()) == sorted(chunks.pixels(chunks.flood_mask(stored, -1.0), 4, names).collect()) != []


def test_windows_in_one_pass(stored):
    for made, names in ((chunk_focal.boxcar, {1: "mean", 2: "n"}), (chunk_focal.lee_filter, {1: "filtered", 2: "n"})):
        direct = made(stored, 4, 8, size=3, names=names)
        assert plan(direct).count("MapInArrow") == 1  # the strips
        key = F.struct("y", "x")
        assert direct.orderBy(key).collect() == chunks.pixels(made(stored, 4, 8, size=3), 4, names).orderBy(key).collect() != []
