"""Rows that once got lost: windows without pixels, NULL groups; and the guard of the optional part."""

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from swathline.functions.ranking import smallest_per_group
from swathline.sources import raster


def test_windows_without_pixels_stay(spark):
    pixels = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0), (9, 9, None)], "y long, x long, value double")
    windows = spark.createDataFrame([(1, 0, 0), (2, 50, 50), (3, 8, 8)], "window_id long, y0 long, x0 long")
    got = {r.window_id: (r.n, r.total) for r in raster.window_stats(windows, pixels, 4).collect()}
    assert got == {1: (2, 3.0), 2: (0, None), 3: (1, None)}


def test_smallest_of_a_null_group(spark):
    rows = [("a", h, h) for h in (5, 3, 9, 3)] + [(None, h, h) for h in (7, None, 2)]
    frame = spark.createDataFrame(rows, "g string, h long, id long")
    wanted = frame.groupBy("g").agg(F.lit(2).alias("k"))
    got = smallest_per_group(frame, "g", "h", ["id"], wanted).collect()
    assert sorted((str(r.g), str(r.h)) for r in got) == [("None", "2"), ("None", "None"), ("a", "3"), ("a", "3")]


def test_entry_without_a_library_of_the_optional_part():
    code = (
        "import sys; sys.modules['xxhash'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; print(len(e.queries()) > 100, any(n.startswith('op1_') for n in e.queries()))"
    )
    root = Path(__file__).resolve().parent.parent
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "False"], out.stderr
