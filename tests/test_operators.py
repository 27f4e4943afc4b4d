"""Focal sums, cubes, ranks, catalogue, ML and streaming pieces."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathline.functions.ranking import exact_percentiles, rank_in_group, running_totals, smallest_per_group
from swathline.operators import catalog, change, cube, focal, ml
from swathline.session import scratch_path
from swathline.sources import files


def sparse_grid(spark, seed=1, share=0.6, size=17):
    rng = random.Random(seed)
    cells = {(y, x): round(rng.uniform(1, 9), 3) for y in range(size) for x in range(size) if rng.random() < share}
    return cells, spark.createDataFrame([(y, x, v) for (y, x), v in cells.items()], "y bigint, x bigint, value double")


@pytest.mark.parametrize("tile", [3, 8, 64])
@pytest.mark.parametrize("size", [3, 4, 10])
def test_boxcar_is_independent_of_tiles(spark, tile, size):
    cells, frame = sparse_grid(spark)
    back, ahead = size // 2, (size - 1) // 2
    got = {(r.y, r.x): (r.mean, r.n) for r in focal.boxcar(frame, "value", size, tile).collect()}
    assert set(got) == set(cells)
    for (y, x), (mean, n) in got.items():
        near = [v for (b, a), v in cells.items() if -back <= b - y <= ahead and -back <= a - x <= ahead]
        assert n == len(near) and mean == pytest.approx(sum(near) / len(near))


def test_lee_weight_limits(spark):
    _, frame = sparse_grid(spark, seed=2)
    for r in focal.lee_filter(frame, enl=4.0, tile=8).collect():
        low, high = sorted((r.mean, r.value))
        assert low - 1e-9 <= r.filtered <= high + 1e-9


def test_patches(spark):
    cells, frame = sparse_grid(spark, seed=4)
    for r in focal.patches(frame, ["value"], 5).collect():
        for k in range(9):
            assert r[f"value_{k}"] == cells.get((r.y + k // 3 - 1, r.x + k % 3 - 1), 0.0)


def test_coherence_of_identical_images_is_one(spark):
    _, frame = sparse_grid(spark)
    pair = frame.select("y", "x", F.col("value").alias("a1"), (F.col("x") * 0.3).alias("p1"), F.col("value").alias("a2"), (F.col("x") * 0.3).alias("p2"))
    assert all(r.coherence == pytest.approx(1.0) for r in focal.coherence(pair, tile=8).collect())


def test_nearest_ties_take_the_larger_coordinate(spark):
    coords = spark.range(0, 8).select(F.col("id").cast("double").alias("c"))
    got = [r.i for r in coords.select(cube.nearest_index(F.col("c"), 0.0, 2.0, 4).alias("i")).collect()]
    assert got == [0, 1, 1, 2, 2, 3, 3, 3]
    down = [r.i for r in coords.select(cube.nearest_index(F.col("c"), 6.0, -2.0, 4).alias("i")).collect()]
    assert down == [3, 2, 2, 1, 1, 0, 0, 0]


def test_bilinear_weights(spark):
    frame = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 5.0)], "y bigint, x bigint, value double")
    got = {(r.y, r.x): r.value for r in cube.reproject_bilinear(frame, 1.0, 0.5, 2, 2).collect()}
    assert got[(0, 0)] == pytest.approx(3.0)
    fine = {(r.y, r.x): r.value for r in cube.reproject_bilinear(frame, 0.5, 0.0, 4, 4).collect()}
    assert fine[(0, 0)] == pytest.approx(1.0) and fine[(0, 1)] == pytest.approx(2.0)


def test_running_totals_and_percentiles_on_skewed_values(spark):
    rng = random.Random(9)
    values = [1.5] * 400 + [round(rng.expovariate(0.2), 2) for _ in range(600)]
    frame = spark.createDataFrame([(v,) for v in values], "value double")
    got = exact_percentiles(frame, "value", [0.02, 0.5, 0.98]).first()
    assert list(got) == pytest.approx(list(np.percentile(values, [2, 50, 98])))
    counted = frame.groupBy("value").agg(F.count("*").alias("n"))
    rows = sorted(running_totals(counted, "value", ["n"]).collect(), key=lambda r: r.value)
    seen = 0
    for r in rows:
        assert r.n_before == seen and r.n_total == 1000
        seen += r.n


def test_ks_of_shifted_samples(spark):
    a = spark.range(100).select(F.col("id").cast("double").alias("value"))
    b = spark.range(100).select((F.col("id") + 30).cast("double").alias("value"))
    assert change.ks_two_sample(a, b).first().ks == pytest.approx(0.3)
    assert change.ks_two_sample(a, a).first().ks == 0


def test_rank_in_hot_group(spark):
    rows = [("hot", i) for i in range(0, 600, 2)] + [("cold", 7), ("cold", 3)]
    frame = spark.createDataFrame(rows, "name string, id bigint")
    got = {(r.name, r.id): r["rank"] for r in rank_in_group(frame, "name", "id", span=50).collect()}
    assert all(got[("hot", i)] == i // 2 for i in range(0, 600, 2))
    assert (got[("cold", 3)], got[("cold", 7)]) == (0, 1)


def test_smallest_per_group(spark):
    rows = [(c, i, (i * 37) % 5) for c in (0, 1) for i in range(60)]
    frame = spark.createDataFrame(rows, "label int, id bigint, h bigint")
    wanted = spark.createDataFrame([(0, 13), (1, 60)], "label int, k bigint")
    got = {(r.label, r.id) for r in smallest_per_group(frame, "label", "h", ["id"], wanted).collect()}
    want = {(0, i) for i, _ in sorted(((i, (i * 37) % 5) for i in range(60)), key=lambda t: (t[1], t[0]))[:13]}
    assert got == want | {(1, i) for i in range(60)}


def test_balanced_classes_are_equal(spark):
    rows = [(y, x, 1 if (y * 7 + x) % 9 == 0 else 0) for y in range(30) for x in range(30)]
    counts = ml.balance_classes(spark.createDataFrame(rows, "y bigint, x bigint, label int")).groupBy("label").count()
    assert {r["count"] for r in counts.collect()} == {sum(r[2] for r in rows)}


def test_upsert_is_idempotent_and_refuses_repeats(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id bigint, k string, v double")
    source = spark.createDataFrame([(2, "z", None), (3, "c", 3.0)], "id bigint, k string, v double")
    once = catalog.merge_upsert(target, source, ["id"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1.0), (2, "z", None), (3, "c", 3.0)]
    twice = catalog.merge_upsert(once, source, ["id"])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    with pytest.raises(PySparkException, match="twice"):
        catalog.merge_upsert(target, source.unionAll(source), ["id"]).collect()


def test_upsert_table_rewrites_only_touched_buckets(spark):
    path = scratch_path(spark, "t")
    rows = spark.range(100).select("id", F.lit("old").alias("v"))
    catalog.create_keyed_table(rows, path, ["id"], buckets=8)
    new = spark.createDataFrame([(5, "new"), (200, "new")], "id bigint, v string")
    for _ in range(2):
        catalog.upsert_table(spark, path, new, ["id"], buckets=8)
    got = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert len(got) == 101 and got[5] == got[200] == "new" and got[6] == "old"


def test_align_schema(spark):
    target = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    got = catalog.align_schema(spark.createDataFrame([(1, 2.5)], "a int, extra double"), target)
    assert got.columns == ["a", "b", "extra"] and tuple(got.first()) == (1, None, 2.5)
    assert got.schema["a"].dataType == T.LongType()


def test_enqueue_golden(spark):
    areas = spark.createDataFrame([(4, "tile_1"), (5, "tile_2")], "scene_id bigint, area string")
    existing = spark.createDataFrame([(4, "DASK")], "scene_id bigint, engine string")
    got = sorted((r.scene_id, r.engine) for r in catalog.enqueue(areas, ["PYSNAP", "SPARK", "DASK"], existing).collect())
    assert got == [(4, "PYSNAP"), (4, "SPARK"), (5, "DASK"), (5, "PYSNAP"), (5, "SPARK")]


def test_report(spark):
    matrix = spark.createDataFrame([(0, 0, 50), (0, 1, 10), (1, 0, 5), (1, 1, 35)], "truth int, predicted int, n bigint")
    got = {r.label: r for r in ml.report(matrix).collect()}
    assert got[1].precision == pytest.approx(35 / 45) and got[1].recall == pytest.approx(35 / 40)
    assert got[0].accuracy == pytest.approx(0.85) and got[0].support == 60


def test_forest_beats_the_majority_class(spark, folder):
    from swathline.plans.learning import rf_train_predict

    rows = rf_train_predict(spark, folder).collect()
    total = sum(r.n for r in rows)
    right = sum(r.n for r in rows if r.truth == r.predicted)
    majority = max(sum(r.n for r in rows if r.truth == c) for c in (0, 1))
    assert right / total > 0.9 and right > majority


def test_file_sizes_skip_content(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.bin").write_bytes(b"x" * 10)
    (tmp_path / "a" / "two.bin").write_bytes(b"x" * 5)
    listing = files.file_sizes(spark, str(tmp_path))
    assert files.footprint(listing).first()["bytes"] == 15
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan
