"""Feature tables, class balance, splits, forests and their reports."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathline.functions.ranking import smallest_per_group
from swathline.operators.focal import patches
from swathline.schema import LABEL_NODATA
from swathline.session import cut_lineage

# Fixed values of a small arithmetic hash that every SQL engine evaluates alike.
HASH_Y, HASH_X, HASH_ADD, HASH_MOD = 7919, 104729, 12345, 1000003

TILE_FEATURES = ["pre", "post", "diff", "pre_std", "pre_var", "post_std", "post_var", "diff_std", "diff_var"]


def pixel_hash(y: Column, x: Column) -> Column:
    return (y * HASH_Y + x * HASH_X + HASH_ADD) % HASH_MOD


def sample_tiles(tiles: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """A reproducible sample of tiles: the first ``count`` in hash order (a top-k)."""
    hashed = (F.col("tile_id") * HASH_X + F.lit(seed) * HASH_Y + HASH_ADD) % HASH_MOD
    return tiles.withColumn("h", hashed).orderBy("h", "tile_id").limit(count).drop("h")


def tile_features(labelled: DataFrame) -> DataFrame:
    """Nine features per pixel from (tile_id, y, x, pre, post, label).

    Tile statistics cover all tile pixels; unlabelled pixels are dropped afterwards.
    """
    tile = Window.partitionBy("tile_id")
    frame = labelled.withColumn("diff", F.col("post") - F.col("pre"))
    stats = {}
    for name in ("pre", "post", "diff"):
        stats[f"{name}_std"] = F.stddev_pop(name).over(tile)
        stats[f"{name}_var"] = F.var_pop(name).over(tile)
    return (
        frame.withColumns(stats)
        .filter(F.col("label") != LABEL_NODATA)
        .select("tile_id", "y", "x", "label", *TILE_FEATURES)
    )


def patch_features(labelled: DataFrame, tile: int, height, width: int) -> DataFrame:
    """33 features: 3x3 patches of pre, post and diff, then three std and three var of
    the tile, taken over labelled pixels. The outer raster border is dropped."""
    frame = labelled.withColumn("diff", F.col("post") - F.col("pre"))
    valid = F.col("label") != LABEL_NODATA
    by_tile = Window.partitionBy("ty", "tx")
    stats = {}
    for kind, fn in (("std", F.stddev_pop), ("var", F.var_pop)):
        for name in ("pre", "post", "diff"):
            stats[f"{name}_{kind}"] = fn(F.when(valid & F.col("home"), F.col(name))).over(by_tile)
    gathered = patches(frame, ["pre", "post", "diff"], tile, of_tile=stats)
    inner = (F.col("y") >= 1) & (F.col("x") >= 1) & (F.col("y") < height - 1) & (F.col("x") < width - 1)
    names = [f"{n}_{k}" for n in ("pre", "post", "diff") for k in range(9)] + list(stats)
    return gathered.filter(valid & inner).select(
        "tile_id", "y", "x", "label", *[F.col(n).alias(f"f{i}") for i, n in enumerate(names)]
    )


def balance_classes(labelled: DataFrame) -> DataFrame:
    """Every class cut to the size of the smallest one, in hash order."""
    hashed = labelled.withColumn("h", pixel_hash(F.col("y"), F.col("x")))
    sizes = hashed.groupBy("label").agg(F.count("*").alias("n"))
    smallest = sizes.agg(F.min("n")).scalar()
    wanted = sizes.select("label", smallest.alias("k"))
    return smallest_per_group(hashed, "label", "h", ["y", "x"], wanted).drop("h")


def split(df: DataFrame, test_percent: int = 20, seed: int = 42) -> DataFrame:
    """Marks each row train or test by hash, independent of partitioning."""
    bucket = (pixel_hash(F.col("y"), F.col("x")) * (seed + 1) + seed) % 100
    return df.withColumn("part", F.when(bucket < test_percent, "test").otherwise("train"))


def train_forest(train: DataFrame, features: list[str], trees: int = 10, depth: int = 5, seed: int = 42):
    """A fitted forest. Training passes over its rows several times, so they are stored first and made once."""
    train = cut_lineage(train.select("label", *features))
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed
    )
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), forest]).fit(train)


def inspect(model, features: list[str]) -> list[tuple[str, float, int, int]]:
    """Feature importances with the number of trees and the greatest depth."""
    forest = model.stages[-1]
    depth = max(t.depth for t in forest.trees)
    return [(n, float(forest.featureImportances[i]), forest.getNumTrees, depth) for i, n in enumerate(features)]


def confusion(pairs: DataFrame, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    return pairs.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1, support per class and overall accuracy from a confusion table."""
    hit = F.col("truth") == F.col("predicted")
    sides = matrix.select(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).alias("claimed"),
                          F.when(hit, F.col("n")).otherwise(0).alias("hits")).unionByName(
        matrix.select(F.col("predicted").alias("label"), F.lit(0).alias("support"), F.col("n").alias("claimed"),
                      F.lit(0).alias("hits")))
    per = sides.groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hits").alias("hits")
    )
    accuracy = matrix.agg(F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).scalar()
    return per.select(
        "label",
        "support",
        F.try_divide("hits", "claimed").alias("precision"),
        F.try_divide("hits", "support").alias("recall"),
        F.try_divide(F.lit(2) * F.col("hits"), F.col("support") + F.col("claimed")).alias("f1"),
        accuracy.alias("accuracy"),
    )
