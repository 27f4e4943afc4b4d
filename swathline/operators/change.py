"""Before/after change detection: fixed threshold, raster algebra, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions.radiometry import below, change_db
from swathline.functions.ranking import running_totals
from swathline.functions.tiling import tile_bounds, tile_id, with_tile_box
from swathline.schema import DEFAULT_TILE, FLOOD_THRESHOLD_DB, Header

KEYS = ("y", "x")


def align(pre: DataFrame, post: DataFrame, keys: tuple[str, ...] = KEYS, how: str = "full") -> DataFrame:
    """Pair two rasters cell by cell: one hash exchange per side, none if both are
    already partitioned by the cell."""
    left = pre.select(*keys, F.col("value").alias("pre"))
    right = post.select(*keys, F.col("value").alias("post"))
    return left.join(right, list(keys), how)


def with_change(pairs: DataFrame, threshold: float = FLOOD_THRESHOLD_DB) -> DataFrame:
    diff = change_db(F.col("pre"), F.col("post"))
    return pairs.withColumn("diff_db", diff).withColumn("mask", below(F.col("diff_db"), threshold))


def flood_tiles(
    pre: DataFrame,
    post: DataFrame,
    head: Header,
    tile: int = DEFAULT_TILE,
    threshold: float = FLOOD_THRESHOLD_DB,
    grid: DataFrame | None = None,
) -> DataFrame:
    """One result row per tile: state, flooded pixels, shape and bounds.

    Pixels are reduced to tile partials before the tile exchange. ``grid`` (tile_id)
    adds the tiles in which the reference raster has no pixel at all.
    """
    pairs = with_change(align(pre, post), threshold)
    stats = (
        pairs.withColumn("tile_id", tile_id(F.col("y"), F.col("x"), head.width, tile))
        .groupBy("tile_id")
        .agg(
            F.count("pre").alias("n_pre"),
            F.count("post").alias("n_post"),
            F.count(F.when(F.col("pre").isNotNull(), F.col("post"))).alias("n_both"),
            F.max("pre").alias("max_pre"),
            F.sum("mask").alias("hits"),
        )
    )
    # As many pixels on both sides, but not the same ones, is a mismatch too.
    moved = (F.col("n_pre") == F.col("n_post")) & (F.col("n_both") != F.col("n_pre"))
    stats = stats.withColumn("n_post", F.when(moved, F.lit(-1)).otherwise(F.col("n_post"))).drop("n_both")
    if grid is not None:
        stats = grid.select("tile_id").join(stats, "tile_id", "left")
    return _report(stats, head, tile)


def flood_tiles_chunked(
    pre: DataFrame,
    post: DataFrame,
    head: Header,
    tile: int = DEFAULT_TILE,
    threshold: float = FLOOD_THRESHOLD_DB,
) -> DataFrame:
    """The same report from chunk tables (tile_id, cells): one row per tile and raster is
    joined instead of every pixel, and cells are compared position by position."""
    a, b = F.col("a"), F.col("b")
    both = pre.select("tile_id", F.col("cells").alias("a")).join(
        post.select("tile_id", F.col("cells").alias("b")), "tile_id", "full"
    )
    moved = F.exists(F.zip_with(a, b, lambda p, q: (p.y != q.y) | (p.x != q.x)), lambda m: m)
    marks = F.zip_with(a, b, lambda p, q: below(change_db(p.value, q.value), threshold))
    n_pre, n_post = F.coalesce(F.size(a), F.lit(0)), F.coalesce(F.size(b), F.lit(0))
    unlike = (n_pre != n_post) | moved
    stats = both.select(
        "tile_id",
        n_pre.alias("n_pre"),
        F.when(unlike, F.lit(-1)).otherwise(n_post).alias("n_post"),
        F.array_max(F.transform(a, lambda p: p.value)).alias("max_pre"),
        F.when(~unlike, F.aggregate(marks, F.lit(0), lambda n, m: n + m)).alias("hits"),
    )
    return _report(stats, head, tile)


def tile_state(n_pre: Column, n_post: Column, max_pre: Column) -> Column:
    return (
        F.when(F.coalesce(n_pre, F.lit(0)) == 0, "EMPTY_TILE")
        .when(n_pre != n_post, "ERROR : shape mismatch")
        .when(max_pre <= 0, "EMPTY_LAND")
        .otherwise("SUCCESS")
    )


def _report(stats: DataFrame, head: Header, tile: int) -> DataFrame:
    height = head.height if isinstance(head.height, Column) else F.lit(head.height)
    good = F.col("status") == "SUCCESS"
    boxed = with_tile_box(
        stats.withColumn("status", tile_state(F.col("n_pre"), F.col("n_post"), F.col("max_pre"))), head, tile
    )
    bounds = {name: F.when(good, col) for name, col in tile_bounds(head).items()}
    return boxed.select(
        "tile_id",
        F.when(good, F.col("hits")).otherwise(F.lit(0)).cast("bigint").alias("pixel_count"),
        "status",
        F.format_string("(%d, %d)", height, F.lit(head.width)).alias("raster_shape"),
        F.format_string("(%d, %d)", F.col("h"), F.col("w")).alias("tile_shape"),
        *[col.alias(name) for name, col in bounds.items()],
    )


def flood_total(tiles: DataFrame) -> DataFrame:
    return tiles.agg(F.sum("pixel_count").alias("flooded_pixels"), F.count("*").alias("tiles"))


def map_algebra(b0: DataFrame, b1: DataFrame, expression: str, name: str = "value") -> DataFrame:
    """Evaluate a SQL expression over two aligned rasters named b0 and b1."""
    pairs = align(b0, b1, how="inner").withColumnsRenamed({"pre": "b0", "post": "b1"})
    return pairs.select("y", "x", F.expr(expression).alias(name))


def compare(base: DataFrame, other: DataFrame, keys: tuple[str, ...] = ("band", "y", "x"), eps: float = 1e-9) -> DataFrame:
    """Per band: range of both outputs, largest and root-mean-square difference, mismatches, and pixels that only one has.

    A value against NULL or NaN is a mismatch, two NULLs or two NaNs aren't; neither enters the ranges and differences.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        held = F.struct(F.when(~F.isnan("value"), F.col("value")).alias("v"), F.col("value").alias("raw"))
        return df.select(*keys, held.alias(name))

    pairs = side(base, "_a").join(side(other, "_b"), list(keys), "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    pairs = pairs.select(
        "band",
        *[F.when(both, F.col(c)).alias(n) for c, n in (("_a.v", "pre"), ("_b.v", "post"))],
        (both & F.col("_a.v").isNull() & F.col("_b.v").isNull() & F.col("_a.raw").eqNullSafe(F.col("_b.raw"))).alias("void"),
        both.alias("both"), F.col("_a").isNotNull().alias("in_base"), F.col("_b").isNotNull().alias("in_other"),
    ).withColumn("d", F.col("post") - F.col("pre"))
    unlike = F.col("both") & ~F.col("void") & F.coalesce(F.abs("d") > eps, F.lit(True))
    return pairs.groupBy("band").agg(
        F.count_if("both").alias("n"),
        F.count_if(F.col("in_base") & ~F.col("in_other")).alias("only_base"),
        F.count_if(F.col("in_other") & ~F.col("in_base")).alias("only_other"),
        F.min("pre").alias("base_min"),
        F.max("pre").alias("base_max"),
        F.min("post").alias("other_min"),
        F.max("post").alias("other_max"),
        F.max(F.abs("d")).alias("max_abs_diff"),
        F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"),
        F.count_if(unlike).alias("mismatched"),
    )


def common_extent(raster: DataFrame, height, width) -> DataFrame:
    """Crop to the top-left extent shared with another raster."""
    return raster.filter((F.col("y") < height) & (F.col("x") < width))


def ks_two_sample(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance from exact empirical distributions, without NULL and NaN."""
    both = first.select(F.col("value").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        second.select(F.col("value").alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    counted = both.filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ranked = running_totals(counted, "v", ["a", "b"])
    gap = F.abs(
        (F.col("a_before") + F.col("a")) / F.col("a_total") - (F.col("b_before") + F.col("b")) / F.col("b_total")
    )
    return ranked.agg(
        F.max(gap).alias("ks"), F.max("a_total").alias("n_first"), F.max("b_total").alias("n_second")
    )
