"""Raster scans, chunk tables and raster sinks.

A raster is stored as a pixel table or as a chunk table with one array payload
per tile. Both are Parquet, clustered by tile, so windows prune row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.functions.geo import pixel_x, pixel_y
from swathline.functions.numeric import intdiv
from swathline.functions.tiling import tile_id, tile_origin, tiles_across
from swathline.schema import Affine


def window_scan(pixels: DataFrame, y0: int, x0: int, h: int, w: int) -> DataFrame:
    """Pixels of one window; plain comparisons, so they reach the Parquet scan."""
    y, x = F.col("y"), F.col("x")
    return pixels.filter((y >= y0) & (y < y0 + h) & (x >= x0) & (x < x0 + w))


def coordinate_window(pixels: DataFrame, affine: Affine, west, east, north, south) -> DataFrame:
    """Pixels whose centre lies in the closed coordinate window."""
    lon, lat = pixel_x(F.col("x"), affine), pixel_y(F.col("y"), affine)
    return pixels.withColumns({"lon": lon, "lat": lat}).filter(
        F.col("lon").between(west, east) & F.col("lat").between(south, north)
    )


def rechunk(pixels: DataFrame, tile: int, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Pixel table to chunk table. A chunk holds at most tile*tile cells."""
    return (
        pixels.withColumn("tile_id", tile_id(F.col("y"), F.col("x"), width, tile))
        .groupBy(*by, "tile_id")
        .agg(F.sort_array(F.collect_list(F.struct("y", "x", "value"))).alias("cells"))
    )


def store_chunks(chunks: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """A chunk table bucketed by tile: rasters stored with equal bucket counts are joined
    by tile without any exchange. A chunk holds a whole tile, so buckets stay even."""
    writer = chunks.write.bucketBy(buckets, "tile_id").sortBy("tile_id").mode("overwrite")
    writer.option("path", path).saveAsTable(name)
    return chunks.sparkSession.table(name)


def unchunk(chunks: DataFrame) -> DataFrame:
    keep = [c for c in chunks.columns if c != "cells"]
    return chunks.select(*keep, F.inline("cells"))


def chunk_slice(chunks: DataFrame, tile: int, width: int, y0: int, x0: int, h: int, w: int) -> DataFrame:
    """Read a window from a chunk table: prune chunks by key first, then cut cells."""
    ty, tx = tile_origin(F.col("tile_id"), width, tile)
    rows = range(y0 // tile, (y0 + h - 1) // tile + 1)
    across = tiles_across(width, tile)
    low, high = rows[0] * across, rows[-1] * across + across - 1
    hit = chunks.filter(
        F.col("tile_id").between(low, high)
        & (ty < y0 + h)
        & (ty + tile > y0)
        & (tx < x0 + w)
        & (tx + tile > x0)
    )
    return window_scan(unchunk(hit), y0, x0, h, w)


def lookup_pixels(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """Value under each point; points off the data keep a NULL value."""
    return points.join(pixels, ["y", "x"], "left")


def lookup_chunked(points: DataFrame, chunks: DataFrame, tile: int, width: int) -> DataFrame:
    """Point lookup that opens each needed chunk once, however many points it holds."""
    keyed = points.withColumn("tile_id", tile_id(F.col("y"), F.col("x"), width, tile))
    needed = keyed.select("tile_id").distinct()
    cells = unchunk(chunks.join(needed, "tile_id", "left_semi"))
    return keyed.join(cells, ["tile_id", "y", "x"], "left")


def window_stats(windows: DataFrame, pixels: DataFrame, size: int) -> DataFrame:
    """Count and sum per window; a window without pixels has count 0 and no sum. Windows meet pixels on cells of the window size,
    so a window touches at most four cells and each pixel meets only near windows."""
    cells = windows.withColumn("cy", F.explode(F.sequence(intdiv("y0", size), intdiv(F.col("y0") + size - 1, size))))
    cells = cells.withColumn("cx", F.explode(F.sequence(intdiv("x0", size), intdiv(F.col("x0") + size - 1, size))))
    keyed = pixels.withColumns({"cy": intdiv("y", size), "cx": intdiv("x", size)})
    inside = (
        (F.col("y") >= F.col("y0"))
        & (F.col("y") < F.col("y0") + size)
        & (F.col("x") >= F.col("x0"))
        & (F.col("x") < F.col("x0") + size)
    )
    held = cells.join(keyed, ["cy", "cx"]).filter(inside).groupBy("window_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return windows.select("window_id").join(held, "window_id", "left").select("window_id", F.coalesce("n", F.lit(0)).alias("n"), "total")


def write_tiles(df: DataFrame, path: str, partition_by: list[str], sort_by: list[str]) -> None:
    """Clustered Parquet. The rebalance hint lets adaptive execution merge small
    partition values and split large ones into as many tasks as their size asks for."""
    (
        df.hint("rebalance", *partition_by)
        .sortWithinPartitions(*partition_by, *sort_by)
        .write.mode("overwrite")
        .partitionBy(*partition_by)
        .parquet(path)
    )


STRIP_TILES = 16


def store_raster(pixels: DataFrame, path: str, tile: int) -> None:
    """A raster (band, y, x, value) as Parquet, partitioned by band and strip of tile
    rows, sorted by tile, so that windows prune folders first and row groups second."""
    keyed = pixels.withColumns(
        {"strip": intdiv("y", tile * STRIP_TILES), "tile_y": intdiv("y", tile), "tile_x": intdiv("x", tile)}
    )
    write_tiles(keyed, path, ["band", "strip"], ["tile_y", "tile_x", "y", "x"])


def read_window(stored: DataFrame, tile: int, band: int, y0: int, x0: int, h: int, w: int) -> DataFrame:
    """One window of one band of a stored raster; every condition is pushed to the scan."""
    last_y, last_x = y0 + h - 1, x0 + w - 1
    size = tile * STRIP_TILES
    near = stored.filter(
        (F.col("band") == band)
        & F.col("strip").between(y0 // size, last_y // size)
        & F.col("tile_y").between(y0 // tile, last_y // tile)
        & F.col("tile_x").between(x0 // tile, last_x // tile)
    )
    return window_scan(near, y0, x0, h, w)


def explode_tiles(pixels: DataFrame, tile: int, width: int) -> DataFrame:
    """Tile id plus the pixel position inside its tile."""
    y0, x0 = tile_origin(F.col("tile_id"), width, tile)
    return pixels.withColumn("tile_id", tile_id(F.col("y"), F.col("x"), width, tile)).select(
        "tile_id", (F.col("y") - y0).alias("ty"), (F.col("x") - x0).alias("tx"), "value"
    )


def overview(pixels: DataFrame, factor: int) -> DataFrame:
    return pixels.groupBy(intdiv("y", factor).alias("y"), intdiv("x", factor).alias("x")).agg(
        F.avg("value").alias("value"), F.count("value").alias("n")
    )


def flip_north_up(pixels: DataFrame, height) -> DataFrame:
    """Rows of a south-up raster in north-up order."""
    return pixels.withColumn("y", height - 1 - F.col("y"))


def flipped_affine(affine: Affine, height: int) -> Affine:
    return Affine(affine.x0, affine.a, affine.y0 + affine.e * height, -affine.e) if affine.e > 0 else affine


def mosaic_first(rasters: list[DataFrame], nodata: float = 0.0) -> DataFrame:
    """First raster in list order with a valid pixel wins; a map-side combined aggregate."""
    stacked = None
    for rank, raster in enumerate(rasters):
        part = raster.select("y", "x", "value", F.lit(rank).alias("rank"))
        stacked = part if stacked is None else stacked.unionByName(part)
    valid = stacked.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != nodata))
    return valid.groupBy("y", "x").agg(F.min_by("value", "rank").alias("value"), F.min("rank").alias("source"))
