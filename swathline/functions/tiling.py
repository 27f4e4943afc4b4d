"""Tile keys and bounds by arithmetic; no list of tiles is ever built on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.functions.geo import pixel_x, pixel_y, project_bounds
from swathline.functions.numeric import intdiv
from swathline.schema import Header


def tiles_across(width: int, tile: int) -> int:
    return -(-width // tile)


def tile_id(y: Column, x: Column, width: int, tile: int) -> Column:
    return intdiv(y, tile) * tiles_across(width, tile) + intdiv(x, tile)


def tile_origin(tid: Column, width: int, tile: int) -> tuple[Column, Column]:
    across = tiles_across(width, tile)
    return intdiv(tid, across) * tile, (tid % across) * tile


def with_tile_box(df: DataFrame, head: Header, tile: int) -> DataFrame:
    """Adds y0, x0, h, w of each tile, clipped at the raster edge."""
    y0, x0 = tile_origin(F.col("tile_id"), head.width, tile)
    height = head.height if isinstance(head.height, Column) else F.lit(head.height)
    return df.withColumns({"y0": y0, "x0": x0}).withColumns(
        {
            "h": F.least(F.lit(tile).cast("bigint"), height - F.col("y0")),
            "w": F.least(F.lit(tile).cast("bigint"), F.lit(head.width) - F.col("x0")),
        }
    )


def tile_bounds(head: Header) -> dict[str, Column]:
    """Lon/lat bounds of a tile from its box columns."""
    a = head.affine
    x0, x1 = F.col("x0"), F.col("x0") + F.col("w")
    y0, y1 = F.col("y0"), F.col("y0") + F.col("h")
    left, right = pixel_x(x0, a, 0.0), pixel_x(x1, a, 0.0)
    first, last = pixel_y(y0, a, 0.0), pixel_y(y1, a, 0.0)
    south, north = (last, first) if a.e < 0 else (first, last)
    west, south, east, north = project_bounds(head.crs, left, south, right, north)
    return {"min_lon": west, "min_lat": south, "max_lon": east, "max_lat": north}


def tile_grid(spark: SparkSession, height: int, width: int, tile: int) -> DataFrame:
    """All tiles of a raster, row-major, from its metadata."""
    n = tiles_across(height, tile) * tiles_across(width, tile)
    head = Header(width=width, height=height, affine=None)
    return with_tile_box(spark.range(n).select(F.col("id").alias("tile_id")), head, tile)
