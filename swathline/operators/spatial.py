"""Spatial joins: grid cells turn geometric conditions into equi joins.

Hot cells are salted: the point side is split by a hash of its id and the much
smaller polygon side is repeated once per salt, so no cell is joined by one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions.geo import (
    boxes_touch,
    inside_fixed_rings,
    inside_or_on,
    parse_rings,
    pixel_x,
    pixel_y,
    ring_bbox,
    rings_edges,
    strictly_inside,
    wkt_points,
    wkt_rings,
)
from swathline.functions.numeric import intdiv
from swathline.schema import Affine

SALTS = 8


def parse_polygons(df: DataFrame, wkt: str = "wkt") -> DataFrame:
    """Adds the points in order (ring), the rings, holes and parts among them (rings), and the box."""
    parsed = df.withColumns({"ring": wkt_points(F.col(wkt)), "rings": wkt_rings(F.col(wkt))})
    return parsed.withColumn("box", ring_bbox(F.col("ring")))


def _covering_cells(df: DataFrame, box: Column, cell: float) -> DataFrame:
    rows = F.sequence(intdiv(box.y0, cell), intdiv(box.y1, cell))
    cols = F.sequence(intdiv(box.x0, cell), intdiv(box.x1, cell))
    return df.withColumn("cy", F.explode(rows)).withColumn("cx", F.explode(cols))


def points_in_polygons(
    points: DataFrame, polygons: DataFrame, predicate: str = "within", cell: float = 10.0, salts: int = SALTS
) -> DataFrame:
    """Join points (point_id, px, py) with polygons (zone_id, rings, box).

    ``within`` and ``contains`` exclude the boundary, that of holes too, ``intersects`` includes it. A
    point has one cell and one salt, so every pair is produced once.
    """
    tests = {"within": strictly_inside, "contains": strictly_inside, "intersects": inside_or_on}
    test = tests[predicate]
    left = points.withColumns(
        {
            "cy": intdiv("py", cell),
            "cx": intdiv("px", cell),
            "salt": F.pmod(F.xxhash64("point_id"), F.lit(salts)).cast("int"),
        }
    )
    right = polygons.withColumn("edges", rings_edges(F.col("rings")))
    right = _covering_cells(right, F.col("box"), cell).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    box = F.col("box")
    # The box test is cheap and drops most candidates before the ring is walked.
    near = F.col("px").between(box.x0, box.x1) & F.col("py").between(box.y0, box.y1)
    hit = test(F.col("px"), F.col("py"), F.col("edges"))
    return left.join(right, ["cy", "cx", "salt"]).filter(near & hit).drop("cy", "cx", "salt", "edges")


def boxes_intersecting(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of touching boxes: (left_id, box) with (right_id, box).

    A pair meeting in several cells is reported only in the cell that holds the lower
    corner of the overlap, so no de-duplication shuffle is needed.
    """
    a = _covering_cells(left.select("left_id", F.col("box").alias("abox")), F.col("abox"), cell)
    b = _covering_cells(right.select("right_id", F.col("box").alias("bbox")), F.col("bbox"), cell)
    abox, bbox = F.col("abox"), F.col("bbox")
    home_x = intdiv(F.greatest(abox.x0, bbox.x0), cell) == F.col("cx")
    home_y = intdiv(F.greatest(abox.y0, bbox.y0), cell) == F.col("cy")
    return a.join(b, ["cy", "cx"]).filter(boxes_touch(abox, bbox) & home_x & home_y).select("left_id", "right_id")


def footprint_lookup(points: DataFrame, footprints: DataFrame, cell: float) -> DataFrame:
    """Footprints (left_id, box) whose closed box holds the point."""
    boxes = _covering_cells(footprints, F.col("box"), cell).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*points.columns), F.lit(SALTS)).cast("int")
    keyed = points.withColumns({"cy": intdiv("py", cell), "cx": intdiv("px", cell), "salt": salt})
    box = F.col("box")
    inside = F.col("px").between(box.x0, box.x1) & F.col("py").between(box.y0, box.y1)
    return keyed.join(boxes, ["cy", "cx", "salt"]).filter(inside).drop("cy", "cx", "salt", "box")


def clip_to_region(pixels: DataFrame, wkt: str, affine: Affine) -> DataFrame:
    """Pixels whose centre lies inside an AOI polygon.

    The polygon's box becomes a pixel window that prunes the scan; the exact test follows.
    """
    rings = parse_rings(wkt)
    xs = sorted((lon - affine.x0) / affine.a - 0.5 for ring in rings for lon, _ in ring)
    ys = sorted((lat - affine.y0) / affine.e - 0.5 for ring in rings for _, lat in ring)
    near = pixels.filter(
        F.col("x").between(math.floor(xs[0]), math.ceil(xs[-1]))
        & F.col("y").between(math.floor(ys[0]), math.ceil(ys[-1]))
    )
    lon, lat = pixel_x(F.col("x"), affine), pixel_y(F.col("y"), affine)
    return near.filter(inside_fixed_rings(lon, lat, rings))


def zone_stats(pixels: DataFrame, polygons: DataFrame, cell: float = 10.0) -> DataFrame:
    """Flooded and total pixels per zone from (px, py, mask) pixels; a zone layer under
    the broadcast threshold joins without moving the pixels. A zone without pixels reports 0."""
    keyed = pixels.withColumn("point_id", F.xxhash64("px", "py"))
    joined = points_in_polygons(keyed, polygons, "within", cell)
    counted = joined.groupBy("zone_id").agg(F.count("*").alias("pixels"), F.sum("mask").alias("flooded"))
    found = polygons.select("zone_id").distinct().join(counted, "zone_id", "left")
    return found.fillna(0, ["pixels", "flooded"])
