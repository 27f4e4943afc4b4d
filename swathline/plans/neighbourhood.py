"""Focal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.functions.numeric import snap, snap_sql
from swathline.operators import focal
from swathline.plans.fragments import sql
from swathline.plans.registry import query
from swathline.sources import fixtures

TILE = fixtures.TILE


def _window_sql(columns: str, table: str, dy: tuple[int, int], dx: tuple[int, int]) -> str:
    """Sums over the present neighbours of every pixel, by equi join on offsets."""
    return f"""SELECT a.y, a.x, {columns}, count(*) AS n
      FROM {table} a CROSS JOIN (SELECT unnest(range({dy[0]}, {dy[1] + 1})) AS dy) oy
      CROSS JOIN (SELECT unnest(range({dx[0]}, {dx[1] + 1})) AS dx) ox
      JOIN {table} b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.y, a.x"""


@query(
    "boxcar",
    sql(f"SELECT y, x, {snap_sql('s/n', 5)} AS mean, n FROM ({_window_sql('sum(b.pre) AS s', 'px', (-5, 4), (-5, 4))}) w", "px"),
)
def boxcar(spark, folder):
    smooth = focal.boxcar(fixtures.pre_raster(spark, folder), "value", 10, TILE)
    return smooth.select("y", "x", snap(F.col("mean"), 5).alias("mean"), "n")


_LEE = _window_sql("any_value(a.pre) AS v, sum(b.pre) AS s1, sum(b.pre*b.pre) AS s2", "px", (-1, 1), (-1, 1))


@query(
    "lee_filter",
    sql(
        f"""SELECT y, x, {snap_sql('m + least(greatest(coalesce((q - m*m*0.25::DOUBLE)/nullif(q*1.25::DOUBLE, 0), 0), 0), 1)*(v - m)', 4)} AS filtered, n
            FROM (SELECT y, x, v, n, s1/n AS m, greatest(s2/n - (s1/n)*(s1/n), 0) AS q FROM ({_LEE}) w) u""",
        "px",
    ),
)
def lee_filter(spark, folder):
    """3x3 Lee filter for four looks."""
    smooth = focal.lee_filter(fixtures.pre_raster(spark, folder), enl=4.0, tile=TILE)
    return smooth.select("y", "x", snap(F.col("filtered"), 4).alias("filtered"), "n")


@query(
    "interferogram",
    sql(
        f"""SELECT y, x, {snap_sql('CASE WHEN a1 <> 0 THEN atan2(im/n, re/n) END', 4)} AS phase
            FROM ({_window_sql('any_value(a.a1) AS a1, sum(b.re) AS re, sum(b.im) AS im', 'cpx', (-5, 4), (-5, 4))}) w""",
        "cpx",
    ),
)
def interferogram(spark, folder):
    phases = focal.interferogram(fixtures.complex_pair(spark, folder), 10, TILE)
    return phases.select("y", "x", snap(F.col("phase"), 4).alias("phase"))


@query(
    "coherence",
    sql(
        f"""SELECT y, x, {snap_sql('sqrt(re*re + im*im)/nullif(sqrt(e1*e2), 0)', 5)} AS coherence, n
            FROM ({_window_sql('sum(b.re) AS re, sum(b.im) AS im, sum(b.e1) AS e1, sum(b.e2) AS e2', 'cpx', (-1, 1), (-5, 4))}) w""",
        "cpx",
    ),
)
def coherence(spark, folder):
    got = focal.coherence(fixtures.complex_pair(spark, folder), 3, 10, TILE)
    return got.select("y", "x", snap(F.col("coherence"), 5).alias("coherence"), "n")
