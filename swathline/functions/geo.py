"""Coordinates, projections, WKT and planar predicates as column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathline.schema import Affine

# Spherical Mercator radius, WGS 84 ellipsoid, UTM scale.
MERCATOR_R = 6378137.0
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_E0 = 500000.0

_N = WGS84_F / (2 - WGS84_F)
_RECT = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Third-order series of the transverse Mercator projection (Krueger 1912).
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_ECC = 2 * math.sqrt(_N) / (1 + _N)


def pixel_x(x: Column, affine: Affine, shift: float = 0.5) -> Column:
    return F.lit(affine.x0) + (x + F.lit(shift)) * F.lit(affine.a)


def pixel_y(y: Column, affine: Affine, shift: float = 0.5) -> Column:
    return F.lit(affine.y0) + (y + F.lit(shift)) * F.lit(affine.e)


def mercator_to_lonlat(mx: Column, my: Column) -> tuple[Column, Column]:
    lon = F.degrees(mx / F.lit(MERCATOR_R))
    lat = F.degrees(2 * F.atan(F.exp(my / F.lit(MERCATOR_R))) - F.lit(math.pi / 2))
    return lon, lat


def lonlat_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    mx = F.radians(lon) * F.lit(MERCATOR_R)
    my = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * F.lit(MERCATOR_R)
    return mx, my


def utm_central_meridian(zone: int) -> float:
    return zone * 6 - 183.0


def lonlat_to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing on the northern half of a UTM zone."""
    phi = F.radians(lat)
    lam = F.radians(lon - F.lit(utm_central_meridian(zone)))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, coef in enumerate(_ALPHA, start=1):
        east = east + F.lit(coef) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(coef) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    scale = UTM_K0 * _RECT
    return F.lit(UTM_E0) + F.lit(scale) * east, F.lit(scale) * north


def utm_to_lonlat(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    scale = UTM_K0 * _RECT
    xi = north / F.lit(scale)
    eta = (east - F.lit(UTM_E0)) / F.lit(scale)
    xi2, eta2 = xi, eta
    for j, coef in enumerate(_BETA, start=1):
        xi2 = xi2 - F.lit(coef) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta2 = eta2 - F.lit(coef) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi2) / F.cosh(eta2))
    phi = chi
    for j, coef in enumerate(_DELTA, start=1):
        phi = phi + F.lit(coef) * F.sin(2 * j * chi)
    lam = F.atan2(F.sinh(eta2), F.cos(xi2))
    return F.lit(utm_central_meridian(zone)) + F.degrees(lam), F.degrees(phi)


def project_bounds(crs: str, west: Column, south: Column, east: Column, north: Column) -> list[Column]:
    """Bounds in ``crs`` to lon/lat. Axis-aligned bounds stay so for the supported systems."""
    if crs == "EPSG:4326":
        return [west, south, east, north]
    if crs == "EPSG:3857":
        w, s = mercator_to_lonlat(west, south)
        e, n = mercator_to_lonlat(east, north)
        return [w, s, e, n]
    if crs.startswith("EPSG:326") and crs[8:].isdigit():
        zone = int(crs[8:])
        corners = [utm_to_lonlat(x, y, zone) for x in (west, east) for y in (south, north)]
        lons, lats = [c[0] for c in corners], [c[1] for c in corners]
        return [F.least(*lons), F.least(*lats), F.greatest(*lons), F.greatest(*lats)]
    raise ValueError(f"no projection for {crs}")


def wkt_kind(wkt: Column) -> Column:
    return F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))


def wkt_points(wkt: Column) -> Column:
    """All coordinate pairs of a geometry, in order and whatever ring they stand in: array<struct<x,y>>."""
    pairs = F.regexp_extract_all(wkt, F.lit(r"([-+0-9.eE]+\s+[-+0-9.eE]+)"), F.lit(1))
    return F.transform(
        pairs,
        lambda p: F.struct(
            F.split(p, r"\s+").getItem(0).cast("double").alias("x"),
            F.split(p, r"\s+").getItem(1).cast("double").alias("y"),
        ),
    )


def wkt_rings(wkt: Column) -> Column:
    """The rings of a polygon or multipolygon, holes and all parts: array<array<struct<x,y>>>."""
    return F.transform(F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1)), wkt_points)


def box_wkt(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    def pt(x, y):
        return F.concat_ws(" ", x.cast("string"), y.cast("string"))

    ring = F.concat_ws(", ", pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0))
    return F.concat(F.lit("POLYGON(("), ring, F.lit("))"))


def ring_bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return F.struct(
        F.array_min(xs).alias("x0"),
        F.array_min(ys).alias("y0"),
        F.array_max(xs).alias("x1"),
        F.array_max(ys).alias("y1"),
    )


def ring_edges(ring: Column) -> Column:
    """Pairs of consecutive ring points; worth computing once per polygon, before a join."""
    n = F.size(ring)
    return F.zip_with(
        F.slice(ring, F.lit(1), n - 1),
        F.slice(ring, F.lit(2), n - 1),
        lambda p, q: F.struct(p.x.alias("ax"), p.y.alias("ay"), q.x.alias("bx"), q.y.alias("by")),
    )


def rings_edges(rings: Column) -> Column:
    """Edges of all rings. Under the even-odd rule holes take away and parts add."""
    return F.flatten(F.transform(rings, ring_edges))


def on_ring(px: Column, py: Column, edges: Column) -> Column:
    def touches(s):
        cross = (s.bx - s.ax) * (py - s.ay) - (s.by - s.ay) * (px - s.ax)
        return (
            (cross == 0)
            & (px >= F.least(s.ax, s.bx))
            & (px <= F.greatest(s.ax, s.bx))
            & (py >= F.least(s.ay, s.by))
            & (py <= F.greatest(s.ay, s.by))
        )

    return F.exists(edges, touches)


def crosses_odd(px: Column, py: Column, edges: Column) -> Column:
    """Even-odd rule: does a ray to the right cross the ring an odd number of times."""

    def hit(s):
        straddles = (s.ay > py) != (s.by > py)
        at = s.ax + F.try_divide((py - s.ay) * (s.bx - s.ax), s.by - s.ay)
        return F.coalesce(straddles & (px < at), F.lit(False))

    return F.size(F.filter(edges, hit)) % 2 == 1


def strictly_inside(px: Column, py: Column, edges: Column) -> Column:
    return crosses_odd(px, py, edges) & ~on_ring(px, py, edges)


def inside_or_on(px: Column, py: Column, edges: Column) -> Column:
    return crosses_odd(px, py, edges) | on_ring(px, py, edges)


def parse_rings(wkt: str) -> list[list[tuple[float, float]]]:
    """Rings of a polygon or multipolygon given as a parameter, not as data."""
    bodies = re.findall(r"\(([^()]+)\)", wkt)
    return [[tuple(float(n) for n in pair.split()) for pair in body.split(",")] for body in bodies]


def inside_fixed_rings(px: Column, py: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Strict containment in rings known when the plan is built, even-odd over all of them, as plain arithmetic."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in (edge for ring in rings for edge in zip(ring, ring[1:])):
        inside_box = px.between(min(ax, bx), max(ax, bx)) & py.between(min(ay, by), max(ay, by))
        on_edge = on_edge | (inside_box & ((px - ax) * (by - ay) == (py - ay) * (bx - ax)))
        if ay != by:
            at = F.lit(ax) + (py - F.lit(ay)) * F.lit(bx - ax) / F.lit(by - ay)
            hit = ((F.lit(ay) > py) != (F.lit(by) > py)) & (px < at)
            crossings = crossings + hit.cast("int")
    return ~on_edge & (crossings % 2 == 1)


def boxes_touch(a, b) -> Column:
    """Closed-box overlap of two bbox structs."""
    return (a.x0 <= b.x1) & (b.x0 <= a.x1) & (a.y0 <= b.y1) & (b.y0 <= a.y1)
