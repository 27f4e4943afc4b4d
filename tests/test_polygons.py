"""Rings, shells, holes and geometry from tiles against brute force on small rasters."""

import json
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_vectorize import RING_WITH_HOLES, SPIRAL, WIDTH, flood_fill, holes_of, mask_frame, random_mask

from swathline.operators import polygons, vectorize
from swathline.schema import Affine

CASES = [(random_mask(1, 0.6), 5), (random_mask(2, 0.5), 3), (SPIRAL, 4), (RING_WITH_HOLES, 3), (SPIRAL, 64), ({(3, 3), (4, 4)}, 2)]


def inside(loop, y, x):
    """Parity of the crossings left of a cell's centre."""
    hits = 0
    for (ay, ax), (by, bx) in zip(loop, loop[1:] + loop[:1]):
        if ax == bx and min(ay, by) <= y < max(ay, by) and ax <= x:
            hits += 1
    return hits % 2 == 1


@pytest.mark.parametrize("cells,tile", CASES)
def test_rings_against_flood_fill(spark, cells, tile, monkeypatch):
    monkeypatch.setattr(polygons, "SPAN", 2)
    want = flood_fill(cells)
    chains = polygons.trace(mask_frame(spark, cells), WIDTH, tile).cache()
    table = {r.ring: r for r in polygons.rings(chains).collect()}
    regions = defaultdict(set)
    for cell, label in want.items():
        regions[label].add(cell)
    assert {r.component for r in table.values()} == set(regions)
    around = defaultdict(list)
    for v in polygons.vertices(chains).collect():
        around[v.ring].append((v.seq, v.vy, v.vx))
    loops = {ring: [p[1:] for p in sorted(line)] for ring, line in around.items()}
    for label, own in regions.items():
        of = [r for r in table.values() if r.component == label]
        (shell,) = [r for r in of if not r.hole]
        assert sum(r.area for r in of) == len(own) and len(of) - 1 == holes_of(own)
        assert all(r.shell == shell.ring for r in of)
        assert sum(r.length for r in of) == sum((y + dy, x + dx) not in own for y, x in own for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        for y in range(20):
            for x in range(WIDTH):
                assert (sum(inside(loops[r.ring], y, x) for r in of) % 2 == 1) == ((y, x) in own)
        assert all(len(loops[r.ring]) == r.corners for r in of)
    old = vectorize.ring_summary(vectorize.trace_rings(vectorize.connected_components(mask_frame(spark, cells), WIDTH, tile), WIDTH))
    assert {r.component: (r.rings, r.holes, r.perimeter) for r in old.collect()} == {
        label: (len(of), sum(r.hole for r in of), sum(r.length for r in of))
        for label in regions for of in [[r for r in table.values() if r.component == label]]
    }


def parsed(wkt):
    return [
        [tuple(float(v) for v in p.split()) for p in ring.split(",")] for ring in re.findall(r"\(([^()]*)\)", wkt)
    ]


@pytest.mark.parametrize("cells,tile", CASES)
def test_geometry_is_valid_and_covers_the_cells(spark, cells, tile):
    affine = Affine(x0=100.0, a=0.5, y0=50.0, e=-0.25)
    found = polygons.geometry(polygons.trace(mask_frame(spark, cells), WIDTH, tile), affine).collect()
    want = flood_fill(cells)
    assert {r.component for r in found} == set(want.values())
    for r in found:
        own = {c for c, label in want.items() if label == r.component}
        rings = parsed(r.wkt)
        assert [[list(p) for p in ring] for ring in rings] == json.loads(r.geojson)["coordinates"]
        assert r.shells == 1 and r.holes == len(rings) - 1
        edges = set()
        for ring in rings:
            assert ring[0] == ring[-1] and len(set(ring)) == len(ring) - 1 >= 4
            edges |= {frozenset(e) for e in zip(ring, ring[1:])}
        assert len(edges) == sum(len(ring) - 1 for ring in rings)
        loops = [[(round((y - 50) / -0.25), round((x - 100) / 0.5)) for x, y in ring[:-1]] for ring in rings]
        for y in range(20):
            for x in range(WIDTH):
                assert inside(loops[0], y, x) - sum(inside(h, y, x) for h in loops[1:]) == ((y, x) in own)


def test_classes_nulls_repeats_and_empty(spark):
    rows = [(y, x, (y // 3 + x // 4) % 2) for y in range(9) for x in range(12)]
    rows += [(0, 0, 5), (None, 1, 1), (1, None, 1), (20, 20, None)]
    frame = spark.createDataFrame(rows, "y int, x int, kind int").withColumns({c: F.lit(9) for c in ("label", "ring", "ty", "gy")})
    table = polygons.rings(polygons.trace(frame, WIDTH, 4, "kind")).collect()
    assert len(table) == 9 and all(r.area == 12 and not r.hole for r in table)
    assert sorted(r["class"] for r in table) == [0] * 5 + [1] * 4
    chains = polygons.trace(frame.limit(0), WIDTH, 4, "kind")
    assert polygons.rings(chains).count() == 0 and polygons.geometry(chains, Affine(0, 1, 0, -1)).count() == 0


@pytest.mark.parametrize("cells,tile", CASES[:3])
def test_component_labels(spark, cells, tile):
    got = vectorize.connected_components(mask_frame(spark, cells), WIDTH, tile).collect()
    assert {(r.y, r.x): r.component for r in got} == flood_fill(cells)


def test_geometry_texts_are_not_moved(spark):
    """The class is joined to the vertices; WKT and GeoJSON, once made, pass no exchange and no join."""
    cells = {(0, 0), (0, 1), (1, 1), (4, 4)}
    affine = Affine(0, 1, 0, -1)
    made = polygons.geometry(polygons.trace(mask_frame(spark, cells), WIDTH, 4), affine)
    above = made._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in above and "Join" not in above
    assert sorted((r.shells, r.holes, r["class"]) for r in made.collect()) == [(1, 0, 1), (1, 0, 1)]
