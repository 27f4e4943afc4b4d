"""Components, rings and simplification against brute force on small masks."""

import math
import random
from collections import defaultdict

import pytest

from swathline.operators import vectorize

WIDTH = 24


def mask_frame(spark, cells):
    return spark.createDataFrame(sorted(cells), "y bigint, x bigint")


def flood_fill(cells):
    label, todo = {}, set(cells)
    while todo:
        start = min(todo, key=lambda c: c[0] * WIDTH + c[1])
        stack, group = [start], []
        todo.discard(start)
        while stack:
            y, x = stack.pop()
            group.append((y, x))
            for near in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if near in todo:
                    todo.discard(near)
                    stack.append(near)
        for cell in group:
            label[cell] = start[0] * WIDTH + start[1]
    return label


def random_mask(seed, share):
    rng = random.Random(seed)
    return {(y, x) for y in range(20) for x in range(WIDTH) if rng.random() < share}


SPIRAL = {(0, x) for x in range(20)} | {(y, 19) for y in range(20)} | {(19, x) for x in range(20)} | {
    (y, 0) for y in range(3, 20)} | {(3, x) for x in range(16)} | {(y, 15) for y in range(3, 16)}
RING_WITH_HOLES = {(y, x) for y in range(9) for x in range(9)} - {(2, 2), (4, 4), (4, 5), (5, 5), (6, 6)}


@pytest.mark.parametrize(
    "cells,tile",
    [(random_mask(1, 0.6), 5), (SPIRAL, 4), (RING_WITH_HOLES, 3)],
)
def test_components_and_rings(spark, cells, tile):
    want = flood_fill(cells)
    labelled = vectorize.connected_components(mask_frame(spark, cells), WIDTH, tile)
    got = {(r.y, r.x): r.component for r in labelled.collect()}
    assert got == want
    rings = vectorize.trace_rings(labelled, WIDTH)
    sizes = defaultdict(int)
    for component in want.values():
        sizes[component] += 1
    rows = vectorize.ring_summary(rings).collect()
    assert {r.component: r.area for r in rows} == sizes
    # Holes by flood filling the outside of each component.
    for row in rows:
        own = {c for c, label in want.items() if label == row.component}
        assert row.holes == holes_of(own)
    by_ring = defaultdict(list)
    for v in rings.collect():
        by_ring[v.ring].append(v)
    for line in by_ring.values():
        line.sort(key=lambda v: v.seq)
        assert [v.seq for v in line] == list(range(len(line)))
        for a, b in zip(line, line[1:] + line[:1]):
            assert abs(a.vy - b.vy) + abs(a.vx - b.vx) == 1


def holes_of(own):
    """Background regions not reachable from outside; diagonal steps join the background."""
    free = {(y, x) for y in range(-1, 22) for x in range(-1, WIDTH + 1)} - own
    regions = 0
    while free:
        stack = [free.pop()]
        outer = False
        while stack:
            y, x = stack.pop()
            outer = outer or (y, x) == (-1, -1)
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (y + dy, x + dx) in free:
                        free.discard((y + dy, x + dx))
                        stack.append((y + dy, x + dx))
        regions += 0 if outer else 1
    return regions


def test_resolve_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(1000, 1001), (1001, 1002)], "u bigint, v bigint")
    got = {r.node: r.root for r in vectorize.resolve(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 61))
    assert got[1001] == got[1002] == 1000


def test_resolve_star_hub(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(i, 5000 + i) for i in range(1, 200)], "u bigint, v bigint")
    got = {r.node: r.root for r in vectorize.resolve(edges).collect()}
    assert len(got) == 398 and set(got.values()) == {0}


def distance(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    if dx == 0 and dy == 0:
        return math.dist(p, a)
    return abs(dx * (a[1] - p[1]) - (a[0] - p[0]) * dy) / math.hypot(dx, dy)


def plain_simplify(points, tolerance):
    """Recursive Douglas-Peucker with the same three anchors."""

    def farthest(lo, hi):
        path = points + [points[0]]
        spots = [(distance(path[i], path[lo], path[hi]), -i) for i in range(lo + 1, hi)]
        return max(spots) if spots else (-1.0, 0)

    def cut(lo, hi):
        far, i = farthest(lo, hi)
        return cut(lo, -i) + [-i] + cut(-i, hi) if far > tolerance else []

    n = len(points)
    second = -farthest(0, n)[1]
    options = [(*farthest(0, second), 0, second), (*farthest(second, n), second, n)]
    options.sort(key=lambda o: (-o[0], o[2]))
    third, lo, hi = -options[0][1], options[0][2], options[0][3]
    anchors = sorted({0, second, third, n})
    kept = {0, second, third}
    for a, b in zip(anchors, anchors[1:]):
        kept |= set(cut(a, b))
    return kept


def test_simplify_against_recursion(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for ring in range(4):
        n = [3, 8, 25, 60][ring]
        points = [
            (math.cos(6.28318 * i / n) * (10 + rng.random() * ring), math.sin(6.28318 * i / n) * (10 + rng.random() * ring))
            for i in range(n)
        ]
        rows += [(ring, i, x, y) for i, (x, y) in enumerate(points)]
        want[ring] = plain_simplify(points, 0.8)
    got = defaultdict(set)
    frame = spark.createDataFrame(rows, "ring bigint, seq bigint, vx double, vy double")
    for r in vectorize.simplify_rings(frame, 0.8).collect():
        got[r.ring].add(r.seq)
    assert got == want
    assert all(len(v) >= 3 for v in got.values())


def test_dilate(spark):
    got = {(r.y, r.x) for r in vectorize.dilate(mask_frame(spark, {(0, 0), (5, 23)}), 1, WIDTH, 20).collect()}
    assert got == {(0, 0), (0, 1), (1, 0), (1, 1)} | {(y, x) for y in (4, 5, 6) for x in (22, 23)}


def test_short_rings_are_simplified_without_rounds(spark, monkeypatch):
    """Rings as arrays agree with the rounds over rows, ties and odd vertices included, and take no round of their own."""
    rng = random.Random(7)
    rows = [(r, s, float(rng.randrange(9)), float(rng.randrange(9))) for r in range(60) for s in range(rng.randrange(1, 40))]
    rows += [(100, s, *p) for s, p in enumerate([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)])]
    frame = spark.createDataFrame(rows, "ring long, seq long, vx double, vy double").repartition(3)
    want = sorted(map(tuple, vectorize._by_rounds(vectorize.cut_lineage(frame), 1.0).collect()))
    odd = spark.createDataFrame([(200, s, float(s), float("nan") if s == 2 else 0.0) for s in range(4)], frame.schema)
    odd_want = {tuple(map(str, r)) for r in vectorize._by_rounds(vectorize.cut_lineage(odd), 1.0).collect()}
    got = vectorize.simplify_rings(frame.unionByName(odd), 1.0).collect()
    assert sorted(tuple(r) for r in got if r.ring != 200) == want
    assert {tuple(map(str, r)) for r in got if r.ring == 200} == odd_want
    monkeypatch.setattr(vectorize, "WHOLE_RING", 10)  # some by rounds
    assert sorted(map(tuple, vectorize.simplify_rings(frame, 1.0).collect())) == want
    monkeypatch.undo()
    monkeypatch.setattr(vectorize, "_by_rounds", None)
    assert sorted(map(tuple, vectorize.simplify_rings(frame, 1.0).collect())) == want
