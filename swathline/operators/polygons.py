"""Cells of a class to polygons: rings with holes and shells, in pixel and in map coordinates.

Tiles are traced on their own: a tile labels its cells and links its boundary edges to chains, seeing a one-cell frame of
its neighbours. What is left open, chains that end at a tile border and labels of border cells, is stitched level by level:
``SPAN`` x ``SPAN`` areas form one of the next level, which joins what meets inside it and hands on only what reaches its
outer border. So the number of rounds is the logarithm of the raster's side, no group holds more than the borders inside
one area, and vertices aren't moved while rings are put together: a chain only learns its ring and its offset there.

Neighbours share a side. Where two cells of a region touch in a corner alone, the ring stays on its own cell. A region
has one shell, the boundary towards the outside, and every other ring of it is a hole of that shell: its inside is background
that the region encloses. Rings start behind their smallest edge and walk with the region on their left, y pointing down, so
that shells have positive and holes negative area. Rows of a null class, y or x are no cells; repeated cells are one, the
smallest class wins. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions.numeric import intdiv
from swathline.schema import Affine
from swathline.session import cut_lineage

SPAN = 16
CHAIN, BORDER, LABEL, MEMBER, CLOSED = range(5)
NONE = -1
#: Travel and outward direction (dy, dx) of the sides top, left, bottom, right, walked in this order.
TRAVEL = np.array([(0, -1), (1, 0), (0, 1), (-1, 0)])
OUTWARD = np.array([(-1, 0), (0, -1), (1, 0), (0, 1)])
#: Where a side starts, as corner of its cell.
START = np.array([(0, 1), (0, 0), (1, 0), (1, 1)])

_TILE_ROW = (
    "kind int, first bigint, next bigint, steps bigint, low bigint, low_at bigint, label bigint, class bigint, cross bigint, "
    "corners bigint, min_y bigint, max_y bigint, min_x bigint, max_x bigint, "
    "at array<bigint>, vy array<bigint>, vx array<bigint>"
)
_LINK_ROW = "kind int, a bigint, b bigint, steps bigint, low bigint, low_at bigint, class bigint, gy bigint, gx bigint"


def smallest_labels(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node that the pairs connect them to."""
    root = np.arange(n)
    while len(left):
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        apart = low != high
        if not apart.any():
            break
        left, right = left[apart], right[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(jumped := root[root], root):
            root = jumped
    return root


def _walk(following: np.ndarray, start_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths along ``following`` (-1: none) one behind the other, where each begins, and whether it is a circle.

    Circles start at their least ``start_at``.
    """
    heads = np.ones(len(following), bool)
    heads[following[following >= 0]] = False
    heads = np.flatnonzero(heads).tolist()
    after, seen, path, starts = following.tolist(), [False] * len(following), [], []
    for at in heads:
        starts.append(len(path))
        while at >= 0:
            path.append(at)
            seen[at] = True
            at = after[at]
    for at in np.argsort(start_at, kind="stable").tolist():
        if not seen[at]:
            starts.append(len(path))
            while not seen[at]:
                path.append(at)
                seen[at] = True
                at = after[at]
    starts = np.array(starts, np.int64)
    return np.array(path, np.int64), starts, np.arange(len(starts)) >= len(heads)


def _least(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each stretch of distinct values the least one and its place in all of them."""
    if not len(starts):
        return values[:0], starts
    low = np.minimum.reduceat(values, starts)
    order = np.argsort(values)
    return low, order[np.searchsorted(values, low, sorter=order)]


def _table(schema: pa.Schema, parts: list[dict]) -> pa.Table:
    """Rows from columns by name; a number stands for a whole column, a missing column is null."""
    out = []
    for columns in parts:
        n = len(next(v for v in columns.values() if not np.isscalar(v)))
        arrays = []
        for field in schema:
            value = columns.get(field.name)
            if value is None:
                value = pa.nulls(n, field.type)
            elif np.isscalar(value):
                value = np.full(n, value)
            arrays.append(value if isinstance(value, pa.Array) else pa.array(value, type=field.type))
        out.append(pa.RecordBatch.from_arrays(arrays, schema=schema))
    return pa.Table.from_batches(out, schema)


def _trace_tile(cells: pa.Table, width: int, tile: int) -> pa.Table:
    """Chains, rings and border cells of one tile, from its cells and the frame around it."""
    ys, xs, classes, ty, tx = (cells.column(c).to_numpy() for c in ("y", "x", "class", "ty", "tx"))
    oy, ox = int(ty[0]) * tile - 1, int(tx[0]) * tile - 1
    grid = np.full((tile + 2, tile + 2), np.iinfo(np.int64).max)
    np.minimum.at(grid, (ys - oy, xs - ox), classes)
    held = grid != np.iinfo(np.int64).max
    yy, xx = np.nonzero(held[1:-1, 1:-1])
    yy, xx = yy + 1, xx + 1
    number = np.full(grid.shape, -1)
    number[yy, xx] = np.arange(len(yy))
    pid = (yy + oy) * width + xx + ox

    def same(dy, dx):
        """Whether the neighbour has the class of each cell."""
        return held[yy + dy, xx + dx] & (grid[yy + dy, xx + dx] == grid[yy, xx])

    pairs = []
    for dy, dx in ((0, 1), (1, 0)):
        inside = same(dy, dx) & (number[yy + dy, xx + dx] >= 0)
        pairs.append((np.flatnonzero(inside), number[yy[inside] + dy, xx[inside] + dx]))
    # Cells are numbered by row, so the smallest number is the smallest pixel id.
    label = pid[smallest_labels(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), len(yy))]

    edges = []
    for side in range(4):
        (ty_, tx_), (ny, nx) = TRAVEL[side], OUTWARD[side]
        cell = np.flatnonzero(~same(ny, nx))
        ahead, diagonal = same(ty_, tx_)[cell], same(ty_ + ny, tx_ + nx)[cell]
        straight = ahead & ~diagonal
        turn = ahead & diagonal
        goal = pid[cell] + np.where(straight, ty_ * width + tx_, np.where(turn, (ty_ + ny) * width + tx_ + nx, 0))
        next_side = np.where(straight, side, np.where(turn, (side - 1) % 4, (side + 1) % 4))
        edges.append(np.stack([pid[cell] * 4 + side, goal * 4 + next_side, cell, np.full(len(cell), side)]))
    e, following, cell, side = np.concatenate(edges, axis=1)
    order = np.argsort(e)
    e, following, cell, side = e[order], following[order], cell[order], side[order]
    spot = _find(e, following)
    sy, sx = yy[cell] + oy + START[side, 0], xx[cell] + ox + START[side, 1]
    ey, ex = sy + TRAVEL[side, 0], sx + TRAVEL[side, 1]
    corner, cross = side != following % 4, ex * sy - sx * ey

    path, starts, closed = _walk(spot, e)
    stops = np.append(starts[1:], len(path))[: len(starts)]
    low, low_at = _least(e[path], starts)
    last, owner = path[stops - 1], cell[path[starts]]
    bends = np.flatnonzero(corner[path])
    per_chain = np.searchsorted(bends, np.append(starts, len(path))).astype(np.int32)
    chain_of = np.repeat(np.arange(len(starts)), stops - starts)
    py, px = ey[path], ex[path]

    def over(how, values):
        return how.reduceat(values, starts) if len(starts) else values[:0]

    def listed(values):
        return pa.ListArray.from_arrays(pa.array(per_chain), pa.array(values))

    chains = {
        "kind": CHAIN, "first": e[path[starts]], "next": np.where(closed, NONE, following[last]), "steps": stops - starts,
        "low": low, "low_at": low_at - starts, "label": label[owner], "class": grid[yy[owner], xx[owner]],
        "cross": over(np.add, cross[path]), "corners": np.diff(per_chain).astype(np.int64),
        "min_y": over(np.minimum, py), "max_y": over(np.maximum, py), "min_x": over(np.minimum, px),
        "max_x": over(np.maximum, px), "at": listed(bends - starts[chain_of[bends]]), "vy": listed(py[bends]), "vx": listed(px[bends]),
    }
    rim = np.zeros(len(yy), bool)
    for dy, dx, edge in ((0, 1, xx == tile), (0, -1, xx == 1), (1, 0, yy == tile), (-1, 0, yy == 1)):
        rim |= edge & same(dy, dx)
    border = {"kind": BORDER, "first": pid[rim], "next": NONE, "label": label[rim], "class": grid[yy[rim], xx[rim]]}
    return _table(_arrow(_TILE_ROW), [chains, border])


def _stitch_area(rows: pa.Table, width: int, inner: int, size: int) -> pa.Table:
    """What one area of ``size`` cells joins of its areas of ``inner`` cells, and what it hands on."""
    columns = {c: rows.column(c).to_numpy() for c in rows.column_names}
    place, out = {c: int(columns[c][0]) for c in ("gy", "gx")}, []

    def put(kind, a, b, steps=0, low=0, low_at=0, classes=0):
        out.append({"kind": kind, "a": a, "b": b, "steps": steps, "low": low, "low_at": low_at, "class": classes, **place})

    def of(kind, *names):
        at = np.flatnonzero(columns["kind"] == kind)
        at = at[np.argsort(columns["a"][at])]
        return [columns[c][at] for c in names]

    pid, names, classes = of(BORDER, "a", "b", "class")
    labels, number = np.unique(names, return_inverse=True)
    y, x = pid // width, pid % width
    pairs = [(np.zeros(0, np.int64),) * 2]
    for step, meets in ((1, ((x + 1) % inner == 0) & (x + 1 < width)), (width, (y + 1) % inner == 0)):
        spot = _find(pid, pid + step)
        found = meets & (spot >= 0) & (classes[spot] == classes if len(pid) else True)
        pairs.append((number[found], number[spot[found]]))
    root = labels[smallest_labels(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]), len(labels))]
    put(LABEL, labels, root)
    outer = (y % size == 0) | (y % size == size - 1) | (x % size == 0) | (x % size == size - 1)
    put(BORDER, pid[outer], root[number[outer]], classes=classes[outer])

    first, following, steps, low, low_at = of(CHAIN, "a", "b", "steps", "low", "low_at")
    path, starts, closed = _walk(_find(first, following), low)
    stops = np.append(starts[1:], len(path))[: len(starts)]
    before = np.cumsum(steps[path]) - steps[path]
    offset = before - np.repeat(before[starts], stops - starts)
    least, at = _least(low[path], starts)
    put(MEMBER, first[path], np.repeat(first[path[starts]], stops - starts), offset)
    length = offset[stops - 1] + steps[path[stops - 1]]
    whole = first[path[starts]], np.where(closed, NONE, following[path[stops - 1]]), length, least, offset[at] + low_at[path[at]]
    put(CLOSED, *[w[closed] for w in whole])
    put(CHAIN, *[w[~closed] for w in whole])
    return _table(_arrow(_LINK_ROW), out)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    spot = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[spot] == keys, spot, -1)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def trace(cells: DataFrame, width: int, tile: int, class_col: str | None = None) -> DataFrame:
    """Chains of all rings: (ring, offset, length, component, class, cross, corners, box, at, vy, vx).

    ``at``, ``vy``, ``vx``: the corners of a chain and their steps along it; ``offset`` its place in the ring of ``length``
    steps; ``component`` the smallest pixel id (y * width + x) of the region; ``cross`` twice the area below the chain.
    """
    named = F.col(class_col) if class_col else F.lit(1)
    near = [
        F.array_distinct(F.array(*[intdiv(F.col(c) + d, tile) for d in (-1, 0, 1)])) for c in ("y", "x")
    ]
    framed = (
        cells.select("y", "x", named.cast("bigint").alias("class")).dropna()
        .select("y", "x", "class", F.explode(near[0]).alias("ty"), near[1].alias("txs"))
        .select("y", "x", "class", "ty", F.explode("txs").alias("tx"))
    )
    framed = framed.select(*[F.col(c).cast("bigint").alias(c) for c in framed.columns])
    traced = cut_lineage(
        framed.groupBy("ty", "tx").applyInArrow(lambda part: _trace_tile(part, width, tile), _TILE_ROW)
    )
    # Chains are placed by the cell of their first edge, border cells by themselves.
    cell = F.when(F.col("kind") == CHAIN, F.shiftright("first", 2)).otherwise(F.col("first"))
    open_rows = traced.filter((F.col("kind") == BORDER) | (F.col("next") != NONE)).select(
        "kind", F.col("first").alias("a"), F.when(F.col("kind") == CHAIN, F.col("next")).otherwise(F.col("label")).alias("b"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("steps", "low", "low_at", "class")], intdiv(intdiv(cell, width), tile).alias("gy"), intdiv(cell % width, tile).alias("gx"),
    )
    places, labels = stitch(open_rows, width, tile)
    chains = traced.filter(F.col("kind") == CHAIN).drop("kind", "next")
    inside = chains.filter(traced["next"] == NONE).withColumns(
        {"ring": F.col("low"), "offset": -F.col("low_at"), "length": F.col("steps")}
    )
    across = chains.filter(traced["next"] != NONE).join(places, "first")
    whole = inside.unionByName(across.select(*inside.columns))
    named = whole.join(labels.withColumnRenamed("name", "label"), "label", "left")
    return named.withColumn("component", F.coalesce("root", "label")).drop("root", "label", "low", "low_at", "first")


def stitch(rows: DataFrame, width: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """Open chains and border cells, level by level: (first, ring, offset, length) of chains, (name, root) of labels.

    ``offset`` counts from the ring's smallest edge and may be negative. Labels that meet no other may be left out.
    """
    sides = rows.agg(F.max("gy"), F.max("gx")).first()
    across, size = 1 + max((s for s in sides if s is not None), default=0), tile
    places, names, done, roots = None, None, [], []
    level = rows
    while True:
        inner, size, across = size, size * SPAN, -(-across // SPAN)
        area = level.withColumns({c: intdiv(c, SPAN) for c in ("gy", "gx")})
        joined = cut_lineage(area.groupBy("gy", "gx").applyInArrow(_bound(width, inner, size), _LINK_ROW))
        member = joined.filter(F.col("kind") == MEMBER).select(F.col("a").alias("cur"), F.col("b").alias("into"), F.col("steps").alias("more"))
        if places is None:
            places = member.select(F.col("cur").alias("first"), F.col("into").alias("cur"), F.col("more").alias("offset"))
        else:
            places = places.join(member, "cur").select("first", F.col("into").alias("cur"), (F.col("offset") + F.col("more")).alias("offset"))
        closed = joined.filter(F.col("kind") == CLOSED).select(
            F.col("a").alias("cur"), F.col("low").alias("ring"), F.col("steps").alias("length"), F.col("low_at").alias("zero")
        )
        done.append(places.join(closed, "cur").select("first", "ring", (F.col("offset") - F.col("zero")).alias("offset"), "length"))
        merged = joined.filter(F.col("kind") == LABEL).select(F.col("a").alias("root"), F.col("b").alias("into"))
        if names is None:
            names = merged.select(F.col("root").alias("name"), F.col("into").alias("root"))
        else:
            names = names.join(merged, "root", "left").select("name", F.coalesce("into", "root").alias("root"))
        level = joined.filter(F.col("kind").isin(CHAIN, BORDER))
        if across == 1:
            break
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found, names


def _bound(width: int, inner: int, size: int) -> Callable[[pa.Table], pa.Table]:
    return lambda rows: _stitch_area(rows, width, inner, size)


def rings(chains: DataFrame) -> DataFrame:
    """One row per ring: ring, component, class, hole, shell, length, corners, area in cells, box.

    ``shell``: the ring that the hole lies in, or the ring itself.
    """
    per_ring = chains.groupBy("component", "ring").agg(
        F.min("class").alias("class"), F.sum("cross").alias("twice"), F.sum("steps").alias("length"),
        F.sum("corners").alias("corners"),
        F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"),
    )
    hole = F.col("twice") < 0
    shells = per_ring.filter(~hole).select("component", F.col("ring").alias("shell"))
    return per_ring.join(shells, "component").select(
        "ring", "component", "class", hole.alias("hole"), "shell", "length", "corners", (F.col("twice") / 2).alias("area"),
        "min_y", "max_y", "min_x", "max_x",
    )


def vertices(chains: DataFrame) -> DataFrame:
    """The corners of all rings in order: (ring, component, seq, vy, vx); a ring of any size is rows, not one value."""
    corner = F.explode(F.arrays_zip("at", "vy", "vx")).alias("c")
    # Numbers run from the end of the smallest edge on; ``offset`` is the chain's distance from that edge.
    return chains.select("ring", "component", "length", "offset", corner).select(
        "ring", "component", F.pmod(F.col("offset") + F.col("c.at"), F.col("length")).alias("seq"),
        F.col("c.vy").alias("vy"), F.col("c.vx").alias("vx"),
    )


def _loops(ys: list[int], xs: list[int]) -> list[list[tuple[int, int]]]:
    """A ring cut where it meets itself in a corner, so that no loop visits a vertex twice."""
    loops, path, place = [], [], {}
    for point in zip(ys, xs):
        if point in place:
            start = place[point]
            loops.append(path[start:])
            for p in path[start:]:
                del place[p]
            del path[start:]
        place[point] = len(path)
        path.append(point)
    return [*loops, path]


def _area(loop: list[tuple[int, int]]) -> int:
    """Twice the signed area, positive for shells."""
    return sum(bx * ay - ax * by for (ay, ax), (by, bx) in zip(loop, loop[1:] + loop[:1]))


def _simple_loops(loops: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Loops without vertices in the middle of a straight line."""
    out = []
    for loop in loops:
        around = zip(loop[-1:] + loop[:-1], loop, loop[1:] + loop[:1])
        out.append([b for a, b, c in around if (b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0])])
    return out


def geometry(chains: DataFrame, affine: Affine) -> DataFrame:
    """(component, class, shells, holes, wkt, geojson) in map coordinates, one valid polygon per region.

    Rings that meet themselves in a corner are cut there: the loop cut out of a shell is a hole that touches it. A region is
    one value here; ``vertices`` has the rings as rows. The shell comes first, then holes by their first vertex.
    """
    points = vertices(chains).groupBy("component", "ring").agg(F.sort_array(F.collect_list(F.struct("seq", "vy", "vx"))).alias("p"))
    regions = points.groupBy("component").agg(F.collect_list(F.struct("ring", F.col("p.vy").alias("vy"), F.col("p.vx").alias("vx"))).alias("rings"))
    kinds = chains.groupBy("component").agg(F.min("class").alias("class"))
    fields = "component bigint, class bigint, shells bigint, holes bigint, wkt string, geojson string"

    def written(loops):
        known = [(_area(loop) < 0, min(loop), loop) for loop in loops]
        known.sort(key=lambda k: k[:2])
        turned = [loop[(i := loop.index(first)) :] + loop[: i + 1] for _, first, loop in known]
        placed = [[f"{affine.x0 + x * affine.a!r} {affine.y0 + y * affine.e!r}" for y, x in loop] for loop in turned]
        wkt = "POLYGON (" + ", ".join("(" + ", ".join(loop) + ")" for loop in placed) + ")"
        pairs = ",".join("[" + ",".join("[" + p.replace(" ", ",") + "]" for p in loop) + "]" for loop in placed)
        negative = sum(k[0] for k in known)
        return len(known) - negative, negative, wkt, '{"type":"Polygon","coordinates":[' + pairs + "]}"

    def run(batches):
        for batch in batches:
            lists = batch.column("rings")
            outer, (vy, vx) = lists.offsets.to_pylist(), (lists.values.field(c) for c in ("vy", "vx"))
            (sy, ys), (sx, xs) = ((v.offsets.to_pylist(), v.values.to_pylist()) for v in (vy, vx))
            out = []
            for i, j in zip(outer, outer[1:]):
                cut = [_loops(ys[sy[k] : sy[k + 1]], xs[sx[k] : sx[k + 1]]) for k in range(i, j)]
                out.append(written([loop for loops in cut for loop in _simple_loops(loops)]))
            made = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            if out:
                columns = [batch.column("component"), batch.column("class"), *made]
                yield pa.RecordBatch.from_arrays(columns, names=["component", "class", "shells", "holes", "wkt", "geojson"])

    # The class comes in before the texts are made, so that these aren't moved again.
    made = regions.join(kinds, "component").select("component", "class", "rings").mapInArrow(run, fields)
    return made.select("component", "shells", "holes", "wkt", "geojson", "class")


def component_labels(local: DataFrame, width: int, tile: int) -> DataFrame:
    """(y, x, component) from cells labelled tile by tile (y, x, pid, label), by the same levels."""
    ty, tx = intdiv("y", tile), intdiv("x", tile)
    rim: Column = (F.col("x") % tile).isin(0, tile - 1) | (F.col("y") % tile).isin(0, tile - 1)
    zero = F.lit(0).cast("bigint")
    border = local.filter(rim).select(
        F.lit(BORDER).alias("kind"), F.col("pid").alias("a"), F.col("label").alias("b"),
        *[zero.alias(c) for c in ("steps", "low", "low_at", "class")], ty.alias("gy"), tx.alias("gx"),
    )
    _, names = stitch(border, width, tile)
    return local.join(names, F.col("label") == F.col("name"), "left").select("y", "x", F.coalesce("root", "label").alias("component"))
