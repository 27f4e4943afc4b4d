"""Masks to vectors: components, dilation, rings, simplification.

Only the first labelling inside a tile uses a Python kernel, on a group of at most
tile*tile pixels. Everything that spans tiles is an iterative join on keys that
are unique or salted, with a stored table per round.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathline.functions.numeric import intdiv
from swathline.functions.tiling import tile_id
from swathline.operators import focal, polygons
from swathline.session import cut_lineage

SALTS = 8
MAX_ROUNDS = 200
#: Rings of so many vertices at most are simplified whole, as arrays; a batch of them stays small. Longer ones stay rows.
WHOLE_RING = 1000
#: Rounds of simplification that split every ring once, whatever the tolerance.
FORCED = 2


def _label_tile(cells: pd.DataFrame) -> pd.DataFrame:
    """4-connected labels inside one tile: the smallest pixel id of each component."""
    cells = cells.sort_values("pid", ignore_index=True)
    y, x = cells["y"].to_numpy(), cells["x"].to_numpy()
    y0, x0 = y.min(), x.min()
    where = np.full((y.max() - y0 + 1, x.max() - x0 + 1), -1, dtype=np.int64)
    where[y - y0, x - x0] = np.arange(len(cells))
    pairs = []
    for a, b in ((where[:, :-1], where[:, 1:]), (where[:-1, :], where[1:, :])):
        both = (a >= 0) & (b >= 0)
        pairs.append((a[both], b[both]))
    left = np.concatenate([p[0] for p in pairs])
    right = np.concatenate([p[1] for p in pairs])
    root = np.arange(len(cells))
    while len(left):
        low = np.minimum(root[left], root[right])
        high = np.maximum(root[left], root[right])
        open_pairs = low != high
        if not open_pairs.any():
            break
        left, right = left[open_pairs], right[open_pairs]
        np.minimum.at(root, high[open_pairs], low[open_pairs])
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
    return pd.DataFrame({"y": y, "x": x, "pid": cells["pid"], "label": cells["pid"].to_numpy()[root]})


def _fingerprint(edges: DataFrame) -> tuple:
    """Size and an order-free checksum of an edge set."""
    row = edges.agg(
        F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1_000_003)))
    ).first()
    return tuple(row)


def _with_minimum(edges: DataFrame, minima: DataFrame) -> DataFrame:
    """Joins the node minimum onto its edges; hub nodes are split by salt."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    repeated = minima.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(repeated, ["u", "salt"]).drop("salt")


def resolve(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge set (u, v): (node, root), root smallest.

    Alternating large-star and small-star rounds (Kiveris et al. 2014).
    """
    edges = edges.filter(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    edges = cut_lineage(edges.distinct())
    seen = _fingerprint(edges)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            _with_minimum(both.filter(F.col("v") > F.col("u")), lowest)
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter(F.col("u") != F.col("v"))
            .distinct()
        )
        large = cut_lineage(large)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            _with_minimum(large, lowest)
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v")))
            .filter(F.col("u") != F.col("v"))
            .distinct()
        )
        edges = cut_lineage(small)
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def connected_components(mask: DataFrame, width: int, tile: int) -> DataFrame:
    """(y, x, component) for the pixels of a mask; component = smallest pixel id."""
    keyed = mask.select(
        "y",
        "x",
        (F.col("y") * width + F.col("x")).alias("pid"),
        tile_id(F.col("y"), F.col("x"), width, tile).alias("tile_id"),
    )
    local = keyed.groupBy("tile_id").applyInPandas(
        lambda cells: _label_tile(cells), "y bigint, x bigint, pid bigint, label bigint"
    )
    local = cut_lineage(local)
    return polygons.component_labels(local, width, tile)


def component_summary(labelled: DataFrame, cell_area: float = 1.0) -> DataFrame:
    return labelled.groupBy("component").agg(
        F.count("*").alias("n_pixels"),
        (F.count("*") * F.lit(cell_area)).alias("area"),
        F.min("y").alias("min_y"),
        F.max("y").alias("max_y"),
        F.min("x").alias("min_x"),
        F.max("x").alias("max_x"),
    )


def dilate(mask: DataFrame, reach: int, width: int, height) -> DataFrame:
    """Square dilation by ``reach`` pixels; the union of all squares, clipped to the raster."""
    bottom = (height if isinstance(height, Column) else F.lit(height)) - 1
    rows = F.sequence(F.greatest(F.col("y") - reach, F.lit(0)), F.least(F.col("y") + reach, bottom))
    cols = F.sequence(F.greatest(F.col("x") - reach, F.lit(0)), F.least(F.col("x") + reach, F.lit(width - 1)))
    wide = mask.select(F.explode(rows).alias("y"), "x").distinct()
    return wide.select("y", F.explode(cols).alias("x")).distinct()


def boundary_edges(cells: DataFrame, label: str, tile: int = 256) -> DataFrame:
    """Directed unit edges between a labelled cell and anything else, interior on the left
    hand when walking with y downwards.

    A side met by one cell of a label only is boundary; cells look at their neighbours inside tiles with a halo of one
    cell. Sides: 0 top, 1 left, 2 bottom, 3 right, walked in this order.
    """
    side = F.col("side")

    def shift(*sides):
        return side.isin(*sides).cast("int")

    width = tile + 2

    def work(cells: pa.Table, ty: int, tx: int) -> dict:
        y, x = (cells.column(c).to_numpy().astype(np.int64) - (t * tile - 1) for c, t in (("y", ty), ("x", tx)))
        number = cells.column(label).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        at = (number * np.int64(width) + y) * width + x
        keys, first, count = np.unique(at, return_index=True, return_counts=True)
        y, x = y[first], x[first]
        own = (count == 1) & (y >= 1) & (y <= tile) & (x >= 1) & (x <= tile)
        alone = []
        for step in (-width, -1, width, 1):
            beside = np.minimum(np.searchsorted(keys, keys + step), len(keys) - 1)
            alone.append(own & (keys[beside] != keys + step))
        cell, sides = np.nonzero(np.stack(alone, axis=1))
        held = cells.take(first[cell])
        return {label: held.column(label), "y": held.column("y"), "x": held.column("x"), "side": sides.astype(np.int32)}

    halo = focal.with_halo(cells.select(label, "y", "x"), tile, (1, 1), (1, 1))
    fields = [T.StructField(c, cells.schema[c].dataType) for c in (label, "y", "x")]
    single = focal.on_tiles(halo, work, [*fields, T.StructField("side", T.IntegerType())])
    return single.select(
        label,
        "y",
        "x",
        "side",
        (F.col("y") + shift(2, 3)).alias("sy"),
        (F.col("x") + shift(0, 3)).alias("sx"),
        (F.col("y") + shift(1, 2)).alias("ey"),
        (F.col("x") + shift(2, 3)).alias("ex"),
    )


def trace_rings(labelled: DataFrame, width: int) -> DataFrame:
    """Ordered ring vertices of every component: (component, ring, seq, vy, vx, corner, cross).

    Each boundary edge knows its follower; rings are ordered by pointer doubling, so a
    ring of length L needs about log2(L) joins on unique keys and is never gathered.
    ``cross`` is twice the signed area below the edge.
    """
    edges = boundary_edges(labelled, "component").withColumn("owner", F.col("y") * width + F.col("x"))
    edges = cut_lineage(
        edges.select(
            "component", "owner", "side", "sy", "sx", "ey", "ex", (F.col("owner") * 4 + F.col("side")).alias("e")
        )
    )
    at_start = Window.partitionBy("sy", "sx")
    followers = edges.withColumn("choices", F.count("*").over(at_start)).select(
        F.col("sy").alias("ey"),
        F.col("sx").alias("ex"),
        F.col("e").alias("next"),
        F.col("owner").alias("next_owner"),
        F.col("side").alias("next_side"),
        "choices",
    )
    # Where two rings touch in a corner, a ring stays on its own cell.
    linked = edges.join(followers, ["ey", "ex"]).filter(
        (F.col("choices") == 1) | (F.col("next_owner") == F.col("owner"))
    )
    linked = cut_lineage(
        linked.select(
            "component",
            "e",
            "next",
            "ey",
            "ex",
            (F.col("side") != F.col("next_side")).alias("corner"),
            (F.col("ex") * F.col("sy") - F.col("sx") * F.col("ey")).alias("cross"),
        )
    )
    return linked.join(_order_rings(linked), "e").select(
        "component",
        F.col("low").alias("ring"),
        F.col("steps").alias("seq"),
        F.col("ey").alias("vy"),
        F.col("ex").alias("vx"),
        "corner",
        "cross",
    )


def _order_rings(linked: DataFrame) -> DataFrame:
    """(e, low, steps): the smallest edge of the ring of ``e`` and the distance to it.

    After k rounds an edge has seen ``reach`` = 2^k edges ahead. Meeting its smallest edge a
    second time shows that it has seen the whole ring, and how long the ring is at most;
    once the reach is twice that, the ring is done and leaves the table.
    """
    none = F.lit(None).cast("bigint")
    walk = linked.select(
        "e", F.col("next").alias("ptr"), F.col("e").alias("low"), F.lit(0).cast("bigint").alias("steps"), none.alias("length")
    )
    reach, done = 1, []
    while True:
        ahead = walk.select(
            F.col("e").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"), F.col("steps").alias("steps2")
        )
        further = F.col("steps2") + F.lit(reach)
        again = F.when((F.col("low") == F.col("low2")) & (further != F.col("steps")), further - F.col("steps"))
        # The edge ahead may have left already; then this edge is final as well.
        walk = cut_lineage(
            walk.join(ahead, "ptr", "left").select(
                "e",
                F.coalesce("ptr2", "ptr").alias("ptr"),
                F.least("low", "low2").alias("low"),
                F.when(F.col("low2") < F.col("low"), further).otherwise(F.col("steps")).alias("steps"),
                F.coalesce("length", again).alias("length"),
            )
        )
        reach *= 2
        final = F.coalesce(F.col("length") * 2 <= F.lit(reach), F.lit(False))
        done.append(walk.filter(final).select("e", "low", "steps"))
        walk = walk.filter(~final)
        if walk.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)


def ring_summary(rings: DataFrame) -> DataFrame:
    """Per component: rings, holes, perimeter, corners and area from the traced rings."""
    per_ring = rings.groupBy("component", "ring").agg(
        F.sum("cross").alias("twice"),
        F.count("*").alias("length"),
        F.sum(F.col("corner").cast("int")).alias("corners"),
        F.min("vy").alias("min_y"),
        F.max("vy").alias("max_y"),
        F.min("vx").alias("min_x"),
        F.max("vx").alias("max_x"),
    )
    return per_ring.groupBy("component").agg(
        F.count("*").alias("rings"),
        F.sum(F.when(F.col("twice") < 0, 1).otherwise(0)).alias("holes"),
        F.sum("length").alias("perimeter"),
        F.sum("corners").alias("corners"),
        (F.sum("twice") / 2).alias("area"),
        F.min("min_y").alias("min_y"),
        F.max("max_y").alias("max_y"),
        F.min("min_x").alias("min_x"),
        F.max("max_x").alias("max_x"),
    )


def _join_segment(vertices: DataFrame, best: DataFrame) -> DataFrame:
    salted = vertices.withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(SALTS)))
    repeated = best.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(repeated, ["ring", "lo", "salt"], "left").drop("salt")


def _offset(px, py, ax, ay, bx, by):
    """Distance of a point from the line through a and b, from a itself if they coincide."""
    dx, dy = bx - ax, by - ay
    length = F.sqrt(dx * dx + dy * dy)
    across = F.abs(dx * (ay - py) - (ax - px) * dy)
    apart = F.sqrt((px - ax) * (px - ax) + (py - ay) * (py - ay))
    return F.when(length == 0, apart).otherwise(F.try_divide(across, length))


def _farthest(starts: np.ndarray, x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of whole rings stay; ``starts``: where each ring begins. The rounds of ``_by_rounds`` on arrays."""
    sizes = np.diff(np.append(starts, len(x)))
    ring = np.repeat(starts, sizes)
    lo, hi, keep = ring.copy(), ring.copy(), np.zeros(len(x), bool)
    keep[starts] = True
    at = np.flatnonzero(~keep)
    for round_no in itertools.count():
        if not len(at):
            return keep
        heads = np.flatnonzero(np.append(True, lo[at][1:] != lo[at][:-1]))
        part = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(at))))
        ax, ay, bx, by, px, py = x[lo[at]], y[lo[at]], x[hi[at]], y[hi[at]], x[at], y[at]
        dx, dy = bx - ax, by - ay
        length = np.sqrt(dx * dx + dy * dy)
        apart = np.sqrt((px - ax) * (px - ax) + (py - ay) * (py - ay))
        across = np.abs(dx * (ay - py) - (ax - px) * dy)
        far = np.where(length == 0, apart, across / np.where(length == 0, 1, length))
        most = np.maximum.reduceat(far, heads)
        hits = np.flatnonzero(far == most[part])
        top = at[hits[np.unique(part[hits], return_index=True)[1]]]  # of equal ones the first
        if round_no < FORCED:
            rings = ring[at[heads]]
            order = np.lexsort((lo[at[heads]], -most, rings))
            split = np.zeros(len(heads), bool)
            split[order[np.unique(rings[order], return_index=True)[1]]] = True
            stay = np.ones(len(at), bool)
        else:
            split = most > tolerance
            stay = split[part]
        keep[top[split]] = True
        cut, middle = split[part], top[part]
        later, earlier = cut & (at > middle), cut & (at < middle)
        lo[at[later]], hi[at[earlier]] = middle[later], middle[earlier]
        at = at[stay & ~keep[at]]


def _whole_rings(points: DataFrame, tolerance: float) -> DataFrame:
    """Simplification of rings that are one value each."""
    lists = points.groupBy("ring").agg(F.sort_array(F.collect_list(F.struct("seq", "vx", "vy"))).alias("p"))

    def run(batches):
        for batch in batches:
            p = batch.column("p")
            offsets, held = p.offsets.to_numpy(), p.values
            x, y = held.field("vx").to_numpy(), held.field("vy").to_numpy()
            first, last = offsets[0], offsets[-1]
            keep = first + np.flatnonzero(_farthest(offsets[:-1] - first, x[first:last], y[first:last], tolerance))
            owner = pa.array(np.searchsorted(offsets, keep, side="right") - 1)
            kept = held.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column("ring").take(owner), *(kept.field(c) for c in ("seq", "vx", "vy"))], names=["ring", "seq", "vx", "vy"]
            )

    return lists.mapInArrow(run, points.schema)


def simplify_rings(vertices: DataFrame, tolerance: float) -> DataFrame:
    """Douglas-Peucker simplification of closed rings (ring, seq, vx, vy).

    Rings of up to ``WHOLE_RING`` vertices are simplified as arrays, longer ones, and those with vertices that aren't
    numbers, by rounds over their rows. A ring keeps at least three distinct vertices: its first one, the one farthest
    from it, and the one farthest from the line between the two.
    """
    points = vertices.select("ring", "seq", F.col("vx").cast("double"), F.col("vy").cast("double"))
    points = cut_lineage(points.filter(F.col("ring").isNotNull()))
    odd = [F.col("seq").isNull(), *(F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)) for c in ("vx", "vy"))]
    sizes = points.groupBy("ring").agg(F.count("*").alias("size"), F.max(functools.reduce(Column.__or__, odd)).alias("odd"))
    apart = cut_lineage(sizes.filter((F.col("size") > WHOLE_RING) | F.col("odd")).select("ring"))
    whole = _whole_rings(points.join(apart, "ring", "left_anti"), tolerance)
    if apart.isEmpty():
        return whole
    return whole.unionByName(_by_rounds(cut_lineage(points.join(apart, "ring", "left_semi")), tolerance))


def _by_rounds(points: DataFrame, tolerance: float) -> DataFrame:
    """Simplification of rings of any size.

    A round measures all open vertices against their segment, takes the farthest per
    segment with a combined aggregate, and splits or closes the segment.
    """
    here = F.struct("seq", "vx", "vy")
    starts = points.groupBy("ring").agg(
        F.min_by(here, "seq").alias("a"), (F.max("seq") + 1).alias("end")
    )
    # The closing copy of the first vertex carries the sequence number ``end``.
    segments = points.join(starts, "ring").select(
        "ring", "seq", "vx", "vy",
        F.col("a.seq").alias("lo"), F.col("a.vx").alias("ax"), F.col("a.vy").alias("ay"),
        F.col("end").alias("hi"), F.col("a.vx").alias("bx"), F.col("a.vy").alias("by"),
        (F.col("seq") == F.col("a.seq")).alias("kept"),
    )
    kept = [segments.filter("kept")]
    open_rows = cut_lineage(segments.filter(~F.col("kept")))
    for round_no in itertools.count():
        if open_rows.isEmpty():
            break
        far = _offset(*[F.col(c) for c in ("vx", "vy", "ax", "ay", "bx", "by")])
        measured = open_rows.withColumn("far", far)
        best = measured.groupBy("ring", "lo").agg(
            F.max_by(here, F.struct(F.col("far"), -F.col("seq"))).alias("top"), F.max("far").alias("top_far")
        )
        if round_no < FORCED:
            # Anchor rounds: one split per ring, whatever the tolerance.
            per_ring = Window.partitionBy("ring").orderBy(F.desc("top_far"), "lo")
            best = best.withColumn("anchor", F.row_number().over(per_ring) == 1)
            split, hold = F.col("anchor"), F.col("top").isNotNull() & ~F.col("anchor")
        else:
            split, hold = F.col("top_far") > F.lit(tolerance), F.lit(False)
        joined = _join_segment(open_rows, best)
        before = F.col("seq") < F.col("top.seq")
        moved = joined.filter(split | hold)
        moved = moved.select(
            "ring", "seq", "vx", "vy",
            F.when(split & ~before, F.col("top.seq")).otherwise(F.col("lo")).alias("lo"),
            F.when(split & ~before, F.col("top.vx")).otherwise(F.col("ax")).alias("ax"),
            F.when(split & ~before, F.col("top.vy")).otherwise(F.col("ay")).alias("ay"),
            F.when(split & before, F.col("top.seq")).otherwise(F.col("hi")).alias("hi"),
            F.when(split & before, F.col("top.vx")).otherwise(F.col("bx")).alias("bx"),
            F.when(split & before, F.col("top.vy")).otherwise(F.col("by")).alias("by"),
            (split & (F.col("seq") == F.col("top.seq"))).alias("kept"),
        )
        moved = cut_lineage(moved)
        kept.append(moved.filter("kept"))
        open_rows = moved.filter(~F.col("kept"))
    return functools.reduce(DataFrame.unionByName, kept).select("ring", "seq", "vx", "vy")
