"""Neighbourhood operators on tiles with a halo.

Each pixel is sent to its own tile and, near an edge, to the neighbours whose
windows reach it; one exchange by tile follows. Everything after that runs on one
tile at a time, as arrays of fixed size: a task holds its sorted pixels and one tile,
no hash table over all of them. Windows are sums of shifted arrays, rows first, then
columns; missing pixels are handled by coordinate.

A NULL pixel is missing: it keeps its own row and adds nothing to the windows of others. NaN is 0 in the moving mean
and in the interferogram, as their contract says; in the Lee filter and the coherence it is missing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathline.functions.numeric import intdiv
from swathline.functions.radiometry import conj_product, imag_part, real_part


def with_halo(pixels: DataFrame, tile: int, before: tuple[int, int], after: tuple[int, int]) -> DataFrame:
    """Copies pixels to every tile (ty, tx) holding a centre whose window covers them,
    exchanged once by tile."""

    def reach(axis: str, i: int) -> Column:
        return F.explode(F.sequence(intdiv(F.col(axis) - after[i], tile), intdiv(F.col(axis) + before[i], tile)))

    spread = pixels.withColumn("ty", reach("y", 0)).withColumn("tx", reach("x", 1))
    return spread.repartition("ty", "tx")


def on_tiles(spread: DataFrame, work: Callable[[pa.Table, int, int], dict], fields: list[T.StructField]) -> DataFrame:
    """Rows made of one tile at a time: ``work`` gets the rows of a tile (ty, tx) and returns columns by name."""
    names = [f.name for f in fields]

    def run(cells: pa.Table) -> pa.Table:
        made = work(cells, cells.column("ty")[0].as_py(), cells.column("tx")[0].as_py())
        return pa.table({n: made[n] for n in names})

    return spread.groupBy("ty", "tx").applyInArrow(run, T.StructType(fields))


def _places(cells: pa.Table, start: tuple[int, int]) -> list[np.ndarray]:
    """Lines and columns of the cells, counted from ``start``."""
    return [cells.column(c).to_numpy().astype(np.int64) - s for c, s in zip(("y", "x"), start)]


def _once(cells: pa.Table, at: np.ndarray, names: list[str]) -> tuple[dict, np.ndarray]:
    """Columns ``names`` and place of every place; of a place given more than once the greatest value of each column."""
    places, first = np.unique(at, return_index=True)
    if len(places) == len(at):
        return {n: cells.column(n) for n in names}, at
    out = {}
    for n in names:
        keyed = pa.table({"at": at, "value": cells.column(n)})
        order = pc.sort_indices(keyed, sort_keys=[("at", "ascending"), ("value", "descending")]).to_numpy()
        out[n] = cells.column(n).take(order[np.unique(at[order], return_index=True)[1]])
    return out, places


def _fields(frame: DataFrame, names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, frame.schema[n].dataType) for n in names]


def window_sums(
    pixels: DataFrame,
    values: dict[str, Column],
    before: tuple[int, int],
    after: tuple[int, int],
    tile: int,
) -> DataFrame:
    """Sum of each value and count ``n`` of pixels with a first value in the window [c-before, c+after] around
    every existing pixel; the pixel's own columns are kept."""
    own = ["y", "x", *[c for c in pixels.columns if c not in ("y", "x")]]
    halo = with_halo(pixels, tile, before, after).withColumns({f"_{k}": v.cast("double") for k, v in values.items()})
    height, width = (before[i] + tile + after[i] for i in (0, 1))
    terms = list(values)

    def around(grid: np.ndarray) -> np.ndarray:
        grid = grid.reshape(height, width)
        grid = sum(grid[i : i + tile] for i in range(height - tile + 1))
        return sum(grid[:, i : i + tile] for i in range(width - tile + 1)).reshape(-1)

    def work(cells: pa.Table, ty: int, tx: int) -> dict:
        y, x = _places(cells, (ty * tile - before[0], tx * tile - before[1]))
        at, sums, counts = y * width + x, {}, {}
        for k in terms:
            value = cells.column(f"_{k}")
            there = value.is_valid().to_numpy()
            weights = value.to_numpy()[there]
            sums[k] = around(np.bincount(at[there], weights, height * width).astype(float))
            counts[k] = around(np.bincount(at[there], minlength=height * width))
        y, x = y - before[0], x - before[1]
        home = (y >= 0) & (y < tile) & (x >= 0) & (x < tile)
        out, centre = _once(cells.filter(pa.array(home)), (y * tile + x)[home], own)
        for k in terms:
            out[k] = pa.array(sums[k][centre], mask=counts[k][centre] == 0)
        return out | {"n": pa.array(counts[terms[0]][centre], pa.int64())}

    results = [*[T.StructField(k, T.DoubleType()) for k in values], T.StructField("n", T.LongType())]
    return on_tiles(halo, work, [*_fields(pixels, own), *results])


def boxcar(pixels: DataFrame, value: str = "value", size: int = 10, tile: int = 1024) -> DataFrame:
    """Moving mean of an even or odd size; even sizes reach one further back than forward."""
    before, after = size // 2, (size - 1) // 2
    numbers = F.nanvl(F.col(value).cast("double"), F.lit(0.0))
    sums = window_sums(pixels, {"total": numbers}, (before, before), (after, after), tile)
    return sums.withColumn("mean", F.try_divide("total", "n"))


def _number(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def lee_filter(pixels: DataFrame, enl: float = 1.0, size: int = 3, tile: int = 1024) -> DataFrame:
    """Lee (1980) speckle filter on present pixels."""
    reach = size // 2
    v = _number(F.col("value"))
    sums = window_sums(pixels, {"s1": v, "s2": v * v}, (reach, reach), (reach, reach), tile)
    s = 1.0 / enl
    mean = F.try_divide("s1", "n")
    var = F.greatest(F.try_divide("s2", "n") - F.col("mean") * F.col("mean"), F.lit(0.0))
    gain = F.try_divide(F.col("var") - F.col("mean") * F.col("mean") * s, F.col("var") * (1 + s))
    gain = F.least(F.greatest(F.coalesce(gain, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return (
        sums.withColumn("mean", mean)
        .withColumn("var", var)
        .withColumn("filtered", F.col("mean") + gain * (v - F.col("mean")))
    )


def interferogram(pair: DataFrame, size: int = 10, tile: int = 1024) -> DataFrame:
    """Multi-looked phase of s1 * conj(s2); NULL where the first image has no signal."""
    re, im = conj_product(
        real_part(F.col("a1"), F.col("p1")),
        imag_part(F.col("a1"), F.col("p1")),
        real_part(F.col("a2"), F.col("p2")),
        imag_part(F.col("a2"), F.col("p2")),
    )
    before, after = size // 2, (size - 1) // 2
    values = {"re": F.nanvl(re, F.lit(0.0)), "im": F.nanvl(im, F.lit(0.0))}
    sums = window_sums(pair, values, (before, before), (after, after), tile)
    phase = F.atan2(F.try_divide("im", "n"), F.try_divide("re", "n"))
    valid = F.col("a1").isNotNull() & (F.col("a1") != 0)
    return sums.withColumn("phase", F.when(valid, phase))


def coherence(pair: DataFrame, azimuth: int = 3, slant: int = 10, tile: int = 1024) -> DataFrame:
    """|sum s1 conj(s2)| / sqrt(sum |s1|^2 * sum |s2|^2) over an azimuth x range window."""
    re, im = conj_product(
        real_part(F.col("a1"), F.col("p1")),
        imag_part(F.col("a1"), F.col("p1")),
        real_part(F.col("a2"), F.col("p2")),
        imag_part(F.col("a2"), F.col("p2")),
    )
    values = {"re": re, "im": im, "e1": F.col("a1") * F.col("a1"), "e2": F.col("a2") * F.col("a2")}
    present = _number(re + im).isNotNull()  # a pixel counts in all four sums or in none
    values = {k: F.when(present, v) for k, v in values.items()}
    before = (azimuth // 2, slant // 2)
    after = ((azimuth - 1) // 2, (slant - 1) // 2)
    sums = window_sums(pair, values, before, after, tile)
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return sums.withColumn("coherence", F.try_divide(size, F.sqrt(F.col("e1") * F.col("e2"))))


def patches(
    pixels: DataFrame, names: list[str], tile: int, nodata: float = 0.0, of_tile: dict[str, Column] | None = None
) -> DataFrame:
    """3x3 patch of each named column around every pixel, row-major, missing cells as nodata.

    The tile (ty, tx) by which the result is partitioned stays in the output. ``of_tile`` adds columns made of a tile's
    rows by windows over (ty, tx), before the patches widen them; its own pixels are marked ``home``, the halo is not.
    """
    home = (intdiv("y", tile) == F.col("ty")) & (intdiv("x", tile) == F.col("tx"))
    halo = with_halo(pixels, tile, (1, 1), (1, 1)).withColumn("home", home).withColumns(of_tile or {})
    halo = halo.withColumns({n: F.col(n).cast("double") for n in names})
    own = ["ty", "tx", "y", "x", *[c for c in halo.columns if c not in ("ty", "tx", "y", "x", "home", *names)]]
    side = tile + 2

    def work(cells: pa.Table, ty: int, tx: int) -> dict:
        y, x = _places(cells, (ty * tile - 1, tx * tile - 1))
        columns, at = _once(cells, y * side + x, [*own, "home", *names])
        there = pc.fill_null(columns["home"], False)
        centre = at[there.to_numpy()]
        out = {c: columns[c].filter(there) for c in own}
        for n in names:
            grid = np.full(side * side, nodata)
            grid[at] = pc.fill_null(columns[n], nodata).to_numpy()
            out |= {f"{n}_{k}": grid[centre + (k // 3 - 1) * side + k % 3 - 1] for k in range(9)}
        return out

    cells = [T.StructField(f"{n}_{k}", T.DoubleType()) for n in names for k in range(9)]
    return on_tiles(halo, work, [*_fields(halo, own), *cells])
