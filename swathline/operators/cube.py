"""Time-series cubes, grid alignment and resampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathline.functions.numeric import intdiv
from swathline.functions.radiometry import db_masked
from swathline.operators import focal


def stack(scenes: dict[str, DataFrame]) -> DataFrame:
    """Dated scenes (y, x, value) as one long cube (t, y, x, value)."""
    cube = None
    for day, scene in scenes.items():
        part = scene.withColumn("t", F.lit(day).cast("date")).select("t", "y", "x", "value")
        cube = part if cube is None else cube.unionByName(part)
    return cube


def to_db(cube: DataFrame) -> DataFrame:
    return cube.withColumn("db", db_masked(F.col("value")))


def mean_per_time(cube: DataFrame) -> DataFrame:
    return to_db(cube).groupBy("t").agg(
        F.avg("db").alias("mean_db"), F.count("db").alias("valid"), F.count("*").alias("cells")
    )


def mean_per_pixel(cube: DataFrame) -> DataFrame:
    return to_db(cube).groupBy("y", "x").agg(F.avg("db").alias("mean_db"), F.count("db").alias("valid"))


def series(cube: DataFrame) -> DataFrame:
    """Per pixel the change since the previous date. A pixel has one row per date."""
    order = Window.partitionBy("y", "x").orderBy("t")
    return to_db(cube).withColumns(
        {
            "prev_t": F.lag("t").over(order),
            "prev_db": F.lag("db").over(order),
        }
    ).withColumn("change_db", F.col("db") - F.col("prev_db"))


def nearest_index(coordinate: Column, first: float, step: float, count: Column | int) -> Column:
    """Index of the nearest node of a regular axis; a tie takes the larger coordinate."""
    n = count if isinstance(count, Column) else F.lit(count)
    raw = (coordinate - F.lit(first)) / F.lit(abs(step))
    if step > 0:
        index = F.floor(raw + 0.5)
    else:
        index = F.ceil(-raw - 0.5)
    return F.greatest(F.lit(0), F.least(n - 1, index)).cast("bigint")


def reindex_nearest(
    source: DataFrame,
    grid: DataFrame,
    y_axis: tuple,
    x_axis: tuple,
) -> DataFrame:
    """Source values on the cells of a reference grid, nearest on each axis on its own.

    An axis is (first coordinate, step, count) of the source; ``grid`` carries the
    reference coordinates yc, xc. Nearest is arithmetic, so alignment is an equi join.
    """
    keyed = grid.withColumns({"sy": nearest_index(F.col("yc"), *y_axis), "sx": nearest_index(F.col("xc"), *x_axis)})
    right = source.select(F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("value"))
    return keyed.join(right, ["sy", "sx"], "left").drop("sy", "sx")


#: Cells on a side of the target tiles of resampling.
TARGET_TILE = 128


def _target_tiles(coord: str, scale: float, shift: float) -> Column:
    """Tiles of the targets t with |coord - (scale*t + shift)| < 1, as an array."""
    low = F.floor((F.col(coord) - 1 - F.lit(shift)) / F.lit(scale)) + 1
    high = F.ceil((F.col(coord) + 1 - F.lit(shift)) / F.lit(scale)) - 1
    return F.when(low <= high, F.sequence(intdiv(low, TARGET_TILE), intdiv(high, TARGET_TILE)))


def _in_reach(coord: np.ndarray, scale: float, shift: float, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Targets of each coordinate inside the tile that starts at ``first``, counted from there, and whose they are."""
    low = np.floor((coord - 1 - shift) / scale) + 1 - first
    high = np.ceil((coord + 1 - shift) / scale) - 1 - first
    low, high = np.maximum(low, 0).astype(np.int64), np.minimum(high, TARGET_TILE - 1).astype(np.int64)
    count = np.maximum(high - low + 1, 0)
    whose = np.repeat(np.arange(len(coord)), count)
    return np.arange(len(whose)) - np.repeat(np.cumsum(count) - count - low, count), whose


def reproject_bilinear(
    source: DataFrame, scale: float, shift: float, height=None, width=None, nodata: float | None = None
) -> DataFrame:
    """Bilinear resampling onto a grid whose cell t sits at source position scale*t + shift.

    Each source pixel goes to the tiles of the targets it weighs on, one exchange, and targets sum their
    weights tile by tile, so there is no neighbour join and no hash table over all targets of a task; weights
    renormalise over valid pixels: those that aren't NULL, NaN or ``nodata``. A target with none of them is NULL with ``n`` 0.
    """
    valid = ~F.isnan("value") if nodata is None else ~F.isnan("value") & (F.col("value") != nodata)
    source = source.select("y", "x", F.when(valid, F.col("value")).cast("double").alias("value"))
    spread = source.withColumn("ty", F.explode(_target_tiles("y", scale, shift)))
    spread = spread.withColumn("tx", F.explode(_target_tiles("x", scale, shift))).repartition("ty", "tx")
    side = TARGET_TILE

    def work(cells: pa.Table, ty: int, tx: int) -> dict:
        y, x, value = (cells.column(c).to_numpy() for c in ("y", "x", "value"))
        there = cells.column("value").is_valid().to_numpy()
        down, whose = _in_reach(y, scale, shift, ty * side)
        across, of = _in_reach(x[whose], scale, shift, tx * side)
        down, whose = down[of], whose[of]
        weight = (1 - np.abs(y[whose] - ((down + ty * side) * scale + shift))) * (
            1 - np.abs(x[whose] - ((across + tx * side) * scale + shift))
        )
        at, given = down * side + across, there[whose]
        touched = np.bincount(at, minlength=side * side) > 0
        held, weight = at[given], weight[given]
        total = np.bincount(held, weight * value[whose[given]], side * side).astype(float)[touched]
        weights = np.bincount(held, weight, side * side).astype(float)[touched]
        cell = np.flatnonzero(touched)
        return {
            "y": cell // side + ty * side, "x": cell % side + tx * side,
            "value": pa.array(np.divide(total, weights, where=weights != 0, out=np.zeros(len(cell))), mask=weights == 0),
            "n": np.bincount(held, minlength=side * side)[touched],
        }

    kinds = [("y", T.LongType()), ("x", T.LongType()), ("value", T.DoubleType()), ("n", T.LongType())]
    made = focal.on_tiles(spread, work, [T.StructField(*k) for k in kinds])
    if height is None:
        return made
    return made.filter((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))


def interpolate_table(df: DataFrame, key: str, nodes: DataFrame, cell: int, group: list[str] | None = None) -> DataFrame:
    """As-of lookup with linear interpolation in a calibration table (x, lut).

    Consecutive nodes become intervals, cut into cells of a fixed width, so the range
    condition turns into an equi join on the cell. Beyond the first and the last node their value holds. Every row stays;
    without a key, or in a group without nodes, its lut is NULL.
    """
    group = group or []
    order = Window.partitionBy(*group).orderBy("node") if group else Window.partitionBy(F.lit(0)).orderBy("node")
    spans = nodes.select(
        *group,
        F.col("node").alias("lo"),
        F.col("lut").alias("lut_lo"),
        F.lead("node").over(order).alias("hi"),
        F.lead("lut").over(order).alias("lut_hi"),
    ).filter(F.col("hi").isNotNull())
    spans = spans.withColumn("_cell", F.explode(F.sequence(intdiv("lo", cell), intdiv(F.col("hi") - 1, cell))))
    ends = [
        F.struct(F.min("node").alias("node"), F.min_by("lut", "node").alias("lut")).alias("_first"),
        F.struct(F.max("node").alias("node"), F.max_by("lut", "node").alias("lut")).alias("_last"),
    ]
    if group:
        keyed = df.join(nodes.groupBy(*group).agg(*ends), group, "left")
    else:
        limits = nodes.agg(*ends)
        keyed = df.withColumns({c: limits.select(c).scalar() for c in ("_first", "_last")})
    keyed = keyed.withColumn("_cell", intdiv(key, cell))
    for c in (*group, "_cell"):
        spans = spans.withColumnRenamed(c, f"_s_{c}")
    within = (F.col(key) >= F.col("lo")) & (F.col(key) < F.col("hi"))
    for c in (*group, "_cell"):
        within = within & (F.col(c) == F.col(f"_s_{c}"))
    part = (F.col(key) - F.col("lo")) / (F.col("hi") - F.col("lo"))
    between = F.col("lut_lo") + (F.col("lut_hi") - F.col("lut_lo")) * part
    lut = (
        F.when(F.col(key) >= F.col("_last.node"), F.col("_last.lut"))
        .when(F.col(key) < F.col("_first.node"), F.col("_first.lut"))
        .otherwise(between)
    )
    return keyed.join(spans, within, "left").select(*df.columns, lut.alias("lut"))
