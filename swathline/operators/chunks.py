"""Dense chunks: a tile of a scene as arrays, so that scenes are compared tile by tile and no pixel is exchanged twice.

A chunk is one row per scene and tile that holds any pixel: scene, tile_id, y0, x0 and, by band, the values of its
tile x tile cells row by row with a validity bitmap (bit i, least significant first: cell i has a value). Cells carry no
coordinates. ``to_chunks`` is the only exchange of pixels; change detection, thresholds and masks read a chunk's bands side by
side in one narrow pass, for any number of scenes, and memory is bounded by a tile.

A pixel without value (NULL), or outside the raster, is not valid; NaN is a value. Where a pixel is given more than once
the smallest value stands. Reports have one row for every tile of every scene's grid: tiles without pixels are EMPTY_TILE.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.functions.numeric import intdiv
from swathline.functions.tiling import tile_bounds, tile_id, tile_origin, tiles_across, with_tile_box
from swathline.operators import otsu
from swathline.operators.change import tile_state
from swathline.schema import DB_FLOOR, DEFAULT_TILE, FLOOD_THRESHOLD_DB, OTSU_BINS, Affine, Header

PRE, POST = 1, 2
DIFF, MASK = 1, 2
_BAND = pa.struct([("band", pa.int32()), ("valid", pa.binary()), ("values", pa.list_(pa.float64()))])
_CHUNK = pa.schema(
    [("scene", pa.int64()), ("tile_id", pa.int64()), ("y0", pa.int64()), ("x0", pa.int64()), ("bands", pa.list_(_BAND))]
)
CHUNK_DDL = (
    "scene bigint, tile_id bigint, y0 bigint, x0 bigint, "
    "bands array<struct<band: int, valid: binary, values: array<double>>>"
)

Bands = dict[int, tuple[np.ndarray, np.ndarray]]


def _rows(scenes, tiles, y0, x0, bands: list[Bands], size: int) -> pa.RecordBatch:
    """Chunk rows from the (values, valid) arrays of their bands."""
    held = [(k, v, ok) for row in bands for k, (v, ok) in sorted(row.items())]
    packed = [np.packbits(ok, bitorder="little").tobytes() for _, _, ok in held]
    values = np.concatenate([v for _, v, _ in held]) if held else np.zeros(0)
    struct = pa.StructArray.from_arrays(
        [
            pa.array([k for k, _, _ in held], pa.int32()), pa.array(packed, pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * size, pa.int32()), pa.array(values, pa.float64())),
        ],
        fields=list(_BAND),
    )
    stops = np.concatenate([[0], np.cumsum([len(row) for row in bands])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(stops), struct)
    columns = [pa.array(c, pa.int64()) for c in (scenes, tiles, y0, x0)]
    return pa.RecordBatch.from_arrays([*columns, lists.cast(_CHUNK.field("bands").type)], schema=_CHUNK)


def read_bands(row: pa.Scalar) -> Bands:
    """(values, valid) by band of one chunk."""
    out = {}
    for band in row.values if row.is_valid else ():
        values = band["values"].values.to_numpy(zero_copy_only=False)
        bits = np.frombuffer(band["valid"].as_py(), np.uint8)
        out[band["band"].as_py()] = values, np.unpackbits(bits, count=len(values), bitorder="little").astype(bool)
    return out


def _densify(size: int) -> Callable[[pa.Table], pa.Table]:
    def dense(pixels: pa.Table) -> pa.Table:
        scene, name, y0, x0 = (pixels.column(c)[0].as_py() for c in ("scene", "tile_id", "y0", "x0"))
        band, y, x = (pixels.column(c).to_numpy() for c in ("band", "y", "x"))
        value = pixels.column("value")
        there, value = ~value.is_null().to_numpy(), value.to_numpy()
        at, bands = (y - y0) * size + x - x0, {}
        for k in np.unique(band).tolist():
            own = there & (band == k)
            values, valid = np.full(size * size, np.inf), np.zeros(size * size, bool)
            valid[at[own]] = True
            np.fmin.at(values, at[own], value[own])
            # NaN alone: no number was there.
            values[np.isinf(values) & valid] = np.nan
            exact = own & np.isinf(value)
            values[at[exact]] = np.fmin(values[at[exact]], value[exact])
            values[~valid] = 0.0
            bands[k] = values, valid
        return pa.Table.from_batches([_rows([scene], [name], [y0], [x0], [bands], size * size)])

    return dense


def to_chunks(pixels: DataFrame, width: int, tile: int = DEFAULT_TILE) -> DataFrame:
    """Chunks of a pixel table (scene, band, y, x, value): the pixels' one exchange."""
    keyed = pixels.select(
        F.col("scene").cast("bigint").alias("scene"), F.col("band").cast("int").alias("band"),
        *[F.col(c).cast("bigint").alias(c) for c in ("y", "x")], F.col("value").cast("double").alias("value"),
    ).withColumn("tile_id", tile_id(F.col("y"), F.col("x"), width, tile))
    y0, x0 = tile_origin(F.col("tile_id"), width, tile)
    keyed = keyed.withColumns({"y0": y0.cast("bigint"), "x0": x0.cast("bigint")})
    return keyed.groupBy("scene", "tile_id").applyInArrow(_densify(tile), CHUNK_DDL)


def _map(chunks: DataFrame, ddl: str, work: Callable[[int, int, Bands], tuple | None], schema: pa.Schema) -> DataFrame:
    """One row for each chunk, from its scene, tile and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scenes, tiles = batch.column("scene").to_pylist(), batch.column("tile_id").to_pylist()
            rows = [(s, t, *work(read_bands(b))) for s, t, b in zip(scenes, tiles, batch.column("bands"))]
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return chunks.select("scene", "tile_id", "bands").mapInArrow(run, ddl)


def decibel(values: np.ndarray) -> np.ndarray:
    return 10 * np.log10(np.maximum(values, DB_FLOOR))


def _pair(bands: Bands, pre: int, post: int):
    """(values, valid) of two bands; a band that isn't there has no valid cell."""
    some = next(iter(bands.values()), (np.zeros(0), np.zeros(0, bool)))
    none = np.zeros(len(some[0])), np.zeros(len(some[0]), bool)
    return *bands.get(pre, none), *bands.get(post, none)


def _grid(scenes: DataFrame, width: int, tile: int) -> DataFrame:
    """(scene, height, tile_id): every tile of every scene (scene, height)."""
    across = tiles_across(width, tile)
    last = intdiv(F.col("height") + (tile - 1), tile) * across - 1
    named = scenes.select(F.col("scene").cast("bigint").alias("scene"), F.col("height").cast("bigint").alias("height"))
    return named.filter(F.col("height") > 0).select("scene", "height", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("tile_id"))


def flood_tiles(
    chunks: DataFrame, scenes: DataFrame, width: int, affine: Affine, tile: int = DEFAULT_TILE,
    threshold: float = FLOOD_THRESHOLD_DB, crs: str = "EPSG:4326", pre: int = PRE, post: int = POST,
) -> DataFrame:
    """Per scene and tile of its grid: state, flooded pixels, shapes and bounds. ``scenes``: (scene, height)."""

    def work(bands: Bands) -> tuple:
        a, has_a, b, has_b = _pair(bands, pre, post)
        both = has_a & has_b
        hits = int((decibel(b[both]) - decibel(a[both]) < threshold).sum())
        n_pre, n_post = int(has_a.sum()), int(has_b.sum())
        # As many pixels on both sides, but not the same ones, is a mismatch too.
        return n_pre, n_post if n_pre != n_post or both.sum() == n_pre else -1, float(a[has_a].max()) if n_pre else None, hits

    ddl = "scene bigint, tile_id bigint, n_pre bigint, n_post bigint, max_pre double, hits bigint"
    kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64()]
    schema = pa.schema(list(zip([c.split(" ")[0] for c in ddl.split(", ")], kinds)))
    stats = _grid(scenes, width, tile).join(_map(chunks, ddl, work, schema), ["scene", "tile_id"], "left")
    head = Header(width=width, height=F.col("height"), affine=affine, crs=crs)
    status = tile_state(F.col("n_pre"), F.col("n_post"), F.col("max_pre"))
    boxed = with_tile_box(stats.withColumn("status", status), head, tile)
    good = F.col("status") == "SUCCESS"
    return boxed.select(
        "scene", "tile_id", F.when(good, F.col("hits")).otherwise(F.lit(0)).cast("bigint").alias("pixel_count"), "status",
        F.format_string("(%d, %d)", F.col("height"), F.lit(width)).alias("raster_shape"),
        F.format_string("(%d, %d)", F.col("h"), F.col("w")).alias("tile_shape"),
        *[F.when(good, col).alias(name) for name, col in tile_bounds(head).items()],
    )


def otsu_limit(diff: np.ndarray, bins: int = OTSU_BINS) -> float | None:
    """The threshold that separates two classes best; of equal ones the lowest."""
    diff = diff[~np.isnan(diff)]
    if not len(diff):
        return None
    low, high = diff.min(), diff.max()
    if low == high:
        return float(low)
    number = np.minimum(np.floor((diff - low) / (high - low) * bins), bins - 1).astype(np.int64)
    share = np.bincount(number, minlength=bins) / len(diff)
    centre = low + (np.arange(bins) + 0.5) * (high - low) / bins
    under, mass = np.cumsum(share), np.cumsum(share * centre)
    over = np.append(np.cumsum(share[::-1])[::-1][1:], 0.0)
    rest = np.append(np.cumsum((share * centre)[::-1])[::-1][1:], 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = under * over * (mass / under - rest / over) ** 2
    return float(centre[np.argmax(np.round(np.nan_to_num(score, nan=-1.0), 9))])


def flood_tiles_otsu(
    chunks: DataFrame, scenes: DataFrame, width: int, tile: int = DEFAULT_TILE, bins: int = OTSU_BINS,
    fixed: float = FLOOD_THRESHOLD_DB, mask_root: str = "masks", pre: int = PRE, post: int = POST,
) -> DataFrame:
    """Adaptive detection per scene and tile: pixel_count, status, threshold, mask_path; tiles without pixels EMPTY_OR_NODATA."""

    def work(bands: Bands) -> tuple:
        a, has_a, b, has_b = _pair(bands, pre, post)
        both = has_a & has_b
        diff = decibel(b[both]) - decibel(a[both])
        limit = otsu_limit(diff, bins)
        under = int((diff < limit).sum()) if limit is not None else 0
        return float(a[has_a].max()) if has_a.any() else None, limit, under, int((diff < fixed).sum())

    ddl = "scene bigint, tile_id bigint, max_pre double, threshold double, n_under bigint, n_fixed bigint"
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip([c.split(" ")[0] for c in ddl.split(", ")], kinds)))
    limits = _grid(scenes, width, tile).join(_map(chunks, ddl, work, schema), ["scene", "tile_id"], "left")
    # A tile without a pixel has no signal.
    limits = limits.withColumn("max_pre", F.coalesce("max_pre", F.lit(0.0)))
    return otsu.flood_tiles(limits, mask_root, keys=("scene",))


def cell_schema(names: dict[int, str]) -> tuple[pa.Schema, str]:
    """Arrow schema and DDL of (scene, y, x, one column a band)."""
    kinds = [("scene", pa.int64()), ("y", pa.int64()), ("x", pa.int64()), *[(n, pa.float64()) for n in names.values()]]
    return pa.schema(kinds), "scene bigint, y bigint, x bigint, " + ", ".join(f"{n} double" for n in names.values())


def cells(scene: int, y0: int, x0: int, bands: Bands, tile: int, names: dict[int, str]) -> pa.RecordBatch:
    """The cells of one chunk where any of the named bands has a value."""
    none = np.zeros(tile * tile), np.zeros(tile * tile, bool)
    held = [tuple(np.reshape(a, -1) for a in bands.get(k, none)) for k in names]
    cell = np.flatnonzero(np.any([ok for _, ok in held], axis=0))
    columns = [pa.array(np.full(len(cell), scene)), pa.array(y0 + cell // tile), pa.array(x0 + cell % tile)]
    columns += [pa.array(v[cell], mask=~ok[cell]) for v, ok in held]
    return pa.RecordBatch.from_arrays(columns, schema=cell_schema(names)[0])


#: Chunks that a worker makes before it hands them on.
AT_ONCE = 64


def flood_mask(
    chunks: DataFrame, threshold: float = FLOOD_THRESHOLD_DB, pre: int = PRE, post: int = POST,
    tile: int | None = None, names: dict[int, str] | None = None,
) -> DataFrame:
    """Chunks of the change in dB (band 1) and the mask (band 2, one or zero), where both rasters have a value.

    With the ``tile`` size and ``names`` of the bands, their cells as ``pixels`` gives them, in the same pass: chunks are
    then not gathered a second time on their way to Python.
    """

    def change(row: pa.Scalar) -> Bands:
        a, has_a, b, has_b = _pair(read_bands(row), pre, post)
        both = has_a & has_b
        diff = np.where(both, decibel(np.where(both, b, 1.0)) - decibel(np.where(both, a, 1.0)), 0.0)
        return {DIFF: (diff, both), MASK: ((diff < threshold).astype(float), both)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                keys = [part.column(c).to_pylist() for c in ("scene", "tile_id", "y0", "x0")]
                out = [change(row) for row in part.column("bands")]
                if names:
                    yield from (cells(s, y0, x0, b, tile, names) for s, y0, x0, b in zip(keys[0], *keys[2:], out))
                else:
                    yield _rows(*keys, out, max((len(b[DIFF][0]) for b in out), default=0))

    return chunks.mapInArrow(run, cell_schema(names)[1] if names else CHUNK_DDL)


def pixels(chunks: DataFrame, tile: int, names: dict[int, str]) -> DataFrame:
    """(scene, y, x, one column a band) of the cells where any of the bands has a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                scene, y0, x0 = (batch.column(c)[i].as_py() for c in ("scene", "y0", "x0"))
                yield cells(scene, y0, x0, read_bands(batch.column("bands")[i]), tile, names)

    return chunks.mapInArrow(run, cell_schema(names)[1])
