"""Focal operators on dense chunks: tiles exchange the strips along their borders, windows are sums of prefix sums.

A chunk sends each neighbour only the rows and columns that its windows reach into; a tile and the strips it got form a padded
array. Window sums are differences of prefix sums, along columns and then along rows, so that their cost doesn't depend on
the window's size. If the chunks are stored in buckets by scene and tile, the strips are all that is shuffled.

A cell without a value adds nothing to any window and has no result. NaN is 0 in the moving mean and in the interferogram,
missing in the Lee filter and the coherence. Infinite values make the windows that hold them infinite or NaN, no others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.functions.tiling import tiles_across
from swathline.operators.chunks import _CHUNK, CHUNK_DDL, Bands, _rows, cell_schema, cells, read_bands

Reach = tuple[int, int]
#: Values and which of them count, by name.
Terms = dict[str, tuple[np.ndarray, np.ndarray]]
_STRIP_DDL = "scene bigint, tile_id bigint, dy int, dx int, bands array<struct<band: int, valid: binary, values: array<double>>>"
_BANDS = _CHUNK.field("bands").type


def window_sum(values: np.ndarray, before: Reach, after: Reach) -> np.ndarray:
    """Sums over [c - before, c + after] around each centre of a padded array."""
    special = ~np.isfinite(values)
    if special.any():
        kinds = [values == np.inf, values == -np.inf, np.isnan(values)]
        plus, minus, nan = (window_sum(k.astype(float), before, after) > 0.5 for k in kinds)
        out = window_sum(np.where(special, 0.0, values), before, after)
        out[plus] = np.inf
        out[minus] = -np.inf
        out[nan | (plus & minus)] = np.nan
        return out
    for axis in (0, 1):
        size = before[axis] + after[axis] + 1
        total = np.cumsum(values, axis=axis)
        first = np.take(total, [size - 1], axis=axis)
        head, tail = [slice(None)] * 2, [slice(None)] * 2
        head[axis], tail[axis] = slice(size, None), slice(None, -size)
        values = np.concatenate([first, total[tuple(head)] - total[tuple(tail)]], axis=axis)
    return values


def _strips(tile: int, width: int, before: Reach, after: Reach) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each neighbour (dy, dx) of a chunk the part that the neighbour's windows reach."""
    across = tiles_across(width, tile)
    schema = pa.schema([("scene", pa.int64()), ("tile_id", pa.int64()), ("dy", pa.int32()), ("dx", pa.int32()), ("bands", _BANDS)])

    def part(step: int, i: int) -> slice:
        # A neighbour ahead (1) reaches back into the last ``before`` lines, one behind into the first ``after``.
        return slice(tile - before[i], tile) if step == 1 else slice(0, after[i]) if step == -1 else slice(0, tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scene, name, held in zip(batch.column("scene").to_pylist(), batch.column("tile_id").to_pylist(), batch.column("bands")):
                bands = read_bands(held)
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        rows, columns = part(dy, 0), part(dx, 1)
                        size = (rows.stop - rows.start) * (columns.stop - columns.start)
                        beside = 0 <= name % across + dx < across and name // across + dy >= 0
                        if (dy, dx) == (0, 0) or not size or not beside:
                            continue
                        cut = {
                            k: tuple(a.reshape(tile, tile)[rows, columns].reshape(-1) for a in band) for k, band in bands.items()
                        }
                        if not any(ok.any() for _, ok in cut.values()):
                            continue
                        made = _rows([scene], [name], [0], [0], [cut], size).column("bands")
                        columns_ = [[scene], [name + dy * across + dx], [dy], [dx]]
                        arrays = [pa.array(c, f.type) for c, f in zip(columns_, schema)]
                        yield pa.RecordBatch.from_arrays([*arrays, made], schema=schema)

    return run


def neighbourhoods(
    chunks: DataFrame, tile: int, width: int, before: Reach, after: Reach, make: Callable[[Bands, Bands], Bands],
    everywhere: bool = False, names: dict[int, str] | None = None,
) -> DataFrame:
    """Chunks of what ``make`` returns for a tile: from its bands padded with the strips it got, and from its own bands.

    With ``names`` of bands, their cells as ``chunks.pixels`` gives them; a worker then holds one tile at a time, where chunks
    handed on to a second worker would be gathered there first.
    ``everywhere``: also for tiles that hold no cell but get a strip; they may lie below the raster's last line.
    """
    if max(*before, *after) > tile:
        raise ValueError("windows must not reach beyond the neighbouring tiles")
    strips = chunks.select("scene", "tile_id", "bands").mapInArrow(_strips(tile, width, before, after), _STRIP_DDL)
    side, across = (before[0] + tile + after[0], before[1] + tile + after[1]), tiles_across(width, tile)

    def place(step: int, i: int) -> slice:
        # Seen from the tile that got it: a strip sent ahead lies in front.
        start = {1: 0, 0: before[i], -1: before[i] + tile}[step]
        return slice(start, start + {1: before[i], 0: tile, -1: after[i]}[step])

    schema, ddl = cell_schema(names) if names else (_CHUNK, CHUNK_DDL)

    def work(own: pa.Table, got: pa.Table) -> pa.Table:
        if not own.num_rows and not everywhere:
            return pa.Table.from_batches([], schema)
        scene, name = ((own if own.num_rows else got).column(c)[0].as_py() for c in ("scene", "tile_id"))
        pieces = [(0, 0, read_bands(own.column("bands")[0]))] if own.num_rows else []
        pieces += [
            (got.column("dy")[i].as_py(), got.column("dx")[i].as_py(), read_bands(got.column("bands")[i])) for i in range(got.num_rows)
        ]
        padded: Bands = {}
        for dy, dx, bands in pieces:
            rows, columns = place(dy, 0), place(dx, 1)
            shape = rows.stop - rows.start, columns.stop - columns.start
            for k, (values, valid) in bands.items():
                if k not in padded:
                    padded[k] = np.zeros(side), np.zeros(side, bool)
                padded[k][0][rows, columns], padded[k][1][rows, columns] = values.reshape(shape), valid.reshape(shape)
        middle = slice(before[0], before[0] + tile), slice(before[1], before[1] + tile)
        with np.errstate(all="ignore"):
            made = make(padded, {k: (v[middle], ok[middle]) for k, (v, ok) in padded.items()})
        if names:
            return pa.Table.from_batches([cells(scene, name // across * tile, name % across * tile, made, tile, names)])
        out = {k: (np.where(ok, v, 0.0).reshape(-1), ok.reshape(-1)) for k, (v, ok) in made.items()}
        return pa.Table.from_batches([_rows([scene], [name], [name // across * tile], [name % across * tile], [out], tile * tile)])

    tiles = chunks.groupBy("scene", "tile_id")
    return tiles.cogroup(strips.groupBy("scene", "tile_id")).applyInArrow(work, ddl)


def focal(
    chunks: DataFrame, tile: int, width: int, before: Reach, after: Reach, terms: Callable[[Bands], Terms],
    finish: Callable[[dict[str, np.ndarray], np.ndarray, Bands], dict[int, np.ndarray]], centre: int = 1,
    names: dict[int, str] | None = None,
) -> DataFrame:
    """Chunks with the bands that ``finish`` makes of the window sums of ``terms``, their count ``n`` and the tile's own bands.

    ``n`` counts cells with a first term. Results stand where band ``centre`` has a value; NaN in a result means none.
    """

    def make(padded: Bands, home: Bands) -> Bands:
        counted = terms(padded)
        sums = {k: window_sum(np.where(ok, v, 0.0), before, after) for k, (v, ok) in counted.items()}
        n = np.rint(window_sum(next(iter(counted.values()))[1].astype(float), before, after))
        there = home[centre][1] if centre in home else np.zeros((tile, tile), bool)
        return {k: (v, there & ~np.isnan(v)) for k, v in finish(sums, n, home).items()}

    return neighbourhoods(chunks, tile, width, before, after, make, names=names)


def buffer(
    chunks: DataFrame, tile: int, width: int, height, reach: float, cell: tuple[float, float], band: int = 1
) -> DataFrame:
    """(scene, y, x, distance) of the cells within ``reach`` of a cell whose ``band`` has a value, centre to centre.

    ``cell``: height and width of a cell, in the unit of ``reach``. ``height``: lines of the raster, a number or a Column. The
    distances are exact: nearest cells along columns first, then the least over the columns in reach.
    """
    steps = int(reach // cell[0]), int(reach // cell[1])

    def make(padded: Bands, home: Bands) -> Bands:
        held = padded[band][1] if band in padded else np.zeros((tile + 2 * steps[0], tile + 2 * steps[1]), bool)
        lines = np.arange(len(held))[:, None]
        above = np.maximum.accumulate(np.where(held, lines, -np.inf), axis=0)
        below = np.minimum.accumulate(np.where(held, lines, np.inf)[::-1], axis=0)[::-1]
        along = (np.minimum(lines - above, below - lines) * cell[0])[steps[0] : steps[0] + tile] ** 2
        least = np.full((tile, tile), np.inf)
        for d in range(2 * steps[1] + 1):
            np.minimum(least, along[:, d : d + tile] + ((d - steps[1]) * cell[1]) ** 2, out=least)
        distance = np.sqrt(least)
        return {1: (distance, distance <= reach)}

    found = neighbourhoods(chunks, tile, width, steps, steps, make, everywhere=True, names={1: "distance"})
    return found.filter((F.col("y") < height) & (F.col("x") < width))


def _around(size: int) -> tuple[Reach, Reach]:
    """Windows of an even size reach one further back than forward."""
    return (size // 2,) * 2, ((size - 1) // 2,) * 2


def boxcar(chunks: DataFrame, tile: int, width: int, size: int = 10, band: int = 1, names: dict[int, str] | None = None) -> DataFrame:
    """Moving mean: bands 1 mean, 2 number of cells."""
    return focal(
        chunks, tile, width, *_around(size), lambda b: {"total": (np.nan_to_num(b[band][0], nan=0.0, posinf=np.inf, neginf=-np.inf), b[band][1])},
        lambda sums, n, home: {1: sums["total"] / n, 2: n}, band, names,
    )


def lee_filter(chunks: DataFrame, tile: int, width: int, enl: float = 1.0, size: int = 3, band: int = 1, names: dict[int, str] | None = None) -> DataFrame:
    """Lee (1980) speckle filter: bands 1 filtered, 2 number of cells."""
    s = 1.0 / enl

    def terms(bands: Bands) -> Terms:
        v, ok = bands[band]
        ok = ok & ~np.isnan(v)
        return {"s1": (v, ok), "s2": (v * v, ok)}

    def finish(sums, n, home):
        mean = sums["s1"] / n
        spread = np.maximum(sums["s2"] / n - mean * mean, 0.0)
        gain = np.clip(np.nan_to_num((spread - mean * mean * s) / (spread * (1 + s)), nan=0.0), 0.0, 1.0)
        return {1: mean + gain * (home[band][0] - mean), 2: n}

    return focal(chunks, tile, width, *_around(size), terms, finish, band, names)


def _products(bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """re and im of s1 * conj(s2), both energies, and where all are there; bands 1 to 4: amplitude, phase, amplitude, phase."""
    (a1, k1), (p1, k2), (a2, k3), (p2, k4) = (bands[k] for k in (1, 2, 3, 4))
    turn = a1 * a2 * np.exp(1j * (p1 - p2))
    return turn.real, turn.imag, a1 * a1, a2 * a2, k1 & k2 & k3 & k4


def interferogram(chunks: DataFrame, tile: int, width: int, size: int = 10, names: dict[int, str] | None = None) -> DataFrame:
    """Band 1: multi-looked phase of s1 * conj(s2), where the first image has a signal."""

    def terms(bands: Bands) -> Terms:
        re, im, _, _, there = _products(bands)
        return {"re": (np.where(np.isnan(re), 0.0, re), there), "im": (np.where(np.isnan(im), 0.0, im), there)}

    def finish(sums, n, home):
        return {1: np.where(home[1][0] != 0, np.arctan2(sums["im"] / n, sums["re"] / n), np.nan)}

    return focal(chunks, tile, width, *_around(size), terms, finish, names=names)


def coherence(chunks: DataFrame, tile: int, width: int, azimuth: int = 3, slant: int = 10, names: dict[int, str] | None = None) -> DataFrame:
    """Bands 1 coherence over an azimuth x range window, 2 number of cells."""

    def terms(bands: Bands) -> Terms:
        re, im, e1, e2, there = _products(bands)
        there = there & ~np.isnan(re + im)
        return {"re": (re, there), "im": (im, there), "e1": (e1, there), "e2": (e2, there)}

    def finish(sums, n, home):
        energy = np.sqrt(np.maximum(sums["e1"], 0.0) * np.maximum(sums["e2"], 0.0))
        return {1: np.where(energy > 0, np.hypot(sums["re"], sums["im"]) / energy, np.nan), 2: n}

    return focal(chunks, tile, width, (azimuth // 2, slant // 2), ((azimuth - 1) // 2, (slant - 1) // 2), terms, finish, names=names)
