"""Periodic runs of words: scale-tiled search with stitched fragments.

A run is a stretch of words that repeats a block of ``q`` words (its smallest period) at least four times, holds at least
six words and can't be extended by a neighbour. In terms of matches (word i equals word i + q) it is a maximal stretch of
at least 3q matches. The search is cut by scale:

1. Explode. For each octave of periods [2^k, 2^(k+1)) a text is cut into tiles that overlap by 3 * 2^(k+1) words, so that
   any 3q matches in a row lie wholly in some tile. Such a stretch holds two neighbouring blocks of 2^k words, aligned at a
   multiple of 2^k, that recur q words later; rolling hashes of blocks find the places, and tiles without one hold no
   fragment and aren't made. Tiles are rows of their own, so a long text is solved by many tasks.
2. Solve. Inside a tile, Z-functions at each such boundary, one to the right and one to the left, give for every period of
   the octave how far the matches reach: fragments (text, period, first match, end of matches), exact and independent of
   other tiles. Periods that are a multiple of a shorter one go, by the same Z-function.
3. Stitch. Fragments are shuffled by text and period, and overlapping ones become one run.

The first two parts write one table into the shared folder: a row per document, with the text only where it has tiles,
and the tiles. Only such documents meet their runs in a join.

Null or empty texts and texts of white space: no words, no runs. Rows with a null or repeated id are treated each for
itself. Texts of any length are searched whole; the words of one text are held by one task. Empty table: empty result.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathline.llm.common import as_bytes, map_batches
from swathline.session import cut_lineage

REPEATS = 4
MIN_WORDS = 6
#: Matches in a tile besides the overlap: eight smallest periods of the octave, this many at least.
TILE, LEAST_TILE = 8, 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)
WORD = r"[^\x20\x09-\x0D]+"


def word_codes(words: list[bytes]) -> np.ndarray:
    """Whole numbers that are equal exactly where the words are."""
    codes = {word: i for i, word in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(codes.__getitem__, words), np.int32, len(words))


def _doubled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of blocks of 2 * size from those of blocks of ``size``, one for each start."""
    mixed = hashes[:-size] * _MIX
    mixed ^= mixed >> np.uint64(29)
    return mixed * _MIX + hashes[size:]


def _places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(boundary, period) pairs, by boundary: two blocks of ``size`` from this boundary on recur a period of the octave later.

    ``hashes`` are those of blocks of ``size``. Different blocks with one hash give a pair too many, never one too few.
    """
    blocks = (len(hashes) - 1) // size
    if blocks < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # Position i lies one to two blocks after the boundary (i // size - 1) * size.
    follows = hashes[size : size * blocks].reshape(-1, size) == hashes[: size * (blocks - 1) : size, None]
    last = hashes[size * blocks :][:size] == hashes[size * (blocks - 1)]
    last = np.concatenate([last, np.zeros(size - len(last), bool)])
    hit = np.concatenate([follows, last[None]])
    block, ahead = np.nonzero(hit[:-1] & hit[1:])
    return block * size, ahead + size


def octaves(codes: np.ndarray):
    """(octave, boundaries, periods) of all octaves that four repeats leave room for, where there is a place at all."""
    hashes, k = codes.astype(np.uint64), 0
    while REPEATS << k <= len(codes):
        at, period = _places(hashes, 1 << k)
        if len(at):
            yield k, at, period
        hashes, k = _doubled(hashes, 1 << k), k + 1


def tiles(codes: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(octave, first word, codes) of the tiles that hold a place."""
    out = []
    for k, at, _ in octaves(codes):
        step, overlap = max(TILE << k, LEAST_TILE), 6 << k
        # A boundary lies in the tile it starts in and, by the overlap, in those before.
        first = np.maximum(0, -((overlap + step - 1 - at) // step))
        reach = int((at // step - first).max())
        held = np.unique(np.concatenate([np.minimum(first + i, at // step) for i in range(reach + 1)]))
        for t in held.tolist():
            out.append((k, t * step, codes[t * step : (t + 1) * step + overlap + (2 << k)]))
    return out


def z_function(text: list[int], first: int, stop: int) -> list[int]:
    """z[i] = how far text[first + i:] agrees with text[first:], for i below ``stop``; z[0] is the whole length."""
    n = len(text) - first
    z = [0] * min(stop, n)
    if z:
        z[0] = n
    left = right = 0
    for i in range(1, len(z)):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and text[first + k] == text[first + i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(maxsize=1 << 16)
def _primes(n: int) -> tuple[int, ...]:
    found, d = [], 2
    while d * d <= n:
        if n % d == 0:
            found.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return tuple(found + [n] * (n > 1))


def solve(codes: np.ndarray, octave: int) -> list[tuple[int, int, int]]:
    """(period, first match, end of matches) of all stretches of at least 3 periods of matches inside a tile."""
    size = 1 << octave
    window = max(TILE << octave, LEAST_TILE) + (6 << octave)  # matches that belong to the tile
    hashes = codes.astype(np.uint64)
    for k in range(octave):
        hashes = _doubled(hashes, 1 << k) if len(hashes) > 1 << k else hashes[:0]
    at, period = _places(hashes, size)
    text = codes.tolist()
    out, covered = [], {}
    cuts = np.flatnonzero(np.diff(at)) + 1
    for boundary, periods in zip(at[np.r_[0, cuts]].tolist() if len(at) else [], np.split(period, cuts)):
        fresh = [q for q in periods.tolist() if covered.get(q, -1) < boundary]
        if not fresh:
            continue
        ahead = z_function(text, boundary, 2 * size)
        # The boundary before this one doesn't match, so that matches reach back by less than a block.
        low = max(0, boundary - size)
        back = text[low:boundary][::-1]
        mirrored = back + [-1] + text[low : boundary + 2 * size][::-1]
        behind = z_function(mirrored, 0, len(mirrored))
        end = len(mirrored) - (boundary - low)  # where matches of period 0 would start in the mirrored text
        for q in fresh:
            right = ahead[q] if q < len(ahead) else 0
            start, stop = boundary - (behind[end - q] if back else 0), min(boundary + right, window)
            covered[q] = boundary + right
            whole = all(ahead[q // p] < right + q - q // p for p in _primes(q))
            if whole and stop - start >= (REPEATS - 1) * q:
                out.append((q, start, stop))
    return out


def _explode(docs: DataFrame, doc_type: str) -> DataFrame:
    schema = f"uid bigint, doc {doc_type}, n bigint, plain string, text binary, octave int, first bigint, codes binary"

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = {c: [] for c in ("uid", "at", "n", "plain", "text", "octave", "first", "codes")}

            def put(*row):
                for column, value in zip(out.values(), row):
                    column.append(value)

            uids, texts = batch.column("uid").to_pylist(), batch.column("text")
            for i, uid in enumerate(uids):
                text = texts[i].as_py() or b""
                words = text.split()  # by the six ASCII white spaces, as bytes are
                found = tiles(word_codes(words)) if len(words) >= MIN_WORDS else []
                put(uid, i, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), text if found else None, None, None, None)
                for octave, first, codes in found:
                    put(uid, i, None, None, None, octave, first, codes.astype("<i4").tobytes())
            return out | {"doc": batch.column("doc").take(pa.array(out["at"], pa.int64()))}

        return work

    return map_batches(docs, schema, make)


def _fragments(tiled: DataFrame) -> DataFrame:
    """(uid, period, first, stop): matches first to stop - 1."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = {"uid": [], "period": [], "first": [], "stop": []}
            for row in range(batch.num_rows):
                uid, octave, first, codes = (batch.column(c)[row].as_py() for c in ("uid", "octave", "first", "codes"))
                for period, start, stop in solve(np.frombuffer(codes, "<i4"), octave):
                    for column, value in zip(out.values(), (uid, period, first + start, first + stop)):
                        column.append(value)
            return out

        return work

    # Tiles are dealt one by one, so that those of a long text don't stay in one task.
    dealt = tiled.repartition("uid", "octave", "first")
    return map_batches(dealt, "uid bigint, period bigint, first bigint, stop bigint", make)


def _stitch(fragments: DataFrame) -> DataFrame:
    """(uid, start, length, period) of whole runs."""
    before = Window.partitionBy("uid", "period").orderBy("first", "stop")
    reached = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("first") > reached, F.lit(True)).cast("int")
    marked = fragments.withColumn("opens", opens)
    numbered = marked.withColumn("run", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("uid", "period", "run").agg(F.min("first").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    runs = whole.select("uid", "start", length.alias("length"), "period")
    return runs.filter(F.col("length") >= F.greatest(F.lit(MIN_WORDS), REPEATS * F.col("period")))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join(words[i] for i in kept.tolist())


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest exact exponent; ties go to the smallest start, then period."""
    best = runs[0]
    for run in runs[1:]:
        more = run[1] * best[2] - best[1] * run[2]
        if more > 0 or (more == 0 and (run[0], run[2]) < (best[0], best[2])):
            best = run
    return best


def _report(held: DataFrame, doc_type: str) -> DataFrame:
    schema = (
        f"doc {doc_type}, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
        "runs_sha256 string, collapsed_sha256 string, collapsed binary"
    )

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed")}
            for row in range(batch.num_rows):
                found = batch.column("runs")[row].as_py() or []
                runs = sorted(((r["start"], r["length"], r["period"]) for r in found), key=lambda r: (r[0], r[2]))
                text = batch.column("text")[row].as_py()
                collapsed = collapse(text.split(), runs)
                start, length, period = longest(runs) if runs else (None, None, None)
                listing = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                values = (
                    len(runs), start, length, period, 1000 * length // period if runs else None,
                    hashlib.sha256(listing).hexdigest(), hashlib.sha256(collapsed).hexdigest(), collapsed,
                )
                for column, value in zip(out.values(), values):
                    column.append(value)
            return out | {"doc": batch.column("doc"), "n_words": batch.column("n")}

        return work

    return map_batches(held, schema, make)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, runs). Documents: id, n_words, n_runs, the strongest run, digests and, where the text has tiles, the
    collapsed text (``collapsed``, UTF-8 bytes). Runs: (uid, id, start, length, period), ``uid`` numbering the rows.
    """
    doc_type = dict(docs.select(F.col(id_col).alias("doc")).dtypes)["doc"]
    plain = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc"), as_bytes(text_col).alias("text")
    )
    stored = cut_lineage(_explode(plain, doc_type))
    tiled = stored.filter(F.col("octave").isNotNull()).select("uid", "octave", "first", "codes")
    runs = _stitch(_fragments(tiled))
    rows = stored.filter(F.col("octave").isNull())
    listed = runs.groupBy("uid").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    held = rows.filter(F.col("text").isNotNull()).select("uid", "doc", "n", "text").join(listed, "uid", "left")
    none = F.lit(None).cast("bigint")
    clean = rows.filter(F.col("text").isNull()).select(
        "doc", F.col("n").alias("n_words"), F.lit(0).cast("bigint").alias("n_runs"),
        *[none.alias(c) for c in ("start", "length", "period", "exponent_milli")],
        F.sha2(F.lit("").cast("binary"), 256).alias("runs_sha256"), F.col("plain").alias("collapsed_sha256"),
        F.lit(None).cast("binary").alias("collapsed"),
    )
    documents = _report(held.select("doc", "n", "text", "runs"), doc_type).unionByName(clean)
    named = rows.select("uid", F.col("doc").alias(id_col)).join(runs, "uid")
    return documents.withColumnRenamed("doc", id_col), named


def words_of(text: Column) -> Column:
    """The words of a text, as an array of strings."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def plant_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Test runs: with h = crc32 of the id and g = h // 10, texts with h % 10 = 0 repeat a block from word a = g % n on.

    The block has p = 1 + (n - a) // (3 + g % 8) words; texts without words and rows with a null id stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(F.col("_words")).cast("bigint")
    first = F.col("_first")
    block = F.lit(1) + F.floor((n - first) / (F.lit(3) + g % 8))
    source = F.transform(
        F.sequence(F.lit(0).cast("bigint"), n - 1),
        lambda i: F.get("_words", F.when(i < first, i).otherwise(first + (i - first) % F.col("_block")).cast("int")),
    )
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(chosen, words_of(F.col("_text")))
    shaped = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
        .select("*", F.col("_id").alias(id_col))
        .withColumn("_words", words)
        .withColumn("_first", F.try_mod(g, n))
        .withColumn("_block", block)
    )
    return shaped.select(id_col, F.when(n > 0, F.array_join(source, " ")).otherwise(F.col("_text")).alias(text_col))
