"""Minimax contiguous partition of documents into shards, by bytes.

Documents with equal text are never parted. Texts are ordered by the leading bits of their MD5 hash; the rows that share
those bits form one atom, so the number of atoms is bounded by ``2 ** bits`` whatever the size of the table, and on
tables smaller than that an atom is one text. Only these atom sizes reach the driver, where a binary search finds the
smallest capacity for which a greedy contiguous cut needs no more than the given number of shards. When one atom
alone forces the capacity, it gets a shard of its own and the search goes on over the rest, so that one huge group of
copies doesn't leave the remaining shards uneven.

Slots number the rows of a shard without gaps. Ranks are taken inside (atom, part) cells, where a part holds a bounded
number of rows, and shifted by the counts of the cells before.

Null text: size 16, no checksum; all null texts are equal. Repeated doc_ids: each row gets its own slot. Empty table:
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathline.session import cut_lineage

OVERHEAD = 16
BITS = 16


def fits(ends: list[int], first: int, shards: int, capacity: int) -> bool:
    """Whether the atoms from ``first`` on, given by their running sums, fit ``shards`` shards when cut greedily."""
    at, done = first, ends[first - 1] if first else 0
    for _ in range(shards):
        at = bisect_right(ends, done + capacity, at)
        if at == len(ends):
            return True
        done = ends[at - 1] if at else 0
    return at == len(ends)


def minimax_capacity(ends: list[int], shards: int) -> int:
    """The smallest capacity for which a greedy contiguous cut needs at most ``shards`` shards; ends: running sums."""
    low, high = -(-ends[-1] // shards), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if fits(ends, 0, shards, middle):
            high = middle
        else:
            low = middle + 1
    return low


def cut(sizes: list[int], shards: int) -> list[int]:
    """A shard for each atom: large atoms alone, the others contiguous under the smallest feasible capacity.

    Each shard is filled only up to the mean of what is left, as far as the capacity still allows the rest to fit.
    """
    result, rest, left, next_shard = [0] * len(sizes), list(range(len(sizes))), shards, 0
    while left > 1 and rest:
        total = sum(sizes[i] for i in rest)
        alone = [i for i in rest if sizes[i] * left > total]
        if not alone or len(alone) >= left:
            break
        for i in alone:
            result[i] = next_shard
            next_shard += 1
        left -= len(alone)
        taken = set(alone)
        rest = [i for i in rest if i not in taken]
    if not rest:
        return result
    ends = list(accumulate(sizes[i] for i in rest))
    capacity = minimax_capacity(ends, left)
    begun, remaining = 0, left  # where the open shard begins; shards from the open one on
    for at, i in enumerate(rest):
        filled, after = (ends[at - 1] if at else 0) - begun, ends[at] - begun
        if filled and remaining > 1:
            mean = (ends[-1] - begun) / remaining
            if after > capacity or after + filled > 2 * mean and fits(ends, at, remaining - 1, capacity):
                next_shard, begun, remaining = next_shard + 1, ends[at - 1], remaining - 1
        result[i] = next_shard
    return result


def shard(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, part_rows: int = 16
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row per input row.

    ``part_rows``: a cell holds about this many rows, or eight times the mean of the atoms if that is more.
    """
    spark = docs.sparkSession
    text, digits = F.col(text_col).cast("string"), -(-bits // 4)
    hashed = F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, digits), 16, 10).cast("bigint")
    rows = cut_lineage(
        docs.select(
            F.col(id_col).alias(id_col),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + OVERHEAD).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.when(text.isNull(), F.lit(-1).cast("bigint"))
            .otherwise(F.shiftright(hashed, 4 * digits - bits))
            .alias("atom"),
        )
    )
    atoms = rows.groupBy("atom").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    listed = sorted((r.atom, r.bytes, r.n) for r in atoms.collect())  # at most 2 ** bits + 1 rows
    placed = cut([b for _, b, _ in listed], shards)
    target = max(part_rows, 8 * sum(n for _, _, n in listed) // (1 << bits))
    spread = spark.createDataFrame(
        [(a, s, max(1, -(-n // target))) for (a, _, n), s in zip(listed, placed)], "atom long, shard int, parts long"
    )
    cells = rows.join(F.broadcast(spread), "atom").withColumn("part", F.pmod(F.xxhash64(id_col), F.col("parts")))
    counts = cells.groupBy("shard", "atom", "part").agg(F.count("*").alias("n")).collect()
    # At most one cell per target rows besides one per atom: 2 ** bits / 8 more than there are atoms.
    offsets, start = [], dict.fromkeys(range(shards), 0)
    for r in sorted(counts):
        offsets.append((r.atom, r.part, start[r.shard]))
        start[r.shard] += r.n
    starts = spark.createDataFrame(offsets, "atom long, part long, start long")
    window = Window.partitionBy("atom", "part").orderBy(id_col, "text_crc32")
    return cells.withColumn("rank", F.row_number().over(window)).join(F.broadcast(starts), ["atom", "part"]).select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
