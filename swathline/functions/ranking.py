"""Exact running sums and ranks over a global order without a single-task window.

Rows are range-partitioned; each range is summed on its own, the range totals (one
row per partition) are accumulated, and ranks inside a range are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathline.session import cut_lineage


def running_totals(df: DataFrame, order: str, sums: list[str]) -> DataFrame:
    """Adds ``<c>_before`` and ``<c>_total`` for each column; ``order`` must be unique.

    The range number of a row is fixed in a stored table, because range bounds are sampled.
    """
    ranged = cut_lineage(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_range",
        *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}_off") for c in sums],
        *[F.sum(f"_{c}").over(everything).alias(f"{c}_total") for c in sums],
    )
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(offsets, "_range")
        .withColumns({f"{c}_before": F.col(f"_{c}_off") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
        .drop("_range", *[f"_{c}_off" for c in sums])
    )


def exact_percentiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """Linear-interpolated percentiles of a column as one row p0, p1, ...

    Equal values are counted together first, so a value that fills the column is one row. NULL and NaN are skipped.
    """
    counted = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranked = running_totals(counted, "v", ["n"])

    def at(position: Column) -> Column:
        hit = (position >= F.col("n_before")) & (position < F.col("n_before") + F.col("n"))
        return F.max(F.when(hit, F.col("v")))

    picks = []
    for i, share in enumerate(shares):
        spot = F.lit(share) * (F.col("n_total") - 1)
        picks += [
            at(F.floor(spot)).alias(f"lo{i}"),
            at(F.ceil(spot)).alias(f"hi{i}"),
            F.max(spot - F.floor(spot)).alias(f"w{i}"),
        ]
    one = ranked.agg(*picks)
    return one.select(
        *[
            (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")).alias(f"p{i}")
            for i in range(len(shares))
        ]
    )


def rank_in_group(df: DataFrame, group: str, key: str, span: int = 1 << 20) -> DataFrame:
    """0-based rank of each row inside its group by a unique whole-number key.

    A group is cut into key ranges of ``span``, so a group of any size is ranked by many tasks.
    """
    part = F.floor(F.col(key) / F.lit(span)).cast("bigint")
    ranged = df.withColumn("_part", part)
    sizes = ranged.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    within = Window.partitionBy(group, "_part").orderBy(key)
    # A NULL group is a group like any other.
    offsets = offsets.select(F.col(group).alias("_in"), F.col("_part").alias("_of"), "_off")
    same = F.col(group).eqNullSafe(F.col("_in")) & F.col("_part").eqNullSafe(F.col("_of"))
    return (
        ranged.join(offsets, same)
        .withColumn("rank", F.col("_off") + F.row_number().over(within) - 1)
        .drop("_part", "_off", "_in", "_of")
    )


def smallest_per_group(df: DataFrame, group: str, hashed: str, tie: list[str], wanted: DataFrame) -> DataFrame:
    """Per group the ``k`` rows with the smallest (hash, tie) order; ``wanted`` holds (group, k).

    Counts per hash value decide how much room each hash value has; ranking then runs
    per (group, hash), never over a whole group.
    """
    sizes = df.groupBy(group, hashed).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy(hashed).rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .join(wanted.select(F.col(group).alias("_g"), "k"), F.col(group).eqNullSafe(F.col("_g")))
        .filter(F.col("_before") < F.col("k"))
        .select("_g", F.col(hashed).alias("_h"), (F.col("k") - F.col("_before")).alias("_room"))
    )
    ranked = Window.partitionBy(group, hashed).orderBy(*tie)
    # A NULL group is a group like any other, and so is a NULL hash.
    same = F.col(group).eqNullSafe(F.col("_g")) & F.col(hashed).eqNullSafe(F.col("_h"))
    picked = df.join(plan, same).withColumn("_r", F.row_number().over(ranked))
    return picked.filter(F.col("_r") <= F.col("_room")).drop("_r", "_room", "_g", "_h")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Rows per equal bin between the least and the greatest value (bin, n), the last bin closed.

    NULL and NaN are left out; equal values all fall into bin 0.
    """
    valid = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    low, high = valid.agg(F.min(value)).scalar(), valid.agg(F.max(value)).scalar()
    part = F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0))
    return valid.groupBy(F.least(F.lit(bins - 1), F.floor(part * bins)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
