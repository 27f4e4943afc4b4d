"""Per-tile adaptive thresholds (Otsu 1979) and the detection that uses them.

All steps after the first share one hash partitioning by tile: tile range, the
256-bin histogram and the class statistics. A tile has a fixed pixel bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathline.functions.radiometry import change_db
from swathline.schema import FLOOD_THRESHOLD_DB, OTSU_ACCEPT_BELOW_DB, OTSU_BINS


def histograms(pairs: DataFrame, bins: int = OTSU_BINS, fixed: float = FLOOD_THRESHOLD_DB) -> DataFrame:
    """Histogram of the dB change per tile (pairs: tile_id, pre, post).

    Besides the bin count it keeps how many pixels lie under the bin centre and under
    the fixed threshold, so that any threshold can be counted without the pixels.
    """
    tile = Window.partitionBy("tile_id")
    diffs = pairs.select("tile_id", "pre", change_db(F.col("pre"), F.col("post")).alias("d"))
    diffs = diffs.withColumn("d", F.when(~F.isnan("d"), F.col("d")))
    ranged = diffs.withColumns({"lo": F.min("d").over(tile), "hi": F.max("d").over(tile)})
    spread = F.col("hi") - F.col("lo")
    share = F.try_divide(F.col("d") - F.col("lo"), spread)
    bin_no = F.when(F.col("d").isNull(), None).otherwise(
        F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0))
    )
    centre = F.col("lo") + (F.col("bin") + F.lit(0.5)) * spread / bins
    return (
        ranged.withColumn("bin", bin_no.cast("int"))
        .withColumn("centre", centre)
        .groupBy("tile_id", "bin")
        .agg(
            F.count("d").alias("n"),
            F.max("pre").alias("max_pre"),
            F.first("centre").alias("centre"),
            F.first("lo").alias("lo"),
            F.first("hi").alias("hi"),
            F.sum(F.when(F.col("d") < F.col("centre"), 1).otherwise(0)).alias("n_under"),
            F.sum(F.when(F.col("d") < fixed, 1).otherwise(0)).alias("n_fixed"),
        )
    )


def thresholds(hist: DataFrame, bins: int = OTSU_BINS) -> DataFrame:
    """Per tile: threshold, pixels under it, pixels under the fixed threshold.

    The two class means are taken over filled bins; an empty bin repeats the split
    before it, so the first maximum over filled bins is the first maximum overall.
    """
    up = Window.partitionBy("tile_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rest = Window.partitionBy("tile_id").orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("tile_id")
    split = (
        hist.withColumn("f", F.try_divide(F.col("n"), F.sum("n").over(whole)))
        .withColumns(
            {
                "w1": F.sum("f").over(up),
                "w2": F.sum("f").over(rest),
                "s1": F.sum(F.col("f") * F.col("centre")).over(up),
                "s2": F.sum(F.col("f") * F.col("centre")).over(rest),
                "n_le": F.sum("n").over(up),
            }
        )
        .withColumn("gap", F.try_divide(F.col("s1"), F.col("w1")) - F.try_divide(F.col("s2"), F.col("w2")))
        .withColumn("score", F.round(F.col("w1") * F.col("w2") * F.col("gap") * F.col("gap"), 9))
    )
    best = F.max_by(
        F.struct("centre", (F.col("n_le") - F.col("n") + F.col("n_under")).alias("under")),
        F.struct(F.col("score"), -F.col("bin")),
    )
    flat = F.col("lo") == F.col("hi")
    return (
        split.groupBy("tile_id")
        .agg(
            F.max("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.max("max_pre").alias("max_pre"),
            F.sum("n_fixed").alias("n_fixed"),
            F.sum("n").alias("n"),
            best.alias("best"),
        )
        .select(
            "tile_id",
            "n",
            "max_pre",
            "n_fixed",
            F.when(flat, F.col("lo")).otherwise(F.col("best.centre")).alias("threshold"),
            F.when(flat, F.lit(0)).otherwise(F.col("best.under")).cast("bigint").alias("n_under"),
        )
    )


def flood_tiles(limits: DataFrame, mask_root: str = "masks", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adaptive detection per tile from the threshold table; ``keys`` are kept, and part of the mask's path."""
    accepted = F.col("threshold") < OTSU_ACCEPT_BELOW_DB
    status = (
        F.when(F.col("max_pre") <= 0, "EMPTY_OR_NODATA")
        .when(F.col("threshold").isNull(), "SUCCESS_FIXED")
        .when(accepted, "SUCCESS_OTSU")
        .otherwise("SUCCESS_FALLBACK")
    )
    count = (
        F.when(F.col("status") == "EMPTY_OR_NODATA", F.lit(0))
        .when(F.col("status") == "SUCCESS_OTSU", F.col("n_under"))
        .otherwise(F.col("n_fixed"))
    )
    used = F.when(F.col("status") == "SUCCESS_OTSU", F.col("threshold")).when(
        F.col("status") != "EMPTY_OR_NODATA", F.lit(FLOOD_THRESHOLD_DB)
    )
    parts = [F.concat(F.lit(f"/{k}="), F.col(k).cast("string")) for k in (*keys, "tile_id")]
    path = F.concat(F.lit(mask_root), *parts)
    return (
        limits.withColumn("status", status)
        .withColumn("pixel_count", count.cast("bigint"))
        .select(
            *keys,
            "tile_id",
            "pixel_count",
            "status",
            used.alias("threshold"),
            F.when(F.col("pixel_count") > 0, path).alias("mask_path"),
        )
    )
