"""Cubes, band statistics and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.functions.numeric import percent, snap, snap_sql
from swathline.functions.radiometry import amplitude_db
from swathline.functions.ranking import exact_percentiles, histogram
from swathline.operators import change, cube
from swathline.plans.fragments import sql
from swathline.plans.registry import query
from swathline.sources import fixtures, raster

TILE, WIDTH = fixtures.TILE, fixtures.WIDTH


@query(
    "aoi_mean_per_time",
    sql(
        f"""SELECT CAST(t AS VARCHAR) AS t, {snap_sql('avg(db)', 6)} AS mean_db, count(db) AS valid, count(*) AS cells
            FROM cdb WHERE y < 14 AND x >= 1 AND x < 15 GROUP BY t""",
        "cdb",
    ),
)
def aoi_mean_per_time(spark, folder):
    aoi = raster.window_scan(fixtures.cube(spark, folder), y0=0, x0=1, h=14, w=14)
    means = cube.mean_per_time(aoi)
    return means.select(F.col("t").cast("string").alias("t"), snap(F.col("mean_db"), 6).alias("mean_db"), "valid", "cells")


@query(
    "pixel_mean_over_time",
    sql(f"SELECT y, x, {snap_sql('avg(db)', 6)} AS mean_db, count(db) AS valid FROM cdb GROUP BY y, x", "cdb"),
)
def pixel_mean_over_time(spark, folder):
    return cube.mean_per_pixel(fixtures.cube(spark, folder)).withColumn("mean_db", snap(F.col("mean_db"), 6))


@query(
    "cube_mean",
    sql(f"SELECT {snap_sql('avg(value)', 6)} AS mean_value, {snap_sql('avg(db)', 6)} AS mean_db, count(*) AS cells FROM cdb", "cdb"),
)
def cube_mean(spark, folder):
    return cube.to_db(fixtures.cube(spark, folder)).agg(
        snap(F.avg("value"), 6).alias("mean_value"), snap(F.avg("db"), 6).alias("mean_db"), F.count("*").alias("cells")
    )


@query("valid_pixels", sql("SELECT CAST(t AS VARCHAR) AS t, y, x, db IS NOT NULL AS valid FROM cdb", "cdb"))
def valid_pixels(spark, folder):
    db = cube.to_db(fixtures.cube(spark, folder))
    return db.select(F.col("t").cast("string").alias("t"), "y", "x", F.col("db").isNotNull().alias("valid"))


@query(
    "pixel_timeseries",
    sql(
        f"""SELECT y, x, CAST(t AS VARCHAR) AS t, {snap_sql('db', 6)} AS db,
              CAST(lag(t) OVER (PARTITION BY y, x ORDER BY t) AS VARCHAR) AS prev_t,
              row_number() OVER (PARTITION BY y, x ORDER BY t) AS step FROM cdb""",
        "cdb",
    ),
)
def pixel_timeseries(spark, folder):
    from pyspark.sql import Window

    line = cube.series(fixtures.cube(spark, folder))
    step = F.row_number().over(Window.partitionBy("y", "x").orderBy("t")).cast("bigint")
    return line.withColumn("step", step).select(
        "y", "x", F.col("t").cast("string").alias("t"), snap(F.col("db"), 6).alias("db"),
        F.col("prev_t").cast("string").alias("prev_t"), "step",
    )


@query(
    "pixel_change",
    sql(
        f"""SELECT y, x, CAST(t AS VARCHAR) AS t, {snap_sql('db - p', 6)} AS change_db FROM (
              SELECT *, lag(db) OVER (PARTITION BY y, x ORDER BY t) AS p FROM cdb) s WHERE p IS NOT NULL AND db IS NOT NULL""",
        "cdb",
    ),
)
def pixel_change(spark, folder):
    line = cube.series(fixtures.cube(spark, folder)).filter(F.col("change_db").isNotNull())
    return line.select("y", "x", F.col("t").cast("string").alias("t"), snap(F.col("change_db"), 6).alias("change_db"))


def _coarse(spark, folder):
    """The post raster at half resolution and its axes (first coordinate, step, count)."""
    source = raster.overview(fixtures.post_raster(spark, folder), 2).select("y", "x", "value")
    rows = F.ceil(fixtures.height(spark, folder) / 2)
    return source, (0.0, 2.0, rows), (0.0, 2.0, WIDTH // 2)


_COARSE = """co AS (SELECT y//2 AS y, x//2 AS x, avg(post) AS value FROM px GROUP BY 1, 2),
  rn AS (SELECT p.y, p.x, co.value FROM px p CROSS JOIN hd
         LEFT JOIN co ON co.y = least((height + 1)//2 - 1, (p.y + 1)//2) AND co.x = least(127, (p.x + 1)//2))"""


@query("reindex_nearest", sql(f"WITH {_COARSE} SELECT y, x, {snap_sql('value', 6)} AS value FROM rn", "px", "hd"))
def reindex_nearest(spark, folder):
    """A half-resolution scene on the full grid; odd coordinates are ties and go up."""
    source, ys, xs = _coarse(spark, folder)
    grid = fixtures.pre_raster(spark, folder).select("y", "x", F.col("y").cast("double").alias("yc"), F.col("x").cast("double").alias("xc"))
    return cube.reindex_nearest(source, grid, ys, xs).select("y", "x", snap(F.col("value"), 6).alias("value"))


@query(
    "build_cube",
    sql(
        f"""WITH {_COARSE}, c AS (SELECT '2025-05-21' AS t, y, x, pre AS value FROM px
              UNION ALL SELECT '2025-06-02', y, x, post FROM px
              UNION ALL SELECT '2025-06-14', y, x, value FROM rn
              UNION ALL SELECT '2025-06-26', y, x, base FROM px)
            SELECT t, count(*) AS cells, {snap_sql('avg(10*log10(nullif(value, 0)))', 6)} AS mean_db,
              count(nullif(value, 0)) AS valid FROM c GROUP BY t""",
        "px",
        "hd",
    ),
)
def build_cube(spark, folder):
    """Four dated scenes on the grid of the first, one of them resampled."""
    source, ys, xs = _coarse(spark, folder)
    first = fixtures.pre_raster(spark, folder)
    grid = first.select("y", "x", F.col("y").cast("double").alias("yc"), F.col("x").cast("double").alias("xc"))
    scenes = {
        "2025-05-21": first,
        "2025-06-02": fixtures.post_raster(spark, folder),
        "2025-06-14": cube.reindex_nearest(source, grid, ys, xs),
        "2025-06-26": fixtures.base_pixels(spark, folder).select("y", "x", F.col("base").alias("value")),
    }
    means = cube.mean_per_time(cube.stack(scenes))
    return means.select(F.col("t").cast("string").alias("t"), "cells", snap(F.col("mean_db"), 6).alias("mean_db"), "valid")


@query(
    "reproject_match",
    sql(
        f"""SELECT p.y - dy AS y, x - dx AS x, {snap_sql('avg(pre)', 6)} AS value, count(*) AS n
            FROM px p, (SELECT 0 AS dy UNION ALL SELECT 1) a, (SELECT 0 AS dx UNION ALL SELECT 1) b, hd
            WHERE p.y - dy >= 0 AND x - dx >= 0 GROUP BY 1, 2""",
        "px",
        "hd",
    ),
)
def reproject_match(spark, folder):
    """Bilinear values on a grid shifted by half a pixel on both axes."""
    pixels = fixtures.pre_raster(spark, folder)
    moved = cube.reproject_bilinear(pixels, 1.0, 0.5, fixtures.height(spark, folder), WIDTH)
    return moved.withColumn("value", snap(F.col("value"), 6))


@query(
    "band_stats",
    sql(
        f"""SELECT band, min(value) AS low, max(value) AS high, {snap_sql('avg(value)', 5)} AS mean,
              {snap_sql('stddev_pop(value)', 5)} AS std, count(*) AS n, {snap_sql('sum(value)', 3)} AS total
            FROM bands GROUP BY band""",
        "bands",
    ),
)
def band_stats(spark, folder):
    return fixtures.bands(spark, folder).groupBy("band").agg(
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        snap(F.avg("value"), 5).alias("mean"),
        snap(F.stddev_pop("value"), 5).alias("std"),
        F.count("*").alias("n"),
        snap(F.sum("value"), 3).alias("total"),
    )


@query(
    "flood_percent",
    sql(
        f"""SELECT CAST(sum(mask) AS BIGINT) AS flooded, CAST(sum(1 - mask) AS BIGINT) AS dry,
              {snap_sql('sum(mask)*100.0::DOUBLE/count(*)', 6)} AS flooded_percent,
              {snap_sql('100 - sum(mask)*100.0::DOUBLE/count(*)', 6)} AS dry_percent FROM fl""",
        "fl",
    ),
)
def flood_percent(spark, folder):
    pairs = change.with_change(
        change.align(fixtures.pre_raster(spark, folder), fixtures.post_raster(spark, folder), how="inner")
    )
    share = percent(F.sum("mask"), F.count("*"))
    return pairs.agg(
        F.sum("mask").alias("flooded"),
        F.sum(1 - F.col("mask")).alias("dry"),
        snap(share, 6).alias("flooded_percent"),
        snap(100 - share, 6).alias("dry_percent"),
    )


@query(
    "robust_scale",
    sql(
        f"""SELECT y, x, {snap_sql('(least(greatest(db, p2), p98) - p2)/(p98 - p2)', 6)} AS scaled
            FROM (SELECT y, x, 20*log10(nullif(pre, 0) + 1e-6) AS db FROM px) d,
              (SELECT quantile_cont(20*log10(nullif(pre, 0) + 1e-6), 0.02) AS p2,
                      quantile_cont(20*log10(nullif(pre, 0) + 1e-6), 0.98) AS p98 FROM px) p
            WHERE db IS NOT NULL""",
        "px",
    ),
)
def robust_scale(spark, folder):
    """Amplitude in dB stretched between its 2nd and 98th percentile."""
    db = amplitude_db(F.nullif(F.col("value"), F.lit(0.0)))
    shown = fixtures.pre_raster(spark, folder).select("y", "x", db.alias("db")).filter(F.col("db").isNotNull())
    bounds = exact_percentiles(shown, "db", [0.02, 0.98])
    low, high = bounds.select("p0").scalar(), bounds.select("p1").scalar()
    clipped = F.least(F.greatest(F.col("db"), low), high)
    return shown.select("y", "x", snap(F.try_divide(clipped - low, high - low), 6).alias("scaled"))


@query(
    "band_histogram",
    sql(
        """SELECT CAST(least(199, floor((pre - lo)/(hi - lo)*200)) AS BIGINT) AS bin, count(*) AS n
           FROM px, (SELECT min(pre) AS lo, max(pre) AS hi FROM px WHERE pre > 0) r WHERE pre > 0 GROUP BY 1""",
        "px",
    ),
)
def band_histogram(spark, folder):
    """200 equal bins over the positive values."""
    return histogram(fixtures.pre_raster(spark, folder).filter(F.col("value") > 0), "value", 200)


@query("class_counts", sql("SELECT label, count(*) AS n FROM tr GROUP BY label", "tr"))
def class_counts(spark, folder):
    return fixtures.truth(spark, folder).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "nodata_counts",
    sql(
        """SELECT band, count(*) AS cells, CAST(sum(CASE WHEN value = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero,
             CAST(max(height)*256 - count(*) AS BIGINT) AS missing FROM bands, hd GROUP BY band""",
        "bands",
        "hd",
    ),
)
def nodata_counts(spark, folder):
    return fixtures.bands(spark, folder).groupBy("band").agg(
        F.count("*").alias("cells"),
        F.sum(F.when(F.col("value") == 0, 1).otherwise(0)).alias("zero"),
        ((F.max("y") + 1) * WIDTH - F.count("*")).alias("missing"),
    )


@query(
    "total_bounds",
    sql(
        """SELECT product_type, CAST(min(x0) AS DOUBLE) AS x0, CAST(min(y0) AS DOUBLE) AS y0, CAST(max(x1) AS DOUBLE) AS x1,
             CAST(max(y1) AS DOUBLE) AS y1 FROM scenes GROUP BY product_type""",
        "scenes",
    ),
)
def total_bounds(spark, folder):
    return fixtures.scenes(spark, folder).groupBy("product_type").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
