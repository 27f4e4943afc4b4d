"""Rasters, cubes, job records and vectors derived from the input tables.

Every frame here is a lazy plan over the tables, so its size grows with them.
A raster is a pixel table (y, x, value); one raster is 256 pixels wide and as
high as the keys reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.functions.numeric import intdiv, snap
from swathline.schema import Affine, Header
from swathline.sources.tables import table

WIDTH = 256
TILE = 64
TILES_PER_ROW = 4
AFFINE = Affine(x0=-3.65, a=0.0001, y0=56.75, e=-0.0001)


def _pixel_id() -> Column:
    return F.col("l_orderkey") * 7 + F.col("l_linenumber") - 1


def _yx() -> list[Column]:
    return [intdiv(_pixel_id(), WIDTH).alias("y"), (_pixel_id() % WIDTH).alias("x")]


def tile_of(y: Column | str = "y", x: Column | str = "x") -> Column:
    return intdiv(y, TILE) * TILES_PER_ROW + intdiv(x, TILE)


def empty_land(y: Column | None = None) -> Column:
    """Tile rows that carry no signal at all."""
    return intdiv("y" if y is None else y, TILE) % 4 == 3


def base_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """One row per pixel with the raw level and the loss factor."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(*_yx())
        .agg((F.min("l_extendedprice") / 1000).alias("base"), F.min("l_quantity").alias("q"))
    )


def px(spark: SparkSession, folder: str) -> DataFrame:
    """Both acquisitions side by side: y, x, tile_id, base, q, pre, post."""
    dark = empty_land()
    return base_pixels(spark, folder).select(
        "y",
        "x",
        tile_of().alias("tile_id"),
        "base",
        "q",
        F.when(dark, 0.0).otherwise(F.col("base")).alias("pre"),
        F.when(dark, 0.0).otherwise(F.col("base") * F.col("q") / 50).alias("post"),
    )


def px_otsu(spark: SparkSession, folder: str) -> DataFrame:
    """As px, with weak change in every third tile."""
    weak = F.col("tile_id") % 3 == 1
    dark = empty_land()
    post = F.when(dark, 0.0).when(weak, F.col("base") * (40 + F.col("q") / 5) / 50).otherwise(F.col("post"))
    return px(spark, folder).withColumn("post", post)


def pre_raster(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy(*_yx())
        .agg((F.min("l_extendedprice") / 1000).alias("base"))
        .select("y", "x", F.when(empty_land(), 0.0).otherwise(F.col("base")).alias("value"))
    )


def post_raster(spark: SparkSession, folder: str) -> DataFrame:
    return px(spark, folder).select("y", "x", F.col("post").alias("value"))


def bands(spark: SparkSession, folder: str) -> DataFrame:
    """Two-band raster: band 1 before, band 2 after the event."""
    return px(spark, folder).selectExpr("y", "x", "tile_id", "stack(2, 1, pre, 2, post) as (band, value)")


def height(spark: SparkSession, folder: str) -> Column:
    """Raster height as a scalar subquery over the key columns only."""
    return table(spark, folder, "lineitem").agg(intdiv(F.max(_pixel_id()), WIDTH) + 1).scalar()


def header(spark: SparkSession, folder: str) -> Header:
    return Header(width=WIDTH, height=height(spark, folder), affine=AFFINE)


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """Ground-truth labels; -9999 where the raster has no signal."""
    label = F.when(empty_land(), -9999).when(F.col("q") <= 12, 1).otherwise(0)
    return base_pixels(spark, folder).select("y", "x", label.cast("int").alias("label"))


def cube(spark: SparkSession, folder: str) -> DataFrame:
    """Dated 16 x 16 scenes (t, y, x, value); zero marks nodata."""
    cells = (
        table(spark, folder, "events")
        .groupBy(
            F.to_date("ts").alias("t"),
            (intdiv("user_id", 16) % 16).alias("y"),
            (F.col("user_id") % 16).alias("x"),
        )
        .agg(F.avg("value").alias("mean"))
    )
    hole = (F.col("y") * 16 + F.col("x")) % 7 == 0
    return cells.select("t", "y", "x", F.when(hole, 0.0).otherwise(snap(F.col("mean"), 6)).alias("value"))


def complex_pair(spark: SparkSession, folder: str) -> DataFrame:
    """Two complex images as amplitude and phase."""
    return px(spark, folder).select(
        "y",
        "x",
        F.col("pre").alias("a1"),
        ((F.col("x") % 8) * 0.5).alias("p1"),
        F.col("post").alias("a2"),
        ((F.col("y") % 8) * 0.5).alias("p2"),
    )


def scenes(spark: SparkSession, folder: str) -> DataFrame:
    """Scene catalogue: customers with a non-negative balance, so some jobs have no scene."""
    zx, zy = F.col("c_nationkey") % 5, intdiv("c_nationkey", 5)
    return (
        table(spark, folder, "customer")
        .filter(F.col("c_acctbal") >= 0)
        .select(
            F.col("c_custkey").alias("scene_id"),
            F.col("c_mktsegment").alias("product_type"),
            F.col("c_name").alias("scene_name"),
            (zx * 10).cast("double").alias("x0"),
            (zy * 10).cast("double").alias("y0"),
            (zx * 10 + 10).cast("double").alias("x1"),
            (zy * 10 + 10).cast("double").alias("y1"),
        )
    )


def _engine(priority: Column) -> Column:
    return F.when(priority == "1-URGENT", "SPARK").when(priority == "2-HIGH", "DASK").otherwise("PYSNAP")


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.concat(F.lit("job_"), F.col("o_orderkey").cast("string")).alias("job_name"),
        F.col("o_custkey").alias("scene_id"),
        _engine(F.col("o_orderpriority")).alias("engine"),
        F.when(status == "O", "CREATED").when(status == "P", "QUEUED").otherwise("FINISHED").alias("job_status"),
        F.col("o_orderdate").alias("created_at"),
    )


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Artifact log; the key shift leaves some artifacts without a job."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") + 25).alias("job_id"),
        F.col("l_linenumber").cast("bigint").alias("artifact_no"),
        F.floor("l_extendedprice").alias("file_size_bytes"),
        F.col("l_quantity").alias("preprocessing_seconds"),
        (F.col("l_discount") * 100).alias("upload_seconds"),
        (F.col("l_tax") * 100).alias("conversion_seconds"),
        F.col("l_shipdate").alias("created_at"),
    )


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("scene_id"),
        _engine(F.col("o_orderpriority")).alias("engine"),
        snap(F.col("o_totalprice") / 1000, 2).alias("duration"),
        F.when(F.col("o_orderstatus").isin("O", "P"), "SUCCESS").otherwise("ERROR").alias("status"),
    )


def zones(spark: SparkSession, folder: str) -> DataFrame:
    """Square zones of side 10 with their WKT text."""
    zx, zy = (F.col("n_nationkey") % 5) * 10, intdiv("n_nationkey", 5) * 10

    def corner(dx, dy):
        return F.concat_ws(" ", (zx + dx).cast("string"), (zy + dy).cast("string"))

    ring = F.concat_ws(", ", corner(0, 0), corner(10, 0), corner(10, 10), corner(0, 10), corner(0, 0))
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("zone_id"),
        F.col("n_name").alias("zone_name"),
        F.concat(F.lit("POLYGON(("), ring, F.lit("))")).alias("wkt"),
    )


def points(spark: SparkSession, folder: str, source: str = "customer") -> DataFrame:
    """Point layer on whole coordinates, so some points lie on zone edges."""
    key = {"customer": "c_custkey", "supplier": "s_suppkey"}[source]
    return table(spark, folder, source).select(
        F.col(key).alias("point_id"),
        (F.col(key) % 50).cast("double").alias("px"),
        (intdiv(key, 50) % 50).cast("double").alias("py"),
    )


def storage(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """File sizes per job in the two formats; each side misses some jobs."""
    orders = table(spark, folder, "orders")
    tif = orders.filter(F.col("o_orderpriority") != "4-NOT SPECIFIED").select(
        F.col("o_orderkey").alias("job_id"), F.floor("o_totalprice").alias("tif_bytes")
    )
    chunked = orders.filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("job_id"), F.floor(F.col("o_totalprice") * 0.7).alias("zarr_bytes")
    )
    return tif, chunked
