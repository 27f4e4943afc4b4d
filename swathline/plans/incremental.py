"""Streaming jobs and user functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from swathline.functions.numeric import snap, snap_sql
from swathline.operators import apply, catalog
from swathline.plans.fragments import sql
from swathline.plans.registry import query
from swathline.session import scratch_path
from swathline.sources import fixtures
from swathline.streaming import jobs as stream


@query(
    "stream_append_ingest",
    "SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def stream_append_ingest(spark, folder):
    """Event files ingested in bounded batches into a partitioned table."""
    rows = stream.stream_table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )
    out = scratch_path(spark, "stream-append")
    stream.append_ingest(rows, out, scratch_path(spark, "stream-append-log"), "event_type")
    return spark.read.parquet(out).select("event_id", "user_id", "event_type", "value", "k")


@query(
    "stream_upsert_catalog",
    sql(
        """SELECT job_id, CASE WHEN engine = 'SPARK' THEN 'FINISHED' ELSE job_status END AS job_status,
             CASE WHEN engine = 'SPARK' THEN 'stream' ELSE 'old' END AS origin
           FROM jobs WHERE engine = 'SPARK' OR job_status = 'CREATED'""",
        "jobs",
    ),
)
def stream_upsert_catalog(spark, folder):
    """Each batch of results is merged into the stored catalogue."""
    path = scratch_path(spark, "catalog")
    created = fixtures.jobs(spark, folder).filter(F.col("job_status") == "CREATED")
    old = created.select("job_id", "job_status", F.lit("old").alias("origin"))
    catalog.create_keyed_table(old, path, ["job_id"])

    def shape(batch):
        urgent = batch.filter(F.col("o_orderpriority") == "1-URGENT")
        return urgent.select(
            F.col("o_orderkey").alias("job_id"), F.lit("FINISHED").alias("job_status"), F.lit("stream").alias("origin")
        )

    stream.upsert_stream(
        stream.stream_table(spark, folder, "orders"), path, scratch_path(spark, "catalog-log"), ["job_id"], shape
    )
    return spark.read.parquet(path).select("job_id", "job_status", "origin")


@query(
    "stream_daily_mean",
    f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {snap_sql('avg(value)', 6)} AS mean_value, count(*) AS n FROM events
        WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1""",
)
def stream_daily_mean(spark, folder):
    """Daily means closed by the watermark of one day."""
    out = scratch_path(spark, "stream-daily")
    stream.daily_mean(stream.stream_table(spark, folder, "events"), out, scratch_path(spark, "stream-daily-log"))
    return spark.read.parquet(out).select("day", snap(F.col("mean_value"), 6).alias("mean_value"), "n")


def count_flooded(cells: pd.DataFrame) -> int:
    """Flooded pixels of one tile with NumPy."""
    pre = 10 * np.log10(np.maximum(cells["pre"].to_numpy(), 1e-6))
    post = 10 * np.log10(np.maximum(cells["post"].to_numpy(), 1e-6))
    return int(np.sum(post - pre < -5.5))


def count_flooded_or_fail(cells: pd.DataFrame) -> int:
    if cells["pre"].max() <= 0:
        raise ValueError("no signal in tile")
    return count_flooded(cells)


def _cells(spark, folder):
    return fixtures.px(spark, folder).select("tile_id", "pre", "post")


@query(
    "tile_apply",
    sql("SELECT tile_id, CAST(sum(mask) AS BIGINT) AS pixel_count, 'SUCCESS' AS status FROM fl GROUP BY tile_id", "fl"),
)
def tile_apply(spark, folder):
    return apply.tile_apply(_cells(spark, folder), count_flooded).select("tile_id", "pixel_count", "status")


@query(
    "tile_apply_errors",
    sql(
        """SELECT tile_id, CASE WHEN max(pre) > 0 THEN CAST(sum(mask) AS BIGINT) ELSE 0 END AS pixel_count,
             CASE WHEN max(pre) > 0 THEN 'SUCCESS' ELSE 'ERROR: no signal in tile' END AS status FROM fl GROUP BY tile_id""",
        "fl",
    ),
)
def tile_apply_errors(spark, folder):
    """A failing tile reports an ERROR row and the job goes on."""
    return apply.tile_apply(_cells(spark, folder), count_flooded_or_fail).select("tile_id", "pixel_count", "status")


def ratio_rows(batch: pd.DataFrame) -> pd.DataFrame:
    ratio = np.divide(batch["post"], batch["pre"], out=np.full(len(batch), -1.0), where=batch["pre"].to_numpy() > 0)
    return pd.DataFrame({"y": batch["y"], "x": batch["x"], "ratio": ratio})


@query(
    "partition_apply",
    sql(f"SELECT y, x, {snap_sql('CASE WHEN pre > 0 THEN post/pre ELSE -1 END', 6)} AS ratio FROM px", "px"),
)
def partition_apply(spark, folder):
    rows = apply.partition_apply(
        fixtures.px(spark, folder).select("y", "x", "pre", "post"), ratio_rows, "y bigint, x bigint, ratio double"
    )
    return rows.withColumn("ratio", snap(F.col("ratio"), 6))
