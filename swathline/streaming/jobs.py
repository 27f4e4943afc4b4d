"""Incremental jobs: append ingest, catalogue upsert, daily means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.operators.catalog import upsert_table
from swathline.sources.tables import table


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 50) -> DataFrame:
    """A table, one file or a folder of part files, as a file stream with a bounded number of files per batch."""
    schema = table(spark, folder, name).schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{folder}/{{{name}}}.parquet")  # as a pattern it may name a file as well as a folder
    )


def _finish(query) -> None:
    """Wait for an available-now query, however long its input takes."""
    try:
        query.awaitTermination()
    finally:
        query.stop()


def append_ingest(stream: DataFrame, out: str, checkpoint: str, partition_by: str) -> None:
    _finish(
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .partitionBy(partition_by)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )


def upsert_stream(stream: DataFrame, table_path: str, checkpoint: str, keys: list[str], shape) -> None:
    """Each batch is shaped to catalogue rows and upserted; a repeated batch changes nothing."""

    def apply(batch: DataFrame, _epoch: int) -> None:
        upsert_table(batch.sparkSession, table_path, shape(batch), keys)

    _finish(
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def daily_mean(stream: DataFrame, out: str, checkpoint: str, delay: str = "1 day") -> None:
    """Mean value per day, emitted once the watermark has passed the end of the day."""
    # Event time without a zone is read as UTC, whatever the session zone is.
    since_epoch = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    start_day = F.floor(F.unix_seconds("window.start") / 86400).cast("int")
    days = (
        stream.withColumn("ts", F.timestamp_micros(since_epoch))
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day"))
        .agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))
        .select(F.date_add(F.lit("1970-01-01").cast("date"), start_day).cast("string").alias("day"), "mean_value", "n")
    )
    _finish(
        days.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
