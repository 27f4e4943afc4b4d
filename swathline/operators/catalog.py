"""Catalogue and job bookkeeping: upsert, schema alignment, queue, artifacts, keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathline.functions.ranking import rank_in_group
from swathline.session import cut_lineage


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Matched rows take the source, new rows are inserted, the rest stays.

    A repeated source key raises. The check numbers rows per key on the exchange and
    sort that the join needs anyway.
    """
    values = [c for c in target.columns if c not in keys]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    single = F.when(number == 1, F.lit(True)).otherwise(
        F.raise_error(F.lit("upsert source holds a key twice")).cast("boolean")
    )
    src = source.select(*keys, F.struct(*values).alias("s"), single.alias("has_s"))
    tgt = target.select(*keys, F.struct(*values).alias("t"))
    merged = tgt.join(src, keys, "full")
    return merged.select(
        *keys, *[F.when(F.col("has_s"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in values]
    ).select(*target.columns)


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create_keyed_table(df: DataFrame, path: str, keys: list[str], buckets: int = 16) -> None:
    """A Parquet table laid out by key bucket, the target of ``upsert_table``."""
    with_bucket = df.withColumn("bucket", _bucket(keys, buckets))
    with_bucket.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)


def upsert_table(spark: SparkSession, path: str, source: DataFrame, keys: list[str], buckets: int = 16) -> None:
    """Upsert into a keyed table: only buckets that receive source keys are rewritten.

    The merged buckets are stored aside before the overwrite, so a lost executor or a
    repeated batch leads to the same table.
    """
    incoming = cut_lineage(source.withColumn("bucket", _bucket(keys, buckets)))
    touched = [r.bucket for r in incoming.select("bucket").distinct().collect()]  # at most ``buckets`` rows
    if not touched:
        return
    current = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).select(*incoming.columns)
    merged = cut_lineage(merge_upsert(current, incoming, [*keys, "bucket"]))
    (
        merged.hint("rebalance", "bucket")
        .write.partitionBy("bucket")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def align_schema(source: DataFrame, target: T.StructType) -> DataFrame:
    """Target columns in target order, absent ones as typed NULL, new source columns last."""
    have = set(source.columns)
    first = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields
    ]
    extra = [c for c in source.columns if c not in target.fieldNames()]
    return source.select(*first, *extra)


def append_or_create(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Append to a partitioned table, creating it on first use."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def pending_jobs(
    jobs: DataFrame, scenes: DataFrame, engine: str, base: str = "/data", store: str = "/store"
) -> DataFrame:
    """Payload of the jobs waiting for one engine, with their input and output paths."""
    waiting = jobs.filter(F.col("job_status").isin("CREATED", "QUEUED") & (F.col("engine") == engine))
    task = F.concat(F.col("scene_name"), F.lit("_task_"), F.col("job_id").cast("string"))
    return waiting.join(scenes.select("scene_id", "scene_name"), "scene_id").select(
        "job_id",
        "job_name",
        "scene_id",
        F.concat(F.lit(f"{base}/INPUT/"), F.col("scene_name")).alias("local_path"),
        F.concat(F.lit(f"{base}/INPUT/"), task, F.lit("_output.tif")).alias("output_tiff"),
        F.format_string(f"{store}/%d/%d_tile.tif", F.col("job_id"), F.col("job_id")).alias("hdfs_output_path"),
    )


def artifact_rows(results: DataFrame, engine: str) -> DataFrame:
    """Finished results as typed artifact rows."""
    return results.select(
        F.col("job_id").cast("bigint").alias("job_id"),
        F.col("scene_id").cast("bigint").alias("scene_id"),
        F.lit("PREPROCESSED_TILE").cast("string").alias("artifact_type"),
        F.lit("TIFF").cast("string").alias("file_format"),
        F.col("path").alias("hdfs_path"),
        F.lit(engine).cast("string").alias("local_path"),
        F.col("file_size_bytes").cast("bigint").alias("file_size_bytes"),
        F.col("preprocessing_seconds").cast("double").alias("preprocessing_seconds"),
        F.col("upload_seconds").cast("double").alias("hdfs_upload_seconds"),
        F.col("conversion_seconds").cast("double").alias("zarr_conversion_seconds"),
        (F.col("preprocessing_seconds") + F.col("upload_seconds") + F.col("conversion_seconds"))
        .cast("double")
        .alias("pipeline_seconds"),
    )


def next_ids(log: DataFrame, rows: DataFrame, order: str, id_col: str = "artifact_id") -> DataFrame:
    """Rows with ids that continue after the log's highest id, in ``order``.

    Ids come from exact counts per key range, so no task numbers the whole batch.
    """
    start = log.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    numbered = rank_in_group(rows.withColumn("_all", F.lit(1)), "_all", order)
    return numbered.withColumn(id_col, start + F.col("rank") + 1).drop("rank", "_all")


def set_status(jobs: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """New status for the jobs named in ``updates`` (job_id, new_status); repeats count once.

    The last update in ``order`` holds. Without an order, updates that name two statuses for a job raise.
    """
    if order:
        last = F.max_by("new_status", order)
    else:
        unlike = F.raise_error(F.lit("a job has two new statuses; name the column that orders them")).cast("string")
        last = F.when(F.min("new_status") == F.max("new_status"), F.max("new_status")).when(F.count("new_status") > 0, unlike)
    once = updates.groupBy("job_id").agg(last.alias("new_status"))
    return jobs.join(once, "job_id", "left").withColumn(
        "job_status", F.coalesce("new_status", "job_status")
    ).drop("new_status")


def cancel_created(jobs: DataFrame) -> DataFrame:
    status = F.col("job_status")
    return jobs.withColumn("job_status", F.when(status == "CREATED", "CANCELLED").otherwise(status))


def enqueue(areas: DataFrame, engines: list[str], existing: DataFrame) -> DataFrame:
    """One CREATED job per area and engine that is not queued yet."""
    wanted = areas.withColumn("engine", F.explode(F.array(*[F.lit(e) for e in engines])))
    return wanted.join(existing.select("scene_id", "engine").distinct(), ["scene_id", "engine"], "left_anti").withColumn(
        "job_status", F.lit("CREATED")
    )


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key).distinct(), key, "left_anti")


def cascade(child: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Child rows left after the parents in ``removed`` are deleted."""
    return child.join(removed.select(key).distinct(), key, "left_anti")


def unique_names(df: DataFrame, name: str, key: str) -> DataFrame:
    """Repeated names get the suffix _1, _2, ... in key order; the first keeps its name."""
    ranked = rank_in_group(df, name, key)
    suffix = F.concat(F.col(name), F.lit("_"), F.col("rank").cast("string"))
    return ranked.withColumn("unique_name", F.when(F.col("rank") == 0, F.col(name)).otherwise(suffix)).drop("rank")


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row per key, as a combined aggregate instead of a ranked window."""
    rest = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order) if len(order) > 1 else F.col(order[0]))
    return df.groupBy(key).agg(newest.alias("r")).select(key, "r.*")


def dedupe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order) if len(order) > 1 else F.col(order[0])).alias("r")).select(*keys, "r.*")


