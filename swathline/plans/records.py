"""Job queue, artifacts, catalogue upserts and storage reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.functions.numeric import percent, snap, snap_sql
from swathline.operators import catalog, change
from swathline.plans.fragments import sql
from swathline.plans.registry import query
from swathline.session import scratch_path
from swathline.sources import fixtures, raster
from swathline.sources.tables import table


@query(
    "pending_jobs",
    sql(
        """SELECT job_id, job_name, scene_id, '/data/INPUT/' || scene_name AS local_path,
             '/data/INPUT/' || scene_name || '_task_' || job_id || '_output.tif' AS output_tiff,
             '/store/' || job_id || '/' || job_id || '_tile.tif' AS hdfs_output_path
           FROM jobs JOIN scenes USING (scene_id) WHERE job_status IN ('CREATED', 'QUEUED') AND engine = 'SPARK'""",
        "jobs",
        "scenes",
    ),
)
def pending_jobs(spark, folder):
    return catalog.pending_jobs(fixtures.jobs(spark, folder), fixtures.scenes(spark, folder), "SPARK")


@query(
    "jobs_by_id",
    sql("SELECT job_id, engine, job_status FROM jobs WHERE job_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)", "jobs"),
)
def jobs_by_id(spark, folder):
    """Jobs named by a list of ids; a list of any length is a semi join."""
    wanted = table(spark, folder, "lineitem").filter(F.col("l_quantity") >= 49).select(F.col("l_orderkey").alias("job_id")).distinct()
    return fixtures.jobs(spark, folder).join(wanted, "job_id", "left_semi").select("job_id", "engine", "job_status")


@query(
    "pending_files",
    "SELECT doc_id AS file_id, source AS file_group FROM documents WHERE lang <> 'fr' AND n_chars > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)",
)
def pending_files(spark, folder):
    """Active files that no result covers yet."""
    active = table(spark, folder, "documents").filter((F.col("lang") != "fr") & (F.col("n_chars") > 0))
    done = table(spark, folder, "labels").select("doc_id").distinct()
    return active.join(done, "doc_id", "left_anti").select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("file_group")
    )


@query(
    "split_status",
    sql(
        f"""SELECT 'done' AS part, engine, count(*) AS n, {snap_sql('sum(duration)', 2)} AS seconds FROM runs WHERE status = 'SUCCESS' GROUP BY engine
            UNION ALL SELECT 'failed', engine, count(*), {snap_sql('sum(duration)', 2)} FROM runs WHERE status <> 'SUCCESS' GROUP BY engine""",
        "runs",
    ),
)
def split_status(spark, folder):
    runs = fixtures.run_log(spark, folder)
    done = runs.filter(F.col("status") == "SUCCESS").withColumn("part", F.lit("done"))
    failed = runs.filter(F.col("status") != "SUCCESS").withColumn("part", F.lit("failed"))
    return done.unionByName(failed).groupBy("part", "engine").agg(
        F.count("*").alias("n"), snap(F.sum("duration"), 2).alias("seconds")
    )



def _catalogs(spark, folder):
    """Old catalogue: western tiles; new batch: eastern tiles, counts one higher."""
    pairs = change.with_change(
        change.align(fixtures.pre_raster(spark, folder), fixtures.post_raster(spark, folder), how="inner")
    )
    stats = pairs.groupBy(fixtures.tile_of().alias("tile_id")).agg(
        F.sum("mask").cast("bigint").alias("pixel_count"), F.max("x").alias("edge")
    )
    old = stats.filter(F.col("edge") < 160).select("tile_id", "pixel_count", F.lit("OLD").alias("status"))
    new = stats.filter(F.col("edge") >= 100).select(
        "tile_id", (F.col("pixel_count") + 1).alias("pixel_count"), F.lit("NEW").alias("status")
    )
    return old, new


_UPSERT_SQL = sql(
    """SELECT tile_id, CASE WHEN edge >= 100 THEN n + 1 ELSE n END AS pixel_count,
         CASE WHEN edge >= 100 THEN 'NEW' ELSE 'OLD' END AS status
       FROM (SELECT tile_id, CAST(sum(mask) AS BIGINT) AS n, max(x) AS edge FROM fl GROUP BY tile_id) s""",
    "fl",
)


@query("merge_upsert", _UPSERT_SQL)
def merge_upsert(spark, folder):
    """Old catalogue covers the western tiles, the batch the eastern ones; some overlap."""
    old, new = _catalogs(spark, folder)
    return catalog.merge_upsert(old, new, ["tile_id"])


@query(
    "merge_upsert_two_keys",
    """SELECT coalesce(a.id, b.id) AS id, coalesce(a.match_id, b.match_id) AS match_id, coalesce(b.total, a.total) AS total,
         CASE WHEN b.id IS NULL THEN 'old' ELSE 'new' END AS origin
       FROM (SELECT l_linenumber AS id, l_orderkey AS match_id, max(l_quantity) AS total FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2) a
       FULL JOIN (SELECT l_linenumber AS id, l_orderkey AS match_id, max(l_extendedprice) AS total FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2) b
         ON a.id = b.id AND a.match_id = b.match_id""",
)
def merge_upsert_two_keys(spark, folder):
    li = table(spark, folder, "lineitem")
    keys = [F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("match_id")]
    target = (
        li.filter(F.col("l_returnflag") != "A").groupBy(*keys).agg(F.max("l_quantity").alias("total")).withColumn("origin", F.lit("old"))
    )
    source = (
        li.filter(F.col("l_returnflag") != "R")
        .groupBy(*keys)
        .agg(F.max("l_extendedprice").alias("total"))
        .withColumn("origin", F.lit("new"))
    )
    return catalog.merge_upsert(target, source, ["id", "match_id"])


@query(
    "fk_orphans",
    sql("SELECT job_id, artifact_no, file_size_bytes FROM artifacts WHERE job_id NOT IN (SELECT job_id FROM jobs)", "artifacts", "jobs"),
)
def fk_orphans(spark, folder):
    found = catalog.orphans(fixtures.artifacts(spark, folder), fixtures.jobs(spark, folder), "job_id")
    return found.select("job_id", "artifact_no", "file_size_bytes")


@query(
    "cascade_delete",
    sql(
        """SELECT engine_left, count(*) AS artifacts FROM (
             SELECT coalesce(j.engine, 'none') AS engine_left FROM artifacts a LEFT JOIN jobs j USING (job_id)
             WHERE a.job_id NOT IN (SELECT job_id FROM jobs WHERE job_status = 'QUEUED')) s GROUP BY engine_left""",
        "artifacts",
        "jobs",
    ),
)
def cascade_delete(spark, folder):
    """Deleting queued jobs removes their artifacts."""
    jobs = fixtures.jobs(spark, folder)
    left = catalog.cascade(fixtures.artifacts(spark, folder), jobs.filter(F.col("job_status") == "QUEUED"), "job_id")
    return (
        left.join(jobs.select("job_id", "engine"), "job_id", "left")
        .groupBy(F.coalesce("engine", F.lit("none")).alias("engine_left"))
        .agg(F.count("*").alias("artifacts"))
    )


@query(
    "storage_pairing",
    sql(
        """SELECT coalesce(t.job_id, z.job_id) AS job_id, CASE WHEN z.job_id IS NULL THEN 'MISSING_ZARR'
             WHEN t.job_id IS NULL THEN 'MISSING_TIF' ELSE 'PAIRED' END AS status FROM tif t FULL JOIN zar z ON t.job_id = z.job_id""",
        "tif",
        "zar",
    ),
)
def storage_pairing(spark, folder):
    tif, chunked = fixtures.storage(spark, folder)
    both = tif.join(chunked, "job_id", "full")
    return both.select(
        "job_id",
        F.when(F.col("zarr_bytes").isNull(), "MISSING_ZARR")
        .when(F.col("tif_bytes").isNull(), "MISSING_TIF")
        .otherwise("PAIRED")
        .alias("status"),
    )


@query(
    "storage_savings",
    sql(
        f"""SELECT engine, count(*) AS jobs, CAST(sum(tif_bytes) AS BIGINT) AS tif_bytes, CAST(sum(zarr_bytes) AS BIGINT) AS zarr_bytes,
              {snap_sql('(sum(tif_bytes) - sum(zarr_bytes))*100.0::DOUBLE/sum(tif_bytes)', 5)} AS saved,
              {snap_sql('max((tif_bytes - zarr_bytes)*100.0::DOUBLE/tif_bytes)', 5)} AS best
            FROM tif JOIN zar USING (job_id) JOIN jobs USING (job_id) GROUP BY engine""",
        "tif",
        "zar",
        "jobs",
    ),
)
def storage_savings(spark, folder):
    tif, chunked = fixtures.storage(spark, folder)
    engines = fixtures.jobs(spark, folder).select("job_id", "engine")
    both = tif.join(chunked, "job_id").join(engines, "job_id")
    total = percent(F.sum("tif_bytes") - F.sum("zarr_bytes"), F.sum("tif_bytes"))
    each = F.max(percent(F.col("tif_bytes") - F.col("zarr_bytes"), F.col("tif_bytes")))
    return both.groupBy("engine").agg(
        F.count("*").alias("jobs"),
        F.sum("tif_bytes").alias("tif_bytes"),
        F.sum("zarr_bytes").alias("zarr_bytes"),
        snap(total, 5).alias("saved"),
        snap(each, 5).alias("best"),
    )


@query(
    "tile_time_stats",
    sql(
        """SELECT engine, floor(avg(duration)*100 + 0.3141592)/100 AS mean_all, max(duration) AS max_all, min(duration) AS min_all,
             floor(avg(duration) FILTER (status = 'SUCCESS')*100 + 0.3141592)/100 AS mean_ok,
             max(duration) FILTER (status = 'SUCCESS') AS max_ok FROM runs GROUP BY engine""",
        "runs",
    ),
)
def tile_time_stats(spark, folder):
    """Run times over all runs and over successful runs only."""
    good = F.when(F.col("status") == "SUCCESS", F.col("duration"))
    return fixtures.run_log(spark, folder).groupBy("engine").agg(
        snap(F.avg("duration"), 2).alias("mean_all"),
        F.max("duration").alias("max_all"),
        F.min("duration").alias("min_all"),
        snap(F.avg(good), 2).alias("mean_ok"),
        F.max(good).alias("max_ok"),
    )


@query(
    "speedup_report",
    sql(
        f"""SELECT status, {snap_sql("sum(CASE WHEN engine = 'PYSNAP' THEN duration END)/count(CASE WHEN engine = 'PYSNAP' THEN 1 END) / (sum(CASE WHEN engine = 'SPARK' THEN duration END)/count(CASE WHEN engine = 'SPARK' THEN 1 END))", 6)} AS spark_speedup,
              {snap_sql("avg(CASE WHEN engine = 'PYSNAP' THEN duration END)/avg(CASE WHEN engine = 'DASK' THEN duration END)", 6)} AS dask_speedup
            FROM runs GROUP BY status""",
        "runs",
    ),
)
def speedup_report(spark, folder):
    def mean(engine):
        return F.avg(F.when(F.col("engine") == engine, F.col("duration")))

    return fixtures.run_log(spark, folder).groupBy("status").agg(
        snap(F.try_divide(mean("PYSNAP"), mean("SPARK")), 6).alias("spark_speedup"),
        snap(F.try_divide(mean("PYSNAP"), mean("DASK")), 6).alias("dask_speedup"),
    )


_COMPARE = f"""count(*) AS n, {snap_sql('avg(preprocessing_seconds)', 5)} AS mean_preprocessing,
   {snap_sql('max(upload_seconds)', 5)} AS max_upload, {snap_sql('sum(conversion_seconds)', 3)} AS total_conversion"""


def _timings():
    return [
        F.count("*").alias("n"),
        snap(F.avg("preprocessing_seconds"), 5).alias("mean_preprocessing"),
        snap(F.max("upload_seconds"), 5).alias("max_upload"),
        snap(F.sum("conversion_seconds"), 3).alias("total_conversion"),
    ]


@query("engine_comparison", sql(f"SELECT engine, {_COMPARE} FROM artifacts JOIN jobs USING (job_id) GROUP BY engine", "artifacts", "jobs"))
def engine_comparison(spark, folder):
    timed = fixtures.artifacts(spark, folder).join(fixtures.jobs(spark, folder).select("job_id", "engine"), "job_id")
    return timed.groupBy("engine").agg(*_timings())


@query(
    "engine_rollup",
    sql(
        f"""SELECT CASE WHEN grouping(engine) = 1 THEN 'ALL' ELSE engine END AS engine,
              CASE WHEN grouping(scene_id) = 1 THEN 'ALL' ELSE CAST(scene_id AS VARCHAR) END AS scene, {_COMPARE}
            FROM artifacts JOIN jobs USING (job_id) GROUP BY ROLLUP (engine, scene_id)""",
        "artifacts",
        "jobs",
    ),
)
def engine_rollup(spark, folder):
    timed = fixtures.artifacts(spark, folder).join(
        fixtures.jobs(spark, folder).select("job_id", "engine", "scene_id"), "job_id"
    )
    levels = [F.grouping(c).alias(f"_{c}") for c in ("engine", "scene_id")]
    rolled = timed.rollup("engine", "scene_id").agg(*levels, *_timings())
    return rolled.select(
        F.when(F.col("_engine") == 1, "ALL").otherwise(F.col("engine")).alias("engine"),
        F.when(F.col("_scene_id") == 1, "ALL").otherwise(F.col("scene_id").cast("string")).alias("scene"),
        "n",
        "mean_preprocessing",
        "max_upload",
        "total_conversion",
    )


@query("distinct_values", sql("SELECT DISTINCT engine, job_status FROM jobs", "jobs"))
def distinct_values(spark, folder):
    return fixtures.jobs(spark, folder).select("engine", "job_status").distinct()


@query(
    "dedupe_keys",
    """SELECT l_partkey, l_suppkey, r AS first_row, min(p) AS price
       FROM (SELECT l_partkey, l_suppkey, l_orderkey*7 + l_linenumber AS r, l_extendedprice AS p,
               min(l_orderkey*7 + l_linenumber) OVER (PARTITION BY l_partkey, l_suppkey) AS m FROM lineitem) s
       WHERE r = m GROUP BY 1, 2, 3""",
)
def dedupe_keys(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_partkey",
        "l_suppkey",
        (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("first_row"),
        F.col("l_extendedprice").alias("price"),
    )
    # A key may repeat whole rows of different price; the smaller price wins the tie.
    first = rows.groupBy("l_partkey", "l_suppkey", "first_row").agg(F.min("price").alias("price"))
    return catalog.dedupe(first, ["l_partkey", "l_suppkey"], ["first_row"])


@query(
    "latest_artifact",
    sql(
        """SELECT job_id, artifact_no, max(file_size_bytes) AS file_size_bytes FROM artifacts a
           WHERE artifact_no = (SELECT max(artifact_no) FROM artifacts b WHERE b.job_id = a.job_id) GROUP BY 1, 2""",
        "artifacts",
    ),
)
def latest_artifact(spark, folder):
    rows = fixtures.artifacts(spark, folder).select("job_id", "artifact_no", "file_size_bytes")
    return catalog.latest_per_key(rows, "job_id", ["artifact_no", "file_size_bytes"])


@query("newest_jobs", sql("SELECT job_id, engine, job_status FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 20", "jobs"))
def newest_jobs(spark, folder):
    jobs = fixtures.jobs(spark, folder)
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(20).select("job_id", "engine", "job_status")


@query("scene_list", sql("SELECT scene_id, scene_name, product_type FROM scenes ORDER BY scene_name LIMIT 50", "scenes"))
def scene_list(spark, folder):
    return fixtures.scenes(spark, folder).select("scene_id", "scene_name", "product_type").orderBy("scene_name").limit(50)


@query(
    "clustered_write",
    sql("SELECT engine, count(*) AS n, min(job_id) AS first_job, max(job_id) AS last_job FROM jobs GROUP BY engine", "jobs"),
)
def clustered_write(spark, folder):
    path = scratch_path(spark, "jobs-by-engine")
    raster.write_tiles(fixtures.jobs(spark, folder), path, ["engine"], ["job_id"])
    return spark.read.parquet(path).groupBy("engine").agg(
        F.count("*").alias("n"), F.min("job_id").alias("first_job"), F.max("job_id").alias("last_job")
    )


@query("partition_by_key", sql("SELECT job_id, count(*) AS artifacts FROM artifacts GROUP BY job_id", "artifacts"))
def partition_by_key(spark, folder):
    """Counts per job: combined before the exchange by job, so a large job is no hot key."""
    return fixtures.artifacts(spark, folder).groupBy("job_id").agg(F.count("*").alias("artifacts"))


@query(
    "mark_finished",
    sql(
        """SELECT j.job_id, CASE WHEN r.run_id IS NOT NULL THEN 'FINISHED' ELSE job_status END AS job_status
           FROM jobs j LEFT JOIN (SELECT run_id FROM runs WHERE status = 'SUCCESS' AND duration > 100) r ON r.run_id = j.job_id""",
        "jobs",
        "runs",
    ),
)
def mark_finished(spark, folder):
    """Jobs with a successful long run become FINISHED."""
    runs = fixtures.run_log(spark, folder).filter((F.col("status") == "SUCCESS") & (F.col("duration") > 100))
    updates = runs.select(F.col("run_id").alias("job_id"), F.lit("FINISHED").alias("new_status"))
    return catalog.set_status(fixtures.jobs(spark, folder), updates).select("job_id", "job_status")


@query(
    "cancel_created",
    sql("SELECT job_id, CASE job_status WHEN 'CREATED' THEN 'CANCELLED' ELSE job_status END AS job_status FROM jobs", "jobs"),
)
def cancel_created(spark, folder):
    return catalog.cancel_created(fixtures.jobs(spark, folder)).select("job_id", "job_status")


@query(
    "enqueue_jobs",
    sql(
        """SELECT s.scene_id, e.engine, 'CREATED' AS job_status FROM scenes s, (SELECT unnest(['PYSNAP', 'SPARK', 'DASK']) AS engine) e
           WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.scene_id = s.scene_id AND j.engine = e.engine)""",
        "scenes",
        "jobs",
    ),
)
def enqueue_jobs(spark, folder):
    areas = fixtures.scenes(spark, folder).select("scene_id")
    queued = catalog.enqueue(areas, ["PYSNAP", "SPARK", "DASK"], fixtures.jobs(spark, folder))
    return queued.select("scene_id", "engine", "job_status")


@query(
    "unique_violations",
    "SELECT p_name AS name, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY p_name HAVING count(*) > 1",
)
def unique_violations(spark, folder):
    counted = table(spark, folder, "part").groupBy(F.col("p_name").alias("name")).agg(
        F.count("*").alias("n"), F.min("p_partkey").alias("first_id")
    )
    return counted.filter(F.col("n") > 1)
