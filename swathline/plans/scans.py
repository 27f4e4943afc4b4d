"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathline.functions.geo import box_wkt
from swathline.functions.numeric import intdiv, snap, snap_sql
from swathline.functions.radiometry import below, change_db
from swathline.operators import catalog, change
from swathline.plans.fragments import sql
from swathline.plans.registry import query
from swathline.schema import EVENT_TARGET, MATCH_DOC, SCENE_CATALOGUE
from swathline.session import scratch_path
from swathline.sources import documents, files, fixtures, raster
from swathline.sources.tables import table

TILE, WIDTH = fixtures.TILE, fixtures.WIDTH


@query("raster_window_scan", sql("SELECT y, x, pre AS value FROM px WHERE y >= 30 AND y < 180 AND x >= 40 AND x < 168", "px"))
def raster_window_scan(spark, folder):
    """A window of a stored two-band raster, read by folder and row-group pruning."""
    path = scratch_path(spark, "raster")
    raster.store_raster(fixtures.bands(spark, folder).select("band", "y", "x", "value"), path, TILE)
    window = raster.read_window(spark.read.parquet(path), TILE, band=1, y0=30, x0=40, h=150, w=128)
    return window.select("y", "x", "value")


@query("chunk_slice", sql("SELECT y, x, pre AS value FROM px WHERE y >= 10 AND y < 110 AND x >= 30 AND x < 130", "px"))
def chunk_slice(spark, folder):
    chunks = raster.rechunk(fixtures.pre_raster(spark, folder), TILE, WIDTH)
    return raster.chunk_slice(chunks, TILE, WIDTH, y0=10, x0=30, h=100, w=100).select("y", "x", "value")


@query(
    "raster_info",
    sql(
        """SELECT band, max(y) + 1 AS height, CAST(256 AS BIGINT) AS width, count(*) AS valid,
             min(value) AS min_value, max(value) AS max_value, 'EPSG:4326' AS crs, CAST(0.0001 AS DOUBLE) AS xres,
             CAST(0 AS DOUBLE) AS nodata,
             """ + snap_sql("56.75::DOUBLE - (max(y)+1)*0.0001::DOUBLE", 6) + """ AS south
           FROM bands GROUP BY band""",
        "bands",
    ),
)
def raster_info(spark, folder):
    a = fixtures.AFFINE
    return fixtures.bands(spark, folder).groupBy("band").agg(
        (F.max("y") + 1).alias("height"),
        F.lit(WIDTH).cast("bigint").alias("width"),
        F.count("*").alias("valid"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.lit("EPSG:4326").alias("crs"),
        F.lit(a.a).alias("xres"),
        F.lit(0.0).alias("nodata"),
        snap(F.lit(a.y0) + (F.max("y") + 1) * F.lit(a.e), 6).alias("south"),
    )


@query(
    "aoi_isel",
    sql("SELECT CAST(t AS VARCHAR) AS t, y, x, value FROM cube WHERE y < 9 AND x >= 2 AND x < 11", "cube"),
)
def aoi_isel(spark, folder):
    cut = raster.window_scan(fixtures.cube(spark, folder), y0=0, x0=2, h=9, w=9)
    return cut.withColumn("t", F.col("t").cast("string"))


@query(
    "aoi_sel_coords",
    sql(
        """SELECT y, x, pre AS value FROM px
           WHERE -3.65::DOUBLE + (x + 0.5::DOUBLE)*0.0001::DOUBLE BETWEEN -3.645::DOUBLE AND -3.632::DOUBLE
             AND 56.75::DOUBLE + (y + 0.5::DOUBLE)*(-0.0001)::DOUBLE BETWEEN 56.735::DOUBLE AND 56.747::DOUBLE""",
        "px",
    ),
)
def aoi_sel_coords(spark, folder):
    pixels = fixtures.pre_raster(spark, folder)
    cut = raster.coordinate_window(pixels, fixtures.AFFINE, west=-3.645, east=-3.632, north=56.747, south=56.735)
    return cut.select("y", "x", "value")


def _lookups(spark, folder):
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.alias("point_id"), ((key * 37) % fixtures.height(spark, folder)).alias("y"), ((key * 101) % WIDTH).alias("x")
    )


_LOOKUP_SQL = sql(
    """SELECT point_id, p.y, p.x, pre AS value
       FROM (SELECT p_partkey AS point_id, (p_partkey*37) % height AS y, (p_partkey*101) % 256 AS x FROM part, hd) p
       LEFT JOIN px ON px.y = p.y AND px.x = p.x""",
    "px",
    "hd",
)


@query("random_pixel_lookup", _LOOKUP_SQL)
def random_pixel_lookup(spark, folder):
    found = raster.lookup_pixels(_lookups(spark, folder), fixtures.pre_raster(spark, folder))
    return found.select("point_id", "y", "x", "value")


@query("random_pixel_lookup_chunked", _LOOKUP_SQL)
def random_pixel_lookup_chunked(spark, folder):
    chunks = raster.rechunk(fixtures.pre_raster(spark, folder), TILE, WIDTH)
    return raster.lookup_chunked(_lookups(spark, folder), chunks, TILE, WIDTH).select("point_id", "y", "x", "value")


@query(
    "random_window_read",
    sql(
        f"""SELECT window_id, count(*) AS n, {snap_sql("sum(pre)", 4)} AS total
           FROM (SELECT s_suppkey AS window_id, (s_suppkey*13) % height AS y0, (s_suppkey*29) % 240 AS x0 FROM supplier, hd) w
           JOIN px ON y >= y0 AND y < y0 + 16 AND x >= x0 AND x < x0 + 16 GROUP BY window_id""",
        "px",
        "hd",
    ),
)
def random_window_read(spark, folder):
    key = F.col("s_suppkey")
    windows = table(spark, folder, "supplier").select(
        key.alias("window_id"),
        ((key * 13) % fixtures.height(spark, folder)).alias("y0"),
        ((key * 29) % (WIDTH - 16)).alias("x0"),
    )
    stats = raster.window_stats(windows, fixtures.pre_raster(spark, folder), 16)
    return stats.select("window_id", "n", snap(F.col("total"), 4).alias("total"))


COMPETITION = T.StructType(
    [
        T.StructField("competition_id", T.LongType()),
        T.StructField("season_id", T.IntegerType()),
        T.StructField("competition_name", T.StringType()),
        T.StructField("season_name", T.StringType()),
        T.StructField("match_updated", T.StringType()),
        T.StructField("absent", T.StringType()),
    ]
)


@query(
    "json_explicit_schema",
    """SELECT p_partkey AS competition_id, p_size AS season_id, p_name AS competition_name, p_brand AS season_name,
         'R-' || p_type AS match_updated, 1 AS absent_is_null FROM part""",
)
def json_explicit_schema(spark, folder):
    """JSON read with a fixed schema, one array of objects per line."""
    source = table(spark, folder, "part")
    docs = source.select(
        F.to_json(
            F.array(
                F.struct(
                    F.col("p_partkey").alias("competition_id"),
                    F.col("p_size").alias("season_id"),
                    F.col("p_name").alias("competition_name"),
                    F.col("p_brand").alias("season_name"),
                    F.concat(F.lit("R-"), F.col("p_type")).alias("match_updated"),
                )
            )
        ).alias("doc")
    )
    path = scratch_path(spark, "competitions")
    documents.write_json_lines(docs, path)
    rows = documents.read_json(spark, path, schema=COMPETITION)
    return rows.withColumn("absent_is_null", F.col("absent").isNull().cast("int")).drop("absent")


def _event_folders(spark, folder):
    """Events as JSON text files, one folder per type."""
    path = scratch_path(spark, "events")
    rows = table(spark, folder, "events").select(
        "event_type",
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("match_id"), "value", "props")).alias("value"),
    )
    rows.write.mode("overwrite").partitionBy("event_type").text(path)
    return path


@query(
    "json_recursive_ingest",
    f"""SELECT match_id, count(*) AS n, {snap_sql('sum(value)', 3)} AS total
        FROM (SELECT user_id AS match_id, value FROM events) e GROUP BY match_id""",
)
def json_recursive_ingest(spark, folder):
    """All files below a folder, schema inferred, partition folders ignored."""
    rows = documents.read_json(spark, _event_folders(spark, folder), recursive=True)
    return rows.groupBy("match_id").agg(F.count("*").alias("n"), snap(F.sum("value"), 3).alias("total"))


@query(
    "json_path_list",
    """SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY event_type""",
)
def json_path_list(spark, folder):
    """An explicit list of paths, one per event type; types are a small fixed vocabulary."""
    root = _event_folders(spark, folder)
    kinds = [r.event_type for r in spark.read.text(root).select("event_type").distinct().collect()]
    schema = "id bigint, match_id bigint, value double, props string"
    rows = documents.read_json(spark, [f"{root}/event_type={k}" for k in kinds], schema=schema)
    kind = F.regexp_extract(F.col("_metadata.file_path"), r"event_type=([^/]+)/", 1)
    return rows.groupBy(kind.alias("event_type")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(
    "artifact_append",
    sql(
        """SELECT artifact_id, job_id, file_size_bytes, artifact_type FROM (
             SELECT job_id*7 + artifact_no AS artifact_id, job_id, file_size_bytes, 'OLD' AS artifact_type FROM artifacts
             UNION ALL
             SELECT (SELECT max(job_id*7 + artifact_no) FROM artifacts) + row_number() OVER (ORDER BY job_id),
                    job_id, 1000 + job_id, 'PREPROCESSED_TILE' FROM jobs WHERE job_status = 'FINISHED') a""",
        "artifacts",
        "jobs",
    ),
)
def artifact_append(spark, folder):
    log = fixtures.artifacts(spark, folder).select(
        (F.col("job_id") * 7 + F.col("artifact_no")).alias("artifact_id"),
        "job_id",
        "file_size_bytes",
        F.lit("OLD").alias("artifact_type"),
    )
    done = (
        fixtures.jobs(spark, folder)
        .filter(F.col("job_status") == "FINISHED")
        .select("job_id", (F.col("job_id") + 1000).alias("file_size_bytes"), F.lit("PREPROCESSED_TILE").alias("artifact_type"))
    )
    path = scratch_path(spark, "artifact-log")
    log.write.parquet(path)
    stored = spark.read.parquet(path)
    catalog.next_ids(stored, done, "job_id").select(*stored.columns).write.mode("append").parquet(path)
    return spark.read.schema(stored.schema).parquet(path)


@query(
    "table_create_partitioned",
    f"""SELECT event_type, count(*) AS n, {snap_sql('sum(value)', 3)} AS total FROM events GROUP BY event_type""",
)
def table_create_partitioned(spark, folder):
    path = scratch_path(spark, "events-by-type")
    rows = table(spark, folder, "events").select("event_id", "user_id", "value", "event_type")
    raster.write_tiles(rows, path, ["event_type"], ["event_id"])
    return (
        spark.read.parquet(path)
        .groupBy("event_type")
        .agg(F.count("*").alias("n"), snap(F.sum("value"), 3).alias("total"))
    )


@query(
    "append_or_create",
    """SELECT event_type, CAST(sum(CASE WHEN value >= 10 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM events GROUP BY event_type""",
)
def append_or_create(spark, folder):
    """First write creates the table, the second appends the large values again."""
    path = scratch_path(spark, "append")
    rows = table(spark, folder, "events").select("event_id", "value", "event_type")
    catalog.append_or_create(rows, path, ["event_type"])
    catalog.append_or_create(rows.filter(F.col("value") >= 10), path, ["event_type"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "overwrite_aligned",
    """SELECT event_id AS id, event_type, value AS x, user_id AS match_id, 1 AS y_is_null FROM events""",
)
def overwrite_aligned(spark, folder):
    path = scratch_path(spark, "aligned")
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("match_id"), F.col("value").alias("x"), F.col("event_id").alias("id"), "event_type"
    )
    rows.write.parquet(path)
    catalog.align_schema(rows, EVENT_TARGET).write.mode("overwrite").parquet(path)
    stored = spark.read.schema(EVENT_TARGET).parquet(path)
    return stored.withColumn("y_is_null", F.col("y").isNull().cast("int")).drop("y")


@query(
    "bootstrap_empty",
    """SELECT c_custkey AS scene_id, c_mktsegment AS product_type, c_name AS scene_name FROM customer""",
)
def bootstrap_empty(spark, folder):
    """An empty table from its schema, then the first load into it."""
    path = scratch_path(spark, "bootstrap")
    spark.createDataFrame([], SCENE_CATALOGUE).write.parquet(path)
    empty = spark.read.parquet(path)
    first = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("scene_id"), F.col("c_mktsegment").alias("product_type"), F.col("c_name").alias("scene_name")
    )
    return empty.unionByName(catalog.align_schema(first, empty.schema)).drop("created_at")


@query("ddl_catalog", "SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS products FROM customer")
def ddl_catalog(spark, folder):
    """Namespace and table by DDL; the table lives in the shared scratch folder."""
    location = scratch_path(spark, "ddl")
    name = "t_" + location.rsplit("-", 1)[1][:12]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS swath_catalog LOCATION '{location}'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS swath_catalog.{name} (scene_id BIGINT, scene_name STRING, product_type STRING) "
        f"USING parquet PARTITIONED BY (product_type) LOCATION '{location}/{name}'"
    )
    table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment").write.insertInto(f"swath_catalog.{name}")
    return spark.table(f"swath_catalog.{name}").agg(
        F.count("*").alias("n"), F.count_distinct("product_type").alias("products")
    )


@query(
    "rechunk",
    sql(
        f"""SELECT tile_id, count(*) AS cells, {snap_sql("sum(pre)", 4)} AS total, min(y*256 + x) AS first_cell,
             max(y*256 + x) AS last_cell FROM px GROUP BY tile_id""",
        "px",
    ),
)
def rechunk(spark, folder):
    chunks = raster.rechunk(fixtures.pre_raster(spark, folder), TILE, WIDTH)
    path = scratch_path(spark, "chunks")
    chunks.write.parquet(path)
    cells = F.col("cells")
    first, last = F.get(cells, F.lit(0)), F.element_at(cells, -1)
    return spark.read.parquet(path).select(
        "tile_id",
        F.size(cells).cast("bigint").alias("cells"),
        snap(F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + c.value), 4).alias("total"),
        (first.y * WIDTH + first.x).alias("first_cell"),
        (last.y * WIDTH + last.x).alias("last_cell"),
    )


@query(
    "mask_tiles",
    sql("SELECT tile_id, y, x, 1 AS mask FROM fl WHERE mask = 1", "fl"),
)
def mask_tiles(spark, folder):
    """Mask pixels of flooded tiles only, stored by tile row."""
    pairs = change.with_change(
        change.align(fixtures.pre_raster(spark, folder), fixtures.post_raster(spark, folder), how="inner")
    )
    hits = pairs.filter(F.col("mask") == 1).select(
        fixtures.tile_of().alias("tile_id"), "y", "x", "mask", intdiv("y", TILE * 16).alias("strip")
    )
    path = scratch_path(spark, "masks")
    raster.write_tiles(hits, path, ["strip"], ["tile_id"])
    return spark.read.parquet(path).select("tile_id", "y", "x", "mask")


@query(
    "cube_store",
    sql(f"SELECT CAST(t AS VARCHAR) AS t, count(*) AS cells, {snap_sql('sum(value)', 3)} AS total FROM cube GROUP BY t", "cube"),
)
def cube_store(spark, folder):
    path = scratch_path(spark, "cube")
    raster.write_tiles(fixtures.cube(spark, folder), path, ["t"], ["y", "x"])
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("t").cast("string").alias("t")).agg(
        F.count("*").alias("cells"), snap(F.sum("value"), 3).alias("total")
    )


@query(
    "split_tiles",
    sql(
        f"""SELECT 'tile_' || (y//64) || '_' || (x//64) AS tile_name, count(*) AS n, {snap_sql('sum(pre)', 4)} AS total
            FROM px GROUP BY y//64, x//64""",
        "px",
    ),
)
def split_tiles(spark, folder):
    pixels = fixtures.pre_raster(spark, folder).withColumns({"tile_y": intdiv("y", TILE), "tile_x": intdiv("x", TILE)})
    path = scratch_path(spark, "split")
    raster.write_tiles(pixels, path, ["tile_x"], ["tile_y"])
    name = F.format_string("tile_%d_%d", "tile_y", F.col("tile_x").cast("bigint"))
    return (
        spark.read.parquet(path)
        .groupBy(name.alias("tile_name"))
        .agg(F.count("*").alias("n"), snap(F.sum("value"), 4).alias("total"))
    )


@query("storage_sizes")
def storage_sizes(spark, folder):
    """Bytes on disk of the stored event table, per type folder."""
    listing = files.file_sizes(spark, _event_folders(spark, folder), "*.txt")
    return files.footprint(listing)


@query(
    "geojson_features",
    sql(
        """SELECT zone_id AS value, CAST(5 AS BIGINT) AS points, CAST(zx AS DOUBLE) AS min_x, CAST(zy + 10 AS DOUBLE) AS max_y
           FROM zones""",
        "zones",
    ),
)
def geojson_features(spark, folder):
    from swathline.operators.spatial import parse_polygons

    path = scratch_path(spark, "geojson")
    documents.write_each(documents.feature_collection(parse_polygons(fixtures.zones(spark, folder))), path, "zone_id")
    return documents.read_features(spark, path).select(
        "value",
        F.size("ring").cast("bigint").alias("points"),
        F.array_min(F.transform("ring", lambda p: p.x)).alias("min_x"),
        F.array_max(F.transform("ring", lambda p: p.y)).alias("max_y"),
    )


@query("text_count", "SELECT count(*) AS lines FROM conversations")
def text_count(spark, folder):
    """Line count of a text folder; one line per conversation turn."""
    path = scratch_path(spark, "text")
    flat = F.regexp_replace("text", r"[\r\n]+", " ")
    table(spark, folder, "conversations").select(F.coalesce(flat, F.lit("")).alias("value")).write.text(path)
    return spark.read.text(path).agg(F.count("*").alias("lines"))


@query(
    "scene_search",
    sql(
        """SELECT scene_id, product_type, count(*) AS jobs FROM scenes JOIN jobs USING (scene_id)
           WHERE product_type IN ('BUILDING', 'MACHINERY') AND x0 <= 28 AND x1 >= 12 AND y0 <= 33 AND y1 >= 17
             AND created_at >= TIMESTAMP '1996-06-01' AND created_at < TIMESTAMP '1999-06-01'
           GROUP BY scene_id, product_type""",
        "scenes",
        "jobs",
    ),
)
def scene_search(spark, folder):
    """Scenes of a product type over a box, with the jobs of a date range."""
    found = fixtures.scenes(spark, folder).filter(
        F.col("product_type").isin("BUILDING", "MACHINERY")
        & (F.col("x0") <= 28)
        & (F.col("x1") >= 12)
        & (F.col("y0") <= 33)
        & (F.col("y1") >= 17)
    )
    dated = fixtures.jobs(spark, folder).filter(
        (F.col("created_at") >= F.lit("1996-06-01").cast("timestamp_ntz"))
        & (F.col("created_at") < F.lit("1999-06-01").cast("timestamp_ntz"))
    )
    per_scene = dated.groupBy("scene_id").agg(F.count("*").alias("jobs"))
    return found.join(per_scene, "scene_id").select("scene_id", "product_type", "jobs")


@query(
    "ground_truth_slice",
    """SELECT o_orderkey AS feature_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, max(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) OVER () AS latest
       FROM orders WHERE CAST(o_orderdate AS VARCHAR) LIKE '%1998-10%' AND o_custkey%50 BETWEEN 5 AND 40""",
)
def ground_truth_slice(spark, folder):
    """Features whose date text names a month, inside a coordinate slice, and the latest date."""
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("feature_id"),
        F.col("o_orderdate").cast("string").alias("date_time"),
        (F.col("o_custkey") % 50).alias("px"),
    )
    hits = rows.filter(F.col("date_time").contains("1998-10") & F.col("px").between(5, 40))
    day = F.substring("date_time", 1, 10)
    latest = hits.agg(F.max(day)).scalar()
    return hits.select("feature_id", day.alias("day"), latest.alias("latest"))
