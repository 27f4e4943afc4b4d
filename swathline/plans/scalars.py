"""Projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathline.functions import geo, radiometry
from swathline.functions.numeric import intdiv, snap, snap_sql
from swathline.operators import catalog, cube
from swathline.plans.fragments import sql
from swathline.plans.registry import query
from swathline.schema import EVENT_TARGET
from swathline.sources import documents, fixtures, raster
from swathline.sources.tables import table

TILE, WIDTH = fixtures.TILE, fixtures.WIDTH


@query(
    "to_db_clipped",
    sql(f"SELECT y, x, {snap_sql('10*log10(greatest(post, 1e-6))', 6)} AS db FROM px", "px"),
)
def to_db_clipped(spark, folder):
    pixels = fixtures.post_raster(spark, folder)
    return pixels.select("y", "x", snap(radiometry.db_clipped(F.col("value")), 6).alias("db"))


@query(
    "to_db_masked",
    sql(f"SELECT CAST(t AS VARCHAR) AS t, y, x, {snap_sql('db', 6)} AS db FROM cdb", "cdb"),
)
def to_db_masked(spark, folder):
    db = cube.to_db(fixtures.cube(spark, folder))
    return db.select(F.col("t").cast("string").alias("t"), "y", "x", snap(F.col("db"), 6).alias("db"))


@query(
    "amplitude_db",
    sql(f"SELECT y, x, {snap_sql('20*log10(pre + 1e-6)', 6)} AS db FROM px", "px"),
)
def amplitude_db(spark, folder):
    pixels = fixtures.pre_raster(spark, folder)
    return pixels.select("y", "x", snap(radiometry.amplitude_db(F.col("value")), 6).alias("db"))


@query(
    "path_rewrite",
    sql(
        """SELECT job_id, '/store/' || job_id || '/' || scene_id || '_tile.zarr' AS zarr_path,
             scene_id || '_tile.tif' AS base_name FROM jobs""",
        "jobs",
    ),
)
def path_rewrite(spark, folder):
    path = F.format_string("/store/%d/%d_tile.tif", F.col("job_id"), F.col("scene_id"))
    return fixtures.jobs(spark, folder).select(
        "job_id",
        F.regexp_replace(path, r"\.tif$", ".zarr").alias("zarr_path"),
        F.substring_index(path, "/", -1).alias("base_name"),
    )


@query(
    "artifact_projection",
    sql(
        """SELECT job_id, scene_id, 'PREPROCESSED_TILE' AS artifact_type, 'TIFF' AS file_format,
             '/store/' || job_id || '/' || artifact_no || '.tif' AS hdfs_path, 'SPARK' AS local_path, file_size_bytes,
             preprocessing_seconds, upload_seconds AS hdfs_upload_seconds, conversion_seconds AS zarr_conversion_seconds,
             """ + snap_sql("preprocessing_seconds + upload_seconds + conversion_seconds", 4) + """ AS pipeline_seconds
           FROM artifacts JOIN jobs USING (job_id) WHERE engine = 'SPARK'""",
        "artifacts",
        "jobs",
    ),
)
def artifact_projection(spark, folder):
    done = (
        fixtures.artifacts(spark, folder)
        .join(fixtures.jobs(spark, folder).filter(F.col("engine") == "SPARK").select("job_id", "scene_id"), "job_id")
        .withColumn("path", F.format_string("/store/%d/%d.tif", F.col("job_id"), F.col("artifact_no")))
    )
    rows = catalog.artifact_rows(done, "SPARK")
    return rows.withColumn("pipeline_seconds", snap(F.col("pipeline_seconds"), 4))


def _matches(spark, folder, *info):
    return documents.parse_matches(documents.match_documents(spark, folder), ("match_id", *info))


@query(
    "flatten_struct",
    """SELECT l_orderkey*7 + l_linenumber - 1 AS match_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS match_date,
         l_returnflag AS team_a, l_linestatus AS team_b, 'ground ' || (l_suppkey%10) AS venue, l_returnflag AS winner,
         CAST(l_quantity AS BIGINT) AS margin_runs, 'by ' || CAST(l_quantity AS BIGINT) AS margin_name FROM lineitem""",
)
def flatten_struct(spark, folder):
    flat = documents.flatten_matches(_matches(spark, folder, "dates", "teams", "venue", "outcome"))
    return flat.withColumn("match_date", F.col("match_date").cast("string"))


@query(
    "array_item",
    "SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, 1 AS beyond_is_null FROM embeddings",
)
def array_item(spark, folder):
    vec = F.col("embedding")
    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.get(vec, F.lit(0)).cast("double").alias("x"),
        F.get(vec, F.lit(1)).cast("double").alias("y"),
        F.get(vec, F.lit(1000)).isNull().cast("int").alias("beyond_is_null"),
    )


_BALLS = """SELECT l_orderkey*7 + l_linenumber - 1 AS match_id, l_returnflag AS batting_team, l_linenumber AS over_num,
   CAST(l_partkey AS VARCHAR) AS batter, CAST(l_suppkey AS VARCHAR) AS bowler, CAST(l_quantity AS BIGINT)%7 AS runs,
   CAST(l_quantity AS BIGINT) AS total, CASE WHEN CAST(l_quantity AS BIGINT)%5 = 0 THEN 'bowled' END AS wicket_kind,
   CASE WHEN CAST(l_quantity AS BIGINT)%5 = 0 THEN CAST(l_partkey AS VARCHAR) END AS player_out FROM lineitem
 UNION ALL SELECT l_orderkey*7 + l_linenumber - 1, l_returnflag, l_linenumber, CAST(l_partkey + 1 AS VARCHAR),
   CAST(l_suppkey AS VARCHAR), CAST(l_quantity AS BIGINT)%3, CAST(l_quantity AS BIGINT)%11, NULL, NULL FROM lineitem
 UNION ALL SELECT l_orderkey*7 + l_linenumber - 1, l_linestatus, 0, CAST(l_suppkey AS VARCHAR),
   CAST(l_partkey AS VARCHAR), CAST(l_quantity AS BIGINT)%2, CAST(l_quantity AS BIGINT)%13, NULL, NULL FROM lineitem"""


@query(
    "explode_chain",
    f"""SELECT match_id, batting_team, over_num, batter, bowler, runs, total FROM ({_BALLS}) b""",
)
def explode_chain(spark, folder):
    return documents.balls(_matches(spark, folder)).drop("wickets")


@query("explode_outer", _BALLS)
def explode_outer(spark, folder):
    return documents.with_wickets(documents.balls(_matches(spark, folder)))


@query(
    "unpivot_stack",
    """SELECT l_orderkey*7 + l_linenumber - 1 AS match_id, 'team_' || l_returnflag AS team_name, CAST(l_partkey AS VARCHAR) AS player_name FROM lineitem
       UNION ALL SELECT l_orderkey*7 + l_linenumber - 1, 'team_' || l_returnflag, CAST(l_partkey + 1 AS VARCHAR) FROM lineitem
       UNION ALL SELECT l_orderkey*7 + l_linenumber - 1, 'side_' || l_linestatus, CAST(l_suppkey AS VARCHAR) FROM lineitem""",
)
def unpivot_stack(spark, folder):
    return documents.players(_matches(spark, folder, "players"))


@query(
    "regex_key",
    """SELECT CAST(c_custkey AS BIGINT) AS match_id, c_name AS name FROM customer""",
)
def regex_key(spark, folder):
    """The key is the number in front of .json in the file name."""
    name = F.col("c_name")
    path = F.concat(F.lit("/in/"), F.regexp_replace(name, "#", "/"), F.lit(".json"))
    return table(spark, folder, "customer").select(
        F.regexp_extract(path, r"(\d+)\.json$", 1).cast("bigint").alias("match_id"), name.alias("name")
    )


@query(
    "schema_align",
    """SELECT event_id AS id, event_type, value AS x, user_id AS match_id, props, NULL::DOUBLE AS y FROM events
       UNION ALL SELECT vec_id, 'vec', embedding[1]::DOUBLE, label, NULL, embedding[2]::DOUBLE FROM embeddings""",
)
def schema_align(spark, folder):
    """Two batches with different columns under one target schema plus a new column."""
    first = table(spark, folder, "events").select(
        "props", F.col("user_id").alias("match_id"), F.col("value").alias("x"), F.col("event_id").alias("id"), "event_type"
    )
    vec = F.col("embedding")
    second = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.lit("vec").alias("event_type"),
        F.get(vec, F.lit(0)).alias("x"),
        F.get(vec, F.lit(1)).alias("y"),
        F.col("label").alias("match_id"),
    )
    evolved = catalog.align_schema(first, EVENT_TARGET)
    return evolved.unionByName(catalog.align_schema(second, evolved.schema))


@query(
    "date_parse",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts,
         1 AS bad_is_null FROM orders""",
)
def date_parse(spark, folder):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.try_to_date(text, "yyyy-MM-dd").cast("string").alias("day"),
        F.date_format(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ss")), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.try_to_date(F.concat(text, F.lit(" (tbc)")), "yyyy-MM-dd").isNull().cast("int").alias("bad_is_null"),
    )


@query(
    "stage_durations",
    sql(
        """SELECT job_id, artifact_no, round(preprocessing_seconds + conversion_seconds, 2) AS pipeline_seconds,
             CAST(preprocessing_seconds*60 AS BIGINT) AS elapsed FROM artifacts""",
        "artifacts",
    ),
)
def stage_durations(spark, folder):
    """Start and stop stamps to elapsed whole seconds, and rounded stage sums."""
    log = fixtures.artifacts(spark, folder).withColumn(
        "stop_at", F.timestamp_add("MINUTE", F.col("preprocessing_seconds").cast("int"), F.col("created_at"))
    )
    return log.select(
        "job_id",
        "artifact_no",
        F.round(F.col("preprocessing_seconds") + F.col("conversion_seconds"), 2).alias("pipeline_seconds"),
        F.timestamp_diff("SECOND", F.col("created_at"), F.col("stop_at")).alias("elapsed"),
    )


@query(
    "pixel_coords",
    sql(
        f"""SELECT y, x, {snap_sql('-3.65::DOUBLE + (x + 0.5::DOUBLE)*0.0001::DOUBLE', 7)} AS lon,
              {snap_sql('56.75::DOUBLE + (y + 0.5::DOUBLE)*(-0.0001)::DOUBLE', 7)} AS lat FROM px""",
        "px",
    ),
)
def pixel_coords(spark, folder):
    a = fixtures.AFFINE
    return fixtures.pre_raster(spark, folder).select(
        "y", "x", snap(geo.pixel_x(F.col("x"), a), 7).alias("lon"), snap(geo.pixel_y(F.col("y"), a), 7).alias("lat")
    )


@query(
    "bounds_to_lonlat",
    """SELECT c_custkey, floor(w*1e6 + 0.3141592)/1e6 AS min_lon, floor(s*1e6 + 0.3141592)/1e6 AS min_lat,
         floor(e*1e6 + 0.3141592)/1e6 AS max_lon, floor(n*1e6 + 0.3141592)/1e6 AS max_lat
       FROM (SELECT c_custkey, degrees(mx/6378137.0::DOUBLE) AS w, degrees((mx + 5000)/6378137.0::DOUBLE) AS e,
               degrees(2*atan(exp(my/6378137.0::DOUBLE)) - pi()/2) AS s,
               degrees(2*atan(exp((my + 5000)/6378137.0::DOUBLE)) - pi()/2) AS n
             FROM (SELECT c_custkey, (c_custkey%50)*100000.0::DOUBLE AS mx, ((c_custkey//50)%50)*100000.0::DOUBLE AS my FROM customer) c) d""",
)
def bounds_to_lonlat(spark, folder):
    """Boxes of 5 km in spherical Mercator to lon/lat."""
    points = fixtures.points(spark, folder)
    mx, my = F.col("px") * 100000.0, F.col("py") * 100000.0
    bounds = geo.project_bounds("EPSG:3857", mx, my, mx + 5000, my + 5000)
    names = ("min_lon", "min_lat", "max_lon", "max_lat")
    return points.select(F.col("point_id").alias("c_custkey"), *[snap(b, 6).alias(n) for n, b in zip(names, bounds)])


@query(
    "json_props",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT)%10 AS tail FROM events""",
)
def json_props(spark, folder):
    parsed = F.from_json("props", "k bigint").getField("k")
    scalar = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, folder, "events").select("event_id", parsed.alias("k"), (scalar % 10).alias("tail"))


@query(
    "array_chunk_stats",
    f"""SELECT vec_id, list_max(embedding)::DOUBLE AS top, list_min(embedding)::DOUBLE AS low,
          {snap_sql('list_sum(embedding::DOUBLE[])', 6)} AS total,
          {snap_sql('embedding[1]::DOUBLE + embedding[5]::DOUBLE + embedding[33]::DOUBLE + embedding[37]::DOUBLE', 6)} AS corners
        FROM embeddings""",
)
def array_chunk_stats(spark, folder):
    """An 8x8 chunk as an array: extremes, sum, and the corners of its first 5x5 cells."""
    vec = F.transform("embedding", lambda v: v.cast("double"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda r: F.slice(vec, r * 8 + 1, F.lit(5)))
    first, last = F.get(rows, F.lit(0)), F.get(rows, F.lit(4))
    corners = F.get(first, F.lit(0)) + F.get(first, F.lit(4)) + F.get(last, F.lit(0)) + F.get(last, F.lit(4))
    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.array_max(vec).alias("top"),
        F.array_min(vec).alias("low"),
        snap(F.aggregate(vec, F.lit(0.0), lambda acc, v: acc + v), 6).alias("total"),
        snap(corners, 6).alias("corners"),
    )


@query(
    "minmax_scale",
    sql(
        f"""SELECT y, x, {snap_sql('(pre - lo)/(hi - lo)', 6)} AS red, {snap_sql('(post - lo)/(hi - lo)', 6)} AS green,
              {snap_sql('(pre*2 - lo)/(hi - lo)', 6)} AS blue
            FROM px, (SELECT least(min(pre), min(post)) AS lo, greatest(max(pre)*2, max(post)) AS hi FROM px) r""",
        "px",
    ),
)
def minmax_scale(spark, folder):
    """Three bands stacked and scaled by their common range."""
    rgb = fixtures.px(spark, folder).select(
        "y", "x", F.col("pre").alias("red"), F.col("post").alias("green"), (F.col("pre") * 2).alias("blue")
    )
    names = ("red", "green", "blue")
    low = rgb.agg(F.least(*[F.min(n) for n in names])).scalar()
    high = rgb.agg(F.greatest(*[F.max(n) for n in names])).scalar()
    return rgb.select("y", "x", *[snap(F.try_divide(F.col(n) - low, high - low), 6).alias(n) for n in names])


@query(
    "dedupe_names",
    """SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE p_name || '_' || (r - 1) END AS unique_name
       FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part) s""",
)
def dedupe_names(spark, folder):
    named = catalog.unique_names(table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")
    return named.select("p_partkey", "unique_name")


@query(
    "calibrate_sigma0",
    sql(
        f"""SELECT y, x, {snap_sql('pre*pre/(lut*lut)', 6)} AS sigma0 FROM (
              SELECT y, x, pre, (1 + n*n/65536.0::DOUBLE)
                     + ((1 + (n+32)*(n+32)/65536.0::DOUBLE) - (1 + n*n/65536.0::DOUBLE))*((x - n)/32.0::DOUBLE) AS lut
              FROM (SELECT *, (x//32)*32 AS n FROM px) p) l""",
        "px",
    ),
)
def calibrate_sigma0(spark, folder):
    """Raw counts to sigma0 with a table of nine nodes per line, interpolated between nodes."""
    step = 32
    nodes = spark.range(0, WIDTH + 1, step).select(
        F.col("id").alias("node"), (1 + F.col("id") * F.col("id") / 65536.0).alias("lut")
    )
    looked = cube.interpolate_table(fixtures.pre_raster(spark, folder), "x", nodes, step)
    sigma0 = F.col("value") * F.col("value") / (F.col("lut") * F.col("lut"))
    return looked.select("y", "x", snap(sigma0, 6).alias("sigma0"))


@query("band_select", sql("SELECT y, x, value FROM bands WHERE band = 2", "bands"))
def band_select(spark, folder):
    return fixtures.bands(spark, folder).filter(F.col("band") == 2).select("y", "x", "value")
