"""Geometry, projections and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.functions import geo
from swathline.functions.numeric import snap, snap_sql
from swathline.operators import change, spatial
from swathline.plans.fragments import sql
from swathline.plans.registry import query
from swathline.sources import fixtures
from swathline.sources.tables import table

TILE, WIDTH = fixtures.TILE, fixtures.WIDTH


def _zones(spark, folder):
    return spatial.parse_polygons(fixtures.zones(spark, folder))


@query(
    "wkt_parse",
    sql(
        """SELECT zone_id, 'POLYGON' AS kind, CAST(5 AS BIGINT) AS points, CAST(zx AS DOUBLE) AS x0, CAST(zy AS DOUBLE) AS y0,
             CAST(zx + 10 AS DOUBLE) AS x1, CAST(zy + 10 AS DOUBLE) AS y1 FROM zones
           UNION ALL SELECT 1000 + point_id, 'POINT', 1, px, py, px, py FROM points""",
        "zones",
        "points",
    ),
)
def wkt_parse(spark, folder):
    """Polygons and points from text."""
    point = F.concat(
        F.lit("POINT ("), F.concat_ws(" ", F.col("px").cast("string"), F.col("py").cast("string")), F.lit(")")
    )
    texts = fixtures.zones(spark, folder).select("zone_id", "wkt").unionByName(
        fixtures.points(spark, folder).select((F.col("point_id") + 1000).alias("zone_id"), point.alias("wkt"))
    )
    parsed = spatial.parse_polygons(texts)
    return parsed.select(
        "zone_id", geo.wkt_kind(F.col("wkt")).alias("kind"), F.size("ring").cast("bigint").alias("points"), "box.*"
    )


@query(
    "make_envelope",
    """SELECT c_custkey AS point_id, CAST(c_custkey%50 AS DOUBLE) - 0.5::DOUBLE AS x0, CAST((c_custkey//50)%50 AS DOUBLE) + 0.5::DOUBLE AS y1,
         CAST(5 AS BIGINT) AS points, 1 AS holds_centre FROM customer""",
)
def make_envelope(spark, folder):
    """Boxes around points, through text and back; the centre lies inside."""
    half = 0.5
    px, py = F.col("px"), F.col("py")
    boxed = fixtures.points(spark, folder).withColumn("wkt", geo.box_wkt(px - half, py - half, px + half, py + half))
    parsed = spatial.parse_polygons(boxed)
    inside = geo.strictly_inside(px, py, geo.ring_edges(F.col("ring")))
    return parsed.select(
        "point_id", F.col("box.x0"), F.col("box.y1"), F.size("ring").cast("bigint").alias("points"),
        inside.cast("int").alias("holds_centre"),
    )


_STRICT = "px > zx AND px < zx + 10 AND py > zy AND py < zy + 10"
_CLOSED = "px BETWEEN zx AND zx + 10 AND py BETWEEN zy AND zy + 10"


@query("st_within", sql(f"SELECT point_id, zone_id FROM points JOIN zones ON {_STRICT}", "points", "zones"))
def st_within(spark, folder):
    return spatial.points_in_polygons(fixtures.points(spark, folder), _zones(spark, folder), "within").select("point_id", "zone_id")


@query("st_contains", sql(f"SELECT zone_id, count(*) AS points FROM points JOIN zones ON {_STRICT} GROUP BY zone_id", "points", "zones"))
def st_contains(spark, folder):
    held = spatial.points_in_polygons(fixtures.points(spark, folder), _zones(spark, folder), "contains")
    return held.groupBy("zone_id").agg(F.count("*").alias("points"))


@query("st_intersects", sql(f"SELECT point_id, zone_id FROM points JOIN zones ON {_CLOSED}", "points", "zones"))
def st_intersects(spark, folder):
    hits = spatial.points_in_polygons(fixtures.points(spark, folder), _zones(spark, folder), "intersects")
    return hits.select("point_id", "zone_id")


def _tile_boxes(spark, folder, shift=0):
    """Pixel-space box of every tile that holds a pixel."""
    tid = F.col("left_id")
    y0, x0 = F.floor(tid / 4) * TILE + shift, (tid % 4) * TILE + shift
    ids = fixtures.pre_raster(spark, folder).select(fixtures.tile_of().alias("left_id")).distinct()
    corners = {"x0": x0, "y0": y0, "x1": x0 + TILE, "y1": y0 + TILE}
    return ids.withColumn("box", F.struct(*[c.cast("double").alias(n) for n, c in corners.items()]))


@query(
    "spatial_join_intersects",
    sql(
        """SELECT a.tile_id AS left_id, b.tile_id AS right_id
           FROM (SELECT tile_id, x0, y0 FROM tiles) a JOIN (SELECT tile_id, x0 + 32 AS x0, y0 + 32 AS y0 FROM tiles) b
             ON a.x0 <= b.x0 + 64 AND b.x0 <= a.x0 + 64 AND a.y0 <= b.y0 + 64 AND b.y0 <= a.y0 + 64""",
        "tiles",
    ),
)
def spatial_join_intersects(spark, folder):
    """Tiles of two grids, the second shifted by half a tile, whose envelopes touch."""
    left = _tile_boxes(spark, folder)
    right = _tile_boxes(spark, folder, 32).withColumnRenamed("left_id", "right_id")
    return spatial.boxes_intersecting(left, right, TILE)


@query(
    "footprint_contains",
    """SELECT p.p_partkey AS point_id, y//64*4 + x//64 AS tile_id FROM (
         SELECT p_partkey, (p_partkey*37) % (SELECT (max(l_orderkey*7 + l_linenumber - 1)//256 + 1) FROM lineitem) AS y, (p_partkey*101) % 256 AS x FROM part) p
       WHERE y//64*4 + x//64 IN (SELECT (l_orderkey*7 + l_linenumber - 1)//256//64*4 + ((l_orderkey*7 + l_linenumber - 1)%256)//64 FROM lineitem)""",
)
def footprint_contains(spark, folder):
    """The tile footprint that holds each point (pixel centres never lie on an edge)."""
    key = F.col("p_partkey")
    points = table(spark, folder, "part").select(
        key.alias("point_id"),
        ((key * 101) % WIDTH + 0.5).alias("px"),
        ((key * 37) % fixtures.height(spark, folder) + 0.5).alias("py"),
    )
    found = spatial.footprint_lookup(points, _tile_boxes(spark, folder), TILE)
    return found.select("point_id", F.col("left_id").alias("tile_id"))


REGION = "POLYGON((-3.6455 56.7495, -3.6305 56.7475, -3.6325 56.7305, -3.6405 56.7255, -3.6475 56.7385, -3.6455 56.7495))"

_RING = [(-3.6455, 56.7495), (-3.6305, 56.7475), (-3.6325, 56.7305), (-3.6405, 56.7255), (-3.6475, 56.7385), (-3.6455, 56.7495)]
_CROSSINGS = " + ".join(
    f"CASE WHEN ({ay}::DOUBLE > lat) <> ({by}::DOUBLE > lat) AND lon < {ax}::DOUBLE + (lat - {ay}::DOUBLE)*({bx}::DOUBLE - ({ax})::DOUBLE)/({by}::DOUBLE - {ay}::DOUBLE) THEN 1 ELSE 0 END"
    for (ax, ay), (bx, by) in zip(_RING, _RING[1:])
)


@query(
    "subset_geo_region",
    sql(
        f"""SELECT y, x, pre AS value FROM (SELECT *, -3.65::DOUBLE + (x + 0.5::DOUBLE)*0.0001::DOUBLE AS lon,
              56.75::DOUBLE + (y + 0.5::DOUBLE)*(-0.0001)::DOUBLE AS lat FROM px) p WHERE ({_CROSSINGS}) % 2 = 1""",
        "px",
    ),
)
def subset_geo_region(spark, folder):
    return spatial.clip_to_region(fixtures.pre_raster(spark, folder), REGION, fixtures.AFFINE).select("y", "x", "value")


@query(
    "zone_flood_stats",
    sql(
        f"""SELECT zone_id, count(px) AS pixels, CAST(coalesce(sum(mask), 0) AS BIGINT) AS flooded,
              {snap_sql('sum(mask)*100.0::DOUBLE/nullif(count(px), 0)', 5)} AS share
            FROM zones LEFT JOIN (SELECT (x + 0.5::DOUBLE)*50/256 AS px, (y + 0.5::DOUBLE)*50/height AS py, mask FROM fl, hd) p
              ON {_STRICT} GROUP BY zone_id""",
        "fl",
        "hd",
        "zones",
    ),
)
def zone_flood_stats(spark, folder):
    """Flooded share per zone; the raster is laid over the zone layer."""
    pairs = change.with_change(
        change.align(fixtures.pre_raster(spark, folder), fixtures.post_raster(spark, folder), how="inner")
    )
    placed = pairs.select(
        ((F.col("x") + 0.5) * 50 / WIDTH).alias("px"),
        ((F.col("y") + 0.5) * 50 / fixtures.height(spark, folder)).alias("py"),
        "mask",
    )
    stats = spatial.zone_stats(placed, _zones(spark, folder))
    return stats.withColumn("share", snap(F.try_divide(F.col("flooded") * 100.0, F.col("pixels")), 5))


def _utm_sql() -> str:
    """Transverse Mercator series for zone 46 as SQL over lon, lat."""
    al = [f"{c!r}::DOUBLE" for c in geo._ALPHA]
    ecc, scale = f"{geo._ECC!r}::DOUBLE", f"{geo.UTM_K0 * geo._RECT!r}::DOUBLE"
    east = "eta" + "".join(f" + {a}*cos({2 * j}*xi)*sinh({2 * j}*eta)" for j, a in enumerate(al, 1))
    north = "xi" + "".join(f" + {a}*sin({2 * j}*xi)*cosh({2 * j}*eta)" for j, a in enumerate(al, 1))
    return f"""SELECT point_id, {snap_sql(f'500000 + {scale}*({east})', 3)} AS easting, {snap_sql(f'{scale}*({north})', 3)} AS northing,
        {snap_sql('lon', 7)} AS lon, {snap_sql('lat', 7)} AS lat
      FROM (SELECT point_id, lon, lat, atan2(t, cos(lam)) AS xi, atanh(sin(lam)/sqrt(1 + t*t)) AS eta
            FROM (SELECT point_id, lon, lat, radians(lon - 93) AS lam,
                    sinh(atanh(sin(radians(lat))) - {ecc}*atanh({ecc}*sin(radians(lat)))) AS t
                  FROM (SELECT point_id, 90.01::DOUBLE + px*0.1::DOUBLE AS lon, 20.03::DOUBLE + py*0.2::DOUBLE AS lat FROM points) a) b) c"""


@query("to_utm", sql(_utm_sql(), "points"))
def to_utm(spark, folder):
    """Lon/lat to UTM zone 46 north and back again."""
    geog = fixtures.points(spark, folder).select(
        "point_id", (F.lit(90.01) + F.col("px") * 0.1).alias("lon"), (F.lit(20.03) + F.col("py") * 0.2).alias("lat")
    )
    east, north = geo.lonlat_to_utm(F.col("lon"), F.col("lat"), 46)
    metric = geog.select("point_id", east.alias("e"), north.alias("n"))
    lon, lat = geo.utm_to_lonlat(F.col("e"), F.col("n"), 46)
    return metric.select(
        "point_id", snap(F.col("e"), 3).alias("easting"), snap(F.col("n"), 3).alias("northing"),
        snap(lon, 7).alias("lon"), snap(lat, 7).alias("lat"),
    )


@query(
    "explode_parts",
    sql(
        """SELECT zone_id, CAST(0 AS BIGINT) AS part, CAST(zx AS DOUBLE) AS x0 FROM zones
           UNION ALL SELECT zone_id, 1, CAST(zx + 100 AS DOUBLE) FROM zones""",
        "zones",
    ),
)
def explode_parts(spark, folder):
    """Two-part geometries, one row per part."""
    zones = _zones(spark, folder)
    moved = F.transform("ring", lambda p: F.struct((p.x + 100).alias("x"), p.y.alias("y")))
    parts = zones.withColumn("parts", F.array(F.col("ring"), moved))
    flat = parts.select("zone_id", F.posexplode("parts").alias("part", "one"))
    return flat.select("zone_id", F.col("part").cast("bigint").alias("part"), geo.ring_bbox(F.col("one")).x0.alias("x0"))


_U = "((l_orderkey*7919 + l_linenumber*104729 + 12345) % 1000003)/CAST(1000003 AS DOUBLE)"
_V = "((l_partkey*15485863 + l_suppkey*32452843 + l_orderkey*7907) % 1000003)/CAST(1000003 AS DOUBLE)"


@query(
    "monte_carlo_pi",
    f"""SELECT count(*) AS points, CAST(sum(CASE WHEN u*u + v*v <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS inside
        FROM (SELECT {_U} AS u, {_V} AS v FROM lineitem) s""",
)
def monte_carlo_pi(spark, folder):
    """Share of hashed points inside the quarter circle; one point per order line."""
    points = table(spark, folder, "lineitem").select(F.expr(_U).alias("u"), F.expr(_V).alias("v"))
    inside = F.col("u") * F.col("u") + F.col("v") * F.col("v") <= 1
    return points.agg(F.count("*").alias("points"), F.sum(inside.cast("int")).alias("inside"))
