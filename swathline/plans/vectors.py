"""Masks to vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.functions.numeric import snap, snap_sql
from swathline.operators import change, chunk_focal, chunks, polygons, vectorize
from swathline.plans.fragments import sql
from swathline.plans.registry import query
from swathline.session import cut_lineage
from swathline.sources import fixtures

TILE, WIDTH = fixtures.TILE, fixtures.WIDTH


def _mask(spark, folder):
    """Pixels whose mask value exceeds one half, as (y, x)."""
    pairs = change.with_change(
        change.align(fixtures.pre_raster(spark, folder), fixtures.post_raster(spark, folder), how="inner")
    )
    return pairs.filter(F.col("mask") > 0.5).select("y", "x")


def _components_sql(cells: str, name: str = "cc", label: str = "0") -> str:
    """Connected components of a (y, x) table, of equal label, by relaxing labels along a growing frontier."""
    right, below = "b.l = a.l AND b.y = a.y AND b.x = a.x + 1", "b.l = a.l AND b.x = a.x AND b.y = a.y + 1"
    return f"""{name}_n AS (SELECT y*256 + x AS id, y, x, {label} AS l FROM {cells}),
  {name}_e AS (SELECT a.id AS s, b.id AS d FROM {name}_n a JOIN {name}_n b ON {right}
        UNION ALL SELECT b.id, a.id FROM {name}_n a JOIN {name}_n b ON {right}
        UNION ALL SELECT a.id, b.id FROM {name}_n a JOIN {name}_n b ON {below}
        UNION ALL SELECT b.id, a.id FROM {name}_n a JOIN {name}_n b ON {below}),
  {name}(id, component) USING KEY (id) AS (
    SELECT id, id FROM {name}_n
    UNION
    SELECT e.d, min(f.component) FROM {name} f JOIN {name}_e e ON e.s = f.id JOIN recurring.{name} r ON r.id = e.d
    WHERE f.component < r.component GROUP BY e.d)"""


@query(
    "connected_components",
    sql(
        f"""WITH RECURSIVE m AS (SELECT y, x FROM fl WHERE mask = 1), {_components_sql('m')}
            SELECT id//256 AS y, id%256 AS x, component FROM cc""",
        "fl",
    ),
)
def connected_components(spark, folder):
    return vectorize.connected_components(_mask(spark, folder), WIDTH, TILE)


_RINGS = f"""WITH RECURSIVE m AS (SELECT y, x FROM fl WHERE mask = 1), {_components_sql('m')},
 p AS (SELECT id, id//256 AS y, id%256 AS x, component FROM cc),
 ed AS (SELECT id*4 AS e, id, component, 0 AS side, y AS sy, x + 1 AS sx, y AS ey, x AS ex FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.y = p.y - 1 AND q.x = p.x)
   UNION ALL SELECT id*4 + 1, id, component, 1, y, x, y + 1, x FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.y = p.y AND q.x = p.x - 1)
   UNION ALL SELECT id*4 + 2, id, component, 2, y + 1, x, y + 1, x + 1 FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.y = p.y + 1 AND q.x = p.x)
   UNION ALL SELECT id*4 + 3, id, component, 3, y + 1, x + 1, y, x + 1 FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.y = p.y AND q.x = p.x + 1)),
 st AS (SELECT *, count(*) OVER (PARTITION BY sy, sx) AS choices FROM ed),
 nx AS (SELECT a.e, b.e AS nxt, a.component, a.side <> b.side AS corner, a.ey AS vy, a.ex AS vx, a.ex*a.sy - a.sx*a.ey AS twice
        FROM ed a JOIN st b ON b.sy = a.ey AND b.sx = a.ex WHERE b.choices = 1 OR b.id = a.id),
 rg(e, ring) USING KEY (e) AS (
    SELECT e, e FROM nx
    UNION
    SELECT n.nxt, min(f.ring) FROM rg f JOIN nx n ON n.e = f.e JOIN recurring.rg r ON r.e = n.nxt WHERE f.ring < r.ring GROUP BY n.nxt),
 pr AS (SELECT component, ring, sum(twice) AS twice, count(*) AS len, sum(corner::INT) AS corners, min(vy) AS min_y, max(vy) AS max_y,
          min(vx) AS min_x, max(vx) AS max_x FROM nx JOIN rg USING (e) GROUP BY component, ring)
"""


@query(
    "polygonize",
    sql(
        _RINGS
        + """SELECT component, count(*) AS rings, CAST(sum(CASE WHEN twice < 0 THEN 1 ELSE 0 END) AS BIGINT) AS holes,
               CAST(sum(len) AS BIGINT) AS perimeter, CAST(sum(corners) AS BIGINT) AS corners, CAST(any_value(n) AS DOUBLE) AS area,
               min(min_y) AS min_y, max(max_y) AS max_y, min(min_x) AS min_x, max(max_x) AS max_x
             FROM pr JOIN (SELECT component, count(*) AS n FROM cc GROUP BY component) c USING (component) GROUP BY component""",
        "fl",
    ),
)
def polygonize(spark, folder):
    """Regions of mask value 1 as rings; the area comes from the traced vertices."""
    rings = polygons.rings(polygons.trace(_mask(spark, folder), WIDTH, TILE))
    return rings.groupBy("component").agg(
        F.count("*").alias("rings"), F.count_if("hole").alias("holes"), F.sum("length").alias("perimeter"),
        F.sum("corners").alias("corners"), F.sum("area").alias("area"),
        *[F.min(c).alias(c) if c.startswith("min") else F.max(c).alias(c) for c in ("min_y", "max_y", "min_x", "max_x")],
    )


@query(
    "polygon_rings",
    sql(
        _RINGS
        + """SELECT p.ring, p.component, p.twice < 0 AS hole, s.ring AS shell, CAST(p.len AS BIGINT) AS length,
               CAST(p.corners AS BIGINT) AS corners, CAST(p.twice / 2 AS DOUBLE) AS area
             FROM pr p JOIN pr s ON s.component = p.component AND s.twice > 0""",
        "fl",
    ),
)
def polygon_rings(spark, folder):
    """Every ring of the mask's regions, holes with the shell that they lie in."""
    rings = polygons.rings(polygons.trace(_mask(spark, folder), WIDTH, TILE))
    return rings.select("ring", "component", "hole", "shell", "length", "corners", "area")


@query(
    "polygon_geometry",
    sql(
        _RINGS
        + f""", tw AS (SELECT component, count(*) AS n FROM (SELECT component, sy, sx FROM ed GROUP BY ALL HAVING count(*) = 2) GROUP BY 1)
             SELECT p.component, CAST(count(*) - 1 + coalesce(any_value(tw.n), 0) AS BIGINT) AS holes,
               CAST(sum(corners) + count(*) + coalesce(any_value(tw.n), 0) AS BIGINT) AS points,
               CAST(any_value(c.n) AS BIGINT) AS cells,
               {snap_sql("-3.65 + min(min_x) * 0.0001", 6)} AS west, {snap_sql("-3.65 + max(max_x) * 0.0001", 6)} AS east,
               {snap_sql("56.75 - max(max_y) * 0.0001", 6)} AS south, {snap_sql("56.75 - min(min_y) * 0.0001", 6)} AS north
             FROM pr p JOIN (SELECT component, count(*) AS n FROM cc GROUP BY component) c USING (component)
               LEFT JOIN tw USING (component) GROUP BY p.component""",
        "fl",
    ),
)
def polygon_geometry(spark, folder):
    """The regions as WKT and GeoJSON in map coordinates, read back: points, holes and area of the one, bounds of the other.

    A ring that meets itself in a corner is cut there, which gives one more hole for each such corner.
    """
    found = polygons.geometry(polygons.trace(_mask(spark, folder), WIDTH, TILE), fixtures.AFFINE)
    loops = F.transform(
        F.regexp_extract_all("wkt", F.lit(r"\(([^()]*)\)"), 1),
        lambda ring: F.transform(F.split(ring, ", "), lambda p: F.split(p, " ").cast("array<double>")),
    )
    points = F.from_json("geojson", "coordinates array<array<array<double>>>")["coordinates"]
    read = found.select("component", loops.alias("loops"), F.flatten(points).alias("points"))
    # Coordinates from the first point on, so that the sum of products keeps its digits.
    x0, y0 = F.col("loops")[0][0][0], F.col("loops")[0][0][1]
    parts = F.transform(
        "loops",
        lambda ring: F.zip_with(
            F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1),
            lambda a, b: (a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0),
        ),
    )
    twice = F.aggregate(F.flatten(parts), F.lit(0.0), lambda total, part: total + part)
    cell = abs(fixtures.AFFINE.a * fixtures.AFFINE.e)
    xs, ys = F.transform("points", lambda p: p[0]), F.transform("points", lambda p: p[1])
    return read.select(
        "component", (F.size("loops") - 1).cast("bigint").alias("holes"), F.size("points").cast("bigint").alias("points"),
        F.round(F.abs(twice) / 2 / cell).cast("bigint").alias("cells"),
        snap(F.array_min(xs), 6).alias("west"), snap(F.array_max(xs), 6).alias("east"),
        snap(F.array_min(ys), 6).alias("south"), snap(F.array_max(ys), 6).alias("north"),
    )


@query(
    "dissolve_regions",
    sql(
        f"""WITH RECURSIVE {_components_sql('tr', label='label')},
             p AS (SELECT c.id, n.y, n.x, n.l, component FROM cc c JOIN cc_n n USING (id)),
             ou AS (SELECT a.l, count(*) AS perimeter
                    FROM p a CROSS JOIN (SELECT 0 AS dy, 1 AS dx UNION ALL SELECT 0, -1 UNION ALL SELECT 1, 0 UNION ALL SELECT -1, 0) o
                    LEFT JOIN p b ON b.y = a.y + dy AND b.x = a.x + dx AND b.l = a.l WHERE b.y IS NULL GROUP BY a.l)
            SELECT p.l AS label, count(DISTINCT component) AS regions, CAST(count(*) AS DOUBLE) AS area, any_value(perimeter) AS perimeter
            FROM p JOIN ou ON ou.l = p.l GROUP BY p.l""",
        "tr",
    ),
)
def dissolve_regions(spark, folder):
    """Cells of each class dissolved to polygons: their number, area and outline."""
    rings = polygons.rings(polygons.trace(fixtures.truth(spark, folder), WIDTH, TILE, "label"))
    return rings.groupBy(F.col("class").cast("int").alias("label")).agg(
        F.count_if(~F.col("hole")).alias("regions"), F.sum("area").alias("area"), F.sum("length").alias("perimeter")
    )


@query(
    "buffer_merge",
    sql(
        f"""WITH RECURSIVE m AS (SELECT DISTINCT y + dy AS y, x + dx AS x FROM fl, hd, (SELECT unnest(range(-1, 2)) AS dy) a, (SELECT unnest(range(-1, 2)) AS dx) b
              WHERE mask = 1 AND y + dy BETWEEN 0 AND height - 1 AND x + dx BETWEEN 0 AND 255), {_components_sql('m')}
            SELECT component, count(*) AS n_pixels, CAST(sum(CASE WHEN s.y IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_source
            FROM cc LEFT JOIN (SELECT y, x FROM fl WHERE mask = 1) s ON s.y = cc.id//256 AND s.x = cc.id%256 GROUP BY component""",
        "fl",
        "hd",
    ),
)
def buffer_merge(spark, folder):
    """10 m buffer on 10 m pixels, then the union of what touches."""
    mask = cut_lineage(_mask(spark, folder))
    height = fixtures.height(spark, folder)
    merged = vectorize.connected_components(vectorize.dilate(mask, 1, WIDTH, height), WIDTH, TILE)
    flagged = merged.join(mask.withColumn("source", F.lit(1)), ["y", "x"], "left")
    return flagged.groupBy("component").agg(
        F.count("*").alias("n_pixels"), F.count("source").alias("n_source")
    )


#: Cells of the buffer queries are 10 m high and 7 m wide; the buffer reaches 25 m.
_CELL, _REACH = (10.0, 7.0), 25.0
_BUFFERED = """bu AS (SELECT m.y + dy AS y, m.x + dx AS x, min(sqrt((dy*10.0::DOUBLE)**2 + (dx*7.0::DOUBLE)**2)) AS distance
    FROM m, hd, (SELECT unnest(range(-3, 4)) AS dy) a, (SELECT unnest(range(-4, 5)) AS dx) b
    WHERE m.y + dy BETWEEN 0 AND height - 1 AND m.x + dx BETWEEN 0 AND 255
      AND sqrt((dy*10.0::DOUBLE)**2 + (dx*7.0::DOUBLE)**2) <= 25 GROUP BY ALL)"""


def _buffered(spark, folder):
    mask = _mask(spark, folder).select(F.lit(0).alias("scene"), F.lit(1).alias("band"), "y", "x", F.lit(1.0).alias("value"))
    stored = cut_lineage(chunks.to_chunks(mask, WIDTH, TILE))
    return chunk_focal.buffer(stored, TILE, WIDTH, fixtures.height(spark, folder), _REACH, _CELL)


@query(
    "buffer_distance",
    sql(f"WITH m AS (SELECT y, x FROM fl WHERE mask = 1), {_BUFFERED} SELECT y, x, {snap_sql('distance', 6)} AS distance FROM bu", "fl", "hd"),
)
def buffer_distance(spark, folder):
    """Metres from every cell within 25 m of the mask to its nearest cell."""
    return _buffered(spark, folder).select("y", "x", snap(F.col("distance"), 6).alias("distance"))


@query(
    "buffer_polygons",
    sql(
        f"""WITH RECURSIVE m AS (SELECT y, x FROM fl WHERE mask = 1), {_BUFFERED}, {_components_sql('bu')},
             ou AS (SELECT a.component, count(*) AS perimeter
                    FROM (SELECT id//256 AS y, id%256 AS x, component FROM cc) a
                    CROSS JOIN (SELECT 0 AS dy, 1 AS dx UNION ALL SELECT 0, -1 UNION ALL SELECT 1, 0 UNION ALL SELECT -1, 0) o
                    LEFT JOIN bu b ON b.y = a.y + dy AND b.x = a.x + dx WHERE b.y IS NULL GROUP BY a.component)
            SELECT component, CAST(count(*) * 70 AS DOUBLE) AS square_metres, any_value(perimeter) AS perimeter
            FROM cc JOIN ou USING (component) GROUP BY component""",
        "fl",
        "hd",
    ),
)
def buffer_polygons(spark, folder):
    """The 25 m buffer of the mask dissolved to polygons: area and outline of each."""
    rings = polygons.rings(polygons.trace(_buffered(spark, folder), WIDTH, TILE))
    return rings.groupBy("component").agg(
        (F.sum("area") * (_CELL[0] * _CELL[1])).alias("square_metres"), F.sum("length").alias("perimeter")
    )


@query(
    "dissolve",
    sql(
        """SELECT a.label, count(*) AS perimeter, min(a.y) AS min_y, max(a.x) AS max_x
           FROM tr a CROSS JOIN (SELECT 0 AS dy, 1 AS dx UNION ALL SELECT 0, -1 UNION ALL SELECT 1, 0 UNION ALL SELECT -1, 0) o
           LEFT JOIN tr b ON b.y = a.y + dy AND b.x = a.x + dx AND b.label = a.label WHERE b.y IS NULL GROUP BY a.label""",
        "tr",
    ),
)
def dissolve(spark, folder):
    """Cells of one class dissolved: inner edges vanish, the outline stays."""
    outline = vectorize.boundary_edges(fixtures.truth(spark, folder), "label")
    return outline.groupBy("label").agg(
        F.count("*").alias("perimeter"), F.min("y").alias("min_y"), F.max("x").alias("max_x")
    )


@query("simplify_rings")
def simplify_rings(spark, folder):
    """Douglas-Peucker over the corner vertices of all mask rings, tolerance one pixel."""
    corners = polygons.vertices(polygons.trace(_mask(spark, folder), WIDTH, TILE)).select("ring", "seq", "vx", "vy")
    simple = vectorize.simplify_rings(corners, 1.0)
    return simple.groupBy("ring").agg(F.count("*").alias("vertices"), F.min("vx").alias("min_x"), F.max("vy").alias("max_y"))
