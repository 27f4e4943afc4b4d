"""Change detection, thresholds, raster algebra and mask reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.functions.numeric import intdiv, percent, snap, snap_sql
from swathline.functions.tiling import tile_grid as grid_of
from swathline.functions.tiling import with_tile_box
from swathline.operators import change, otsu
from swathline.plans.fragments import DIFF, sql
from swathline.plans.registry import query
from swathline.session import scratch_path
from swathline.sources import fixtures, raster

TILE, WIDTH = fixtures.TILE, fixtures.WIDTH


def _pairs(spark, folder, how="inner"):
    aligned = change.align(fixtures.pre_raster(spark, folder), fixtures.post_raster(spark, folder), how=how)
    return change.with_change(aligned)


def _tiles(spark, folder):
    return change.flood_tiles(
        fixtures.pre_raster(spark, folder), fixtures.post_raster(spark, folder), fixtures.header(spark, folder), TILE
    )


_BOUNDS = (
    snap_sql("CASE WHEN ok THEN -3.65::DOUBLE + x0*0.0001::DOUBLE END", 6) + " AS min_lon, "
    + snap_sql("CASE WHEN ok THEN 56.75::DOUBLE + (y0+h)*(-0.0001)::DOUBLE END", 6) + " AS min_lat, "
    + snap_sql("CASE WHEN ok THEN -3.65::DOUBLE + (x0+w)*0.0001::DOUBLE END", 6) + " AS max_lon, "
    + snap_sql("CASE WHEN ok THEN 56.75::DOUBLE + y0*(-0.0001)::DOUBLE END", 6) + " AS max_lat"
)


def _snapped(tiles):
    return tiles.withColumns({c: snap(F.col(c), 6) for c in ("min_lon", "min_lat", "max_lon", "max_lat")})


_TILES_SQL = sql(
    f"""SELECT tile_id, CASE WHEN ok THEN hits ELSE 0 END AS pixel_count,
          CASE WHEN ok THEN 'SUCCESS' ELSE 'EMPTY_LAND' END AS status,
          '(' || height || ', 256)' AS raster_shape, '(' || h || ', ' || w || ')' AS tile_shape, {_BOUNDS}
        FROM (SELECT t.*, f.hits, f.max_pre > 0 AS ok, height
              FROM tiles t JOIN (SELECT tile_id, CAST(sum(mask) AS BIGINT) AS hits, max(pre) AS max_pre
                                 FROM fl GROUP BY tile_id) f USING (tile_id), hd) s
        ORDER BY tile_id""",
    "fl",
    "tiles",
)


@query("flood_tiles", _TILES_SQL)
def flood_tiles(spark, folder):
    return _snapped(_tiles(spark, folder)).orderBy("tile_id")


@query("flood_tiles_chunked", _TILES_SQL)
def flood_tiles_chunked(spark, folder):
    """The chunk-store form: both rasters stored in buckets by tile, joined without an exchange."""
    stored = []
    for scene in (fixtures.pre_raster(spark, folder), fixtures.post_raster(spark, folder)):
        path = scratch_path(spark, "chunks")
        name = "chunks_" + path.rsplit("-", 1)[1]
        stored.append(raster.store_chunks(raster.rechunk(scene, TILE, WIDTH), name, path, buckets=8))
    return _snapped(change.flood_tiles_chunked(*stored, fixtures.header(spark, folder), TILE))


@query(
    "flood_tiles_gaps",
    sql(
        """SELECT tile_id,
             CASE WHEN n_pre = 0 THEN 'EMPTY_TILE' WHEN n_pre <> n_post THEN 'ERROR : shape mismatch'
                  WHEN max_pre <= 0 THEN 'EMPTY_LAND' ELSE 'SUCCESS' END AS status,
             CASE WHEN n_pre = 0 OR n_pre <> n_post OR max_pre <= 0 THEN 0 ELSE hits END AS pixel_count
           FROM (SELECT tile_id, count(CASE WHEN pre > 0 THEN 1 END) AS n_pre, count(CASE WHEN x < 240 THEN 1 END) AS n_post,
                   max(pre) AS max_pre, CAST(sum(CASE WHEN pre > 0 AND x < 240 THEN mask ELSE 0 END) AS BIGINT) AS hits
                 FROM fl GROUP BY tile_id) s""",
        "fl",
    ),
)
def flood_tiles_gaps(spark, folder):
    """Rasters of unlike coverage: no pre pixel where there is no signal, a narrower post swath."""
    pre = fixtures.pre_raster(spark, folder).filter(F.col("value") > 0)
    post = fixtures.post_raster(spark, folder).filter(F.col("x") < 240)
    shape = fixtures.header(spark, folder)
    height = fixtures.base_pixels(spark, folder).agg(F.max("y") + 1).first()[0]
    grid = grid_of(spark, height, WIDTH, TILE)
    return change.flood_tiles(pre, post, shape, TILE, grid=grid).select("tile_id", "status", "pixel_count")


@query(
    "flood_mask",
    sql(f"SELECT y, x, {snap_sql('diff_db', 6)} AS diff_db, mask FROM fl", "fl"),
)
def flood_mask(spark, folder):
    return _pairs(spark, folder).select("y", "x", snap(F.col("diff_db"), 6).alias("diff_db"), "mask")


@query(
    "flood_total",
    sql("SELECT CAST(sum(mask) AS BIGINT) AS flooded_pixels, count(DISTINCT tile_id) AS tiles FROM fl", "fl"),
)
def flood_total(spark, folder):
    return change.flood_total(_tiles(spark, folder))


_OTSU = f"""WITH d AS (SELECT tile_id, pre, {DIFF} AS d FROM po),
 rng AS (SELECT tile_id, min(d) AS lo, max(d) AS hi, max(pre) AS max_pre,
           CAST(sum(CASE WHEN d < -5.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_fixed FROM d GROUP BY tile_id),
 hist AS (SELECT tile_id, CASE WHEN hi = lo THEN 0 ELSE least(255, floor((d - lo)/(hi - lo)*256)) END AS bin, count(*) AS n
          FROM d JOIN rng USING (tile_id) GROUP BY 1, 2),
 bins AS (SELECT r.tile_id, b.i AS bin, lo, hi, lo + (b.i + 0.5::DOUBLE)*(hi - lo)/256 AS c,
            coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY r.tile_id) AS f
          FROM rng r CROSS JOIN (SELECT unnest(range(256)) AS i) b
          LEFT JOIN hist h ON h.tile_id = r.tile_id AND h.bin = b.i),
 cls AS (SELECT tile_id, bin, c, lo, hi,
           sum(f) OVER up AS w1, sum(f*c) OVER up AS s1, sum(f) OVER dn AS w2, sum(f*c) OVER dn AS s2 FROM bins
         WINDOW up AS (PARTITION BY tile_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                dn AS (PARTITION BY tile_id ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
 scored AS (SELECT tile_id, bin, c, lo, hi, round(w1*w2*(s1/w1 - s2/nullif(w2, 0))*(s1/w1 - s2/nullif(w2, 0)), 9) AS v FROM cls),
 best AS (SELECT tile_id, CASE WHEN lo = hi THEN lo ELSE c END AS thr FROM
            (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY v DESC NULLS LAST, bin) AS rn FROM scored) s WHERE rn = 1)
"""


@query(
    "otsu_threshold",
    sql(_OTSU + f"SELECT tile_id, {snap_sql('thr', 6)} AS threshold FROM best", "po"),
)
def otsu_threshold(spark, folder):
    limits = otsu.thresholds(otsu.histograms(fixtures.px_otsu(spark, folder)))
    return limits.select("tile_id", snap(F.col("threshold"), 6).alias("threshold"))


@query(
    "flood_tiles_otsu",
    sql(
        _OTSU
        + f"""SELECT tile_id, pixel_count, status, {snap_sql('used', 6)} AS threshold,
               CASE WHEN pixel_count > 0 THEN 'masks/tile_id=' || tile_id END AS mask_path
             FROM (SELECT tile_id, status, used, CASE WHEN status = 'EMPTY_OR_NODATA' THEN 0 ELSE hits END AS pixel_count
                   FROM (SELECT r.tile_id, max(st.status) AS status, max(st.used) AS used,
                           CAST(sum(CASE WHEN d < st.used THEN 1 ELSE 0 END) AS BIGINT) AS hits
                         FROM rng r JOIN d ON d.tile_id = r.tile_id
                         JOIN (SELECT rng.tile_id, CASE WHEN max_pre <= 0 THEN 'EMPTY_OR_NODATA' WHEN thr < -3.0 THEN 'SUCCESS_OTSU'
                                   ELSE 'SUCCESS_FALLBACK' END AS status,
                                 CASE WHEN max_pre <= 0 THEN NULL WHEN thr < -3.0 THEN thr ELSE -5.5::DOUBLE END AS used
                               FROM rng JOIN best USING (tile_id)) st ON st.tile_id = r.tile_id
                         GROUP BY r.tile_id) a) b""",
        "po",
    ),
)
def flood_tiles_otsu(spark, folder):
    limits = otsu.thresholds(otsu.histograms(fixtures.px_otsu(spark, folder)))
    return otsu.flood_tiles(limits).withColumn("threshold", snap(F.col("threshold"), 6))


ALGEBRA = (
    "CASE WHEN 10*log10(greatest(b0, 1e-6D)) - 10*log10(greatest(b1, 1e-6D)) < -5.5 THEN 1 ELSE 0 END"
)


@query(
    "map_algebra",
    sql(
        """SELECT y, x, CASE WHEN 10*log10(greatest(pre, 1e-6)) - 10*log10(greatest(post, 1e-6)) < -5.5 THEN 1 ELSE 0 END
             AS brighter, mask AS darker FROM fl""",
        "fl",
    ),
)
def map_algebra(spark, folder):
    """The given expression in both operand orders; it marks a rise from b0 to b1."""
    pre, post = fixtures.pre_raster(spark, folder), fixtures.post_raster(spark, folder)
    pairs = change.align(pre, post, how="inner")
    forward = pairs.withColumnsRenamed({"pre": "b0", "post": "b1"})
    return forward.select(
        "y",
        "x",
        F.expr(ALGEBRA).alias("brighter"),
        F.expr(ALGEBRA.replace("b0", "bx").replace("b1", "b0").replace("bx", "b1")).alias("darker"),
    )


@query(
    "tile_grid",
    sql(
        """SELECT r*4 + c AS tile_id, r*64 AS y0, c*64 AS x0, least(64, height - r*64) AS h, CAST(64 AS BIGINT) AS w
           FROM hd, (SELECT unnest(range(4)) AS c) cc, (SELECT unnest(range((SELECT (max(y) + 64)//64 FROM px))) AS r) rr""",
        "hd",
    ),
)
def tile_grid(spark, folder):
    height = fixtures.base_pixels(spark, folder).agg(F.max("y") + 1).first()[0]
    return grid_of(spark, height, WIDTH, TILE)


@query(
    "tile_explode",
    sql("SELECT tile_id, y%64 AS ty, x%64 AS tx, pre AS value FROM px", "px"),
)
def tile_explode(spark, folder):
    return raster.explode_tiles(fixtures.pre_raster(spark, folder), TILE, WIDTH)


@query(
    "mosaic_first",
    sql(
        """SELECT y, x, arg_min(value, r) AS value, min(r) AS source FROM (
             SELECT y, x, pre AS value, 0 AS r FROM px
             UNION ALL SELECT y + 32, x + 32, post, 1 FROM px
             UNION ALL SELECT height - 1 - y, x, base, 2 FROM px, hd) s
           WHERE value <> 0 GROUP BY y, x""",
        "px",
        "hd",
    ),
)
def mosaic_first(spark, folder):
    """Three overlapping rasters: one in place, one shifted, one stored south-up."""
    pre, post = fixtures.pre_raster(spark, folder), fixtures.post_raster(spark, folder)
    shifted = post.withColumns({"y": F.col("y") + 32, "x": F.col("x") + 32})
    base = fixtures.base_pixels(spark, folder).select("y", "x", F.col("base").alias("value"))
    flipped = raster.flip_north_up(base, fixtures.height(spark, folder))
    return raster.mosaic_first([pre, shifted, flipped])


@query(
    "flip_north_up",
    sql("SELECT height - 1 - y AS y, x, pre AS value FROM px, hd", "px", "hd"),
)
def flip_north_up(spark, folder):
    return raster.flip_north_up(fixtures.pre_raster(spark, folder), fixtures.height(spark, folder))


@query(
    "align_common",
    sql("SELECT y, x, pre AS value FROM px, hd WHERE y < height - 7 AND x < 250", "px", "hd"),
)
def align_common(spark, folder):
    """The extent shared with a raster that is 7 rows and 6 columns smaller."""
    return change.common_extent(fixtures.pre_raster(spark, folder), fixtures.height(spark, folder) - 7, WIDTH - 6)


@query(
    "raster_compare",
    sql(
        f"""SELECT band, count(CASE WHEN in_base AND in_other THEN 1 END) AS n, count(CASE WHEN in_base AND NOT in_other THEN 1 END) AS only_base,
              count(CASE WHEN in_other AND NOT in_base THEN 1 END) AS only_other, min(a) AS base_min, max(a) AS base_max, {snap_sql('min(b)', 5)} AS other_min,
              {snap_sql('max(b)', 5)} AS other_max, {snap_sql('max(abs(b - a))', 5)} AS max_abs_diff,
              {snap_sql('sqrt(avg((b - a)*(b - a)))', 5)} AS rmse,
              CAST(sum(CASE WHEN abs(b - a) > 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS mismatched
            FROM (SELECT band, in_base, in_other, CASE WHEN in_base AND in_other THEN value END AS a,
                    CASE WHEN in_base AND in_other THEN CASE WHEN x%8 = 0 THEN value*1.01::DOUBLE ELSE value END END AS b
                  FROM (SELECT *, y >= 2 AS in_base, y < height - 5 AS in_other FROM bands, hd) t) s GROUP BY band""",
        "bands",
        "hd",
    ),
)
def raster_compare(spark, folder):
    """Two engines' outputs: the first lacks 2 rows, the second 5 others, and it is off by one percent in some columns."""
    whole = fixtures.bands(spark, folder).select("band", "y", "x", "value")
    off = F.when(F.col("x") % 8 == 0, F.col("value") * 1.01).otherwise(F.col("value"))
    second = change.common_extent(whole.withColumn("value", off), fixtures.height(spark, folder) - 5, WIDTH)
    got = change.compare(whole.filter(F.col("y") >= 2), second)
    return got.withColumns({c: snap(F.col(c), 5) for c in ("other_min", "other_max", "max_abs_diff", "rmse")})


@query(
    "ks_two_sample",
    sql(
        f"""WITH v AS (SELECT pre AS v, 1 AS a, 0 AS b FROM px UNION ALL SELECT post, 0, 1 FROM px),
             g AS (SELECT v, sum(a) AS a, sum(b) AS b FROM v GROUP BY v),
             c AS (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM g)
            SELECT {snap_sql('max(abs(ca/ta - cb/tb))', 8)} AS ks, CAST(max(ta) AS BIGINT) AS n_first, CAST(max(tb) AS BIGINT) AS n_second FROM c""",
        "px",
    ),
)
def ks_two_sample(spark, folder):
    got = change.ks_two_sample(fixtures.pre_raster(spark, folder), fixtures.post_raster(spark, folder))
    return got.withColumn("ks", snap(F.col("ks"), 8))


@query("preview_window", sql("SELECT y, x, pre AS value FROM px WHERE y < 128 AND x < 128", "px"))
def preview_window(spark, folder):
    return raster.window_scan(fixtures.pre_raster(spark, folder), 0, 0, 128, 128)


@query(
    "overview",
    sql(f"SELECT y//4 AS y, x//4 AS x, {snap_sql('avg(pre)', 6)} AS value, count(*) AS n FROM px GROUP BY 1, 2", "px"),
)
def overview(spark, folder):
    small = raster.overview(fixtures.pre_raster(spark, folder), 4)
    return small.withColumn("value", snap(F.col("value"), 6))


@query("nonzero_pixels", sql("SELECT y, x, post AS value FROM px WHERE post > 0 ORDER BY y, x LIMIT 10", "px"))
def nonzero_pixels(spark, folder):
    """The first ten pixels with a signal (a top-k report)."""
    return fixtures.post_raster(spark, folder).filter(F.col("value") > 0).orderBy("y", "x").limit(10)


@query("tiles_with_flood", sql("SELECT tile_id, max(-diff_db) > 10 AS deep FROM fl GROUP BY tile_id HAVING max(mask) > 0", "fl"))
def tiles_with_flood(spark, folder):
    """Tiles with any flooded pixel, and whether any loss exceeds 10 dB."""
    return (
        _pairs(spark, folder)
        .groupBy(fixtures.tile_of().alias("tile_id"))
        .agg(F.max("mask").alias("any"), (F.max(-F.col("diff_db")) > 10).alias("deep"))
        .filter(F.col("any") > 0)
        .select("tile_id", "deep")
    )


@query(
    "select_tiles",
    sql(
        f"""SELECT tile_id, {snap_sql('100.0::DOUBLE*sum(mask)/count(*)', 6)} AS share FROM fl GROUP BY tile_id
            HAVING 100.0*sum(mask)/count(*) >= 10""",
        "fl",
    ),
)
def select_tiles(spark, folder):
    return (
        _pairs(spark, folder)
        .groupBy(fixtures.tile_of().alias("tile_id"))
        .agg(percent(F.sum("mask"), F.count("*")).alias("share"))
        .filter(F.col("share") >= 10)
        .withColumn("share", snap(F.col("share"), 6))
    )


def _tile_files(spark, folder):
    """Tile file names on both sides; the post writer leaves out tiles without signal."""
    name = F.concat(F.lit("tile_"), F.col("tile_id").cast("string"), F.lit(".tif"))
    both = fixtures.px(spark, folder).groupBy("tile_id").agg(F.max("post").alias("top"))
    return both.select("tile_id", name.alias("name")), both.filter(F.col("top") > 0).select(name.alias("name"))


@query(
    "pair_tiles",
    sql(
        """SELECT tile_id, 'tile_' || tile_id || '.tif' AS name, CASE WHEN max(post) > 0 THEN 'PAIRED' ELSE 'MISSING_POST' END
             AS status FROM px GROUP BY tile_id""",
        "px",
    ),
)
def pair_tiles(spark, folder):
    pre, post = _tile_files(spark, folder)
    found = post.withColumn("found", F.lit(True))
    return pre.join(found, "name", "left").select(
        "tile_id", "name", F.when(F.col("found"), "PAIRED").otherwise("MISSING_POST").alias("status")
    )


@query("missing_post_tiles", sql("SELECT tile_id FROM px GROUP BY tile_id HAVING max(post) <= 0", "px"))
def missing_post_tiles(spark, folder):
    pre, post = _tile_files(spark, folder)
    return pre.join(post, "name", "left_anti").select("tile_id")


@query(
    "ground_truth_confusion",
    sql(
        """SELECT label AS truth, mask AS predicted, count(*) AS n
           FROM tr JOIN fl USING (y, x) WHERE label <> -9999 GROUP BY 1, 2""",
        "tr",
        "fl",
    ),
)
def ground_truth_confusion(spark, folder):
    labelled = fixtures.truth(spark, folder).filter(F.col("label") != -9999)
    predicted = _pairs(spark, folder).select("y", "x", "mask")
    both = labelled.join(predicted, ["y", "x"], "full")
    return both.filter(F.col("label").isNotNull()).groupBy(
        F.col("label").alias("truth"), F.coalesce("mask", F.lit(0)).alias("predicted")
    ).agg(F.count("*").alias("n"))


@query(
    "most_flooded_tile",
    sql("SELECT tile_id, CAST(sum(mask) AS BIGINT) AS pixel_count FROM fl GROUP BY tile_id ORDER BY 2 DESC, 1 LIMIT 1", "fl"),
)
def most_flooded_tile(spark, folder):
    tiles = _tiles(spark, folder)
    return tiles.orderBy(F.desc("pixel_count"), "tile_id").limit(1).select("tile_id", "pixel_count")


def _rule_and_otsu_masks(spark, folder):
    """Masks of the fixed rule on the plain pair and on the weakened pair."""
    fixed = _pairs(spark, folder).filter(F.col("mask") == 1).select("y", "x")
    weak = fixtures.px_otsu(spark, folder).select("y", "x", "pre", "post")
    other = change.with_change(weak, -4.0).filter(F.col("mask") == 1).select("y", "x")
    return fixed, other


_MASK2 = f"SELECT y, x FROM po WHERE {DIFF} < -4.0"


@query("mask_except", sql(f"SELECT y, x FROM fl WHERE mask = 1 EXCEPT ({_MASK2})", "fl", "po"))
def mask_except(spark, folder):
    fixed, other = _rule_and_otsu_masks(spark, folder)
    return fixed.exceptAll(other)


@query("mask_intersect", sql(f"SELECT y, x FROM fl WHERE mask = 1 INTERSECT ({_MASK2})", "fl", "po"))
def mask_intersect(spark, folder):
    fixed, other = _rule_and_otsu_masks(spark, folder)
    return fixed.intersect(other)


@query(
    "tile_bounds",
    sql(f"SELECT tile_id, h, w, {_BOUNDS} FROM (SELECT *, TRUE AS ok FROM tiles) t", "tiles"),
)
def tile_bounds(spark, folder):
    from swathline.functions.tiling import tile_bounds as bounds

    head = fixtures.header(spark, folder)
    ids = fixtures.pre_raster(spark, folder).select(fixtures.tile_of().alias("tile_id")).distinct()
    boxed = with_tile_box(ids, head, TILE)
    return _snapped(boxed.select("tile_id", "h", "w", *[c.alias(n) for n, c in bounds(head).items()]))
