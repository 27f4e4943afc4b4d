"""Several scenes in one call, on dense chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.functions.numeric import snap, snap_sql
from swathline.operators import chunk_focal, chunks
from swathline.plans.flood import _BOUNDS, _snapped
from swathline.plans.fragments import DIFF, sql
from swathline.plans.neighbourhood import _LEE, _window_sql
from swathline.plans.registry import query
from swathline.session import cut_lineage
from swathline.sources import fixtures

TILE, WIDTH = fixtures.TILE, fixtures.WIDTH


def _scenes(spark, folder):
    """(chunks, scenes): the pair itself, the pair with weak change, and the pair with gaps on either side."""
    plain = fixtures.px(spark, folder).select("y", "x", "pre", "post")
    weak = fixtures.px_otsu(spark, folder).select("y", "x", "pre", "post")
    gaps = plain.select(
        "y", "x", F.when(F.col("pre") > 0, F.col("pre")).alias("pre"), F.when(F.col("x") < 240, F.col("post")).alias("post")
    )
    stacked = None
    for scene, pair in enumerate((plain, weak, gaps)):
        bands = pair.selectExpr(f"{scene} AS scene", "y", "x", "stack(2, 1, pre, 2, post) AS (band, value)").dropna(subset=["value"])
        stacked = bands if stacked is None else stacked.unionByName(bands)
    stored = cut_lineage(chunks.to_chunks(stacked, WIDTH, TILE))
    heads = spark.range(3).select(F.col("id").alias("scene"), fixtures.height(spark, folder).alias("height"))
    return stored, heads


#: All three scenes as (scene, tile_id, y, x, pre, post), with NULL where a raster has no pixel.
_PAIRS = """sc AS (SELECT 0 AS scene, tile_id, y, x, pre, post FROM px UNION ALL SELECT 1, tile_id, y, x, pre, post FROM po
  UNION ALL SELECT 2, tile_id, y, x, CASE WHEN pre > 0 THEN pre END, CASE WHEN x < 240 THEN post END FROM px),
 gr AS (SELECT s.scene, t.tile_id, t.tile_id//4*64 AS y0, t.tile_id%4*64 AS x0, least(64, height - t.tile_id//4*64) AS h, 64 AS w, height
        FROM (SELECT unnest(range(3)) AS scene) s, hd, LATERAL (SELECT unnest(range(((height + 63)//64)*4)) AS tile_id) t)"""


@query(
    "scene_flood_tiles",
    sql(
        f"""WITH {_PAIRS}, st AS (SELECT scene, tile_id, count(pre) AS n_pre, count(post) AS n_post, max(pre) AS max_pre,
              count(CASE WHEN pre IS NOT NULL THEN post END) AS n_both,
              CAST(sum(CASE WHEN {DIFF} < -5.5 AND pre IS NOT NULL AND post IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS hits
            FROM sc GROUP BY 1, 2),
          j AS (SELECT gr.*, hits, CASE WHEN coalesce(n_pre, 0) = 0 THEN 'EMPTY_TILE'
                  WHEN n_pre <> n_post OR n_both <> n_pre THEN 'ERROR : shape mismatch'
                  WHEN max_pre <= 0 THEN 'EMPTY_LAND' ELSE 'SUCCESS' END AS status
                FROM gr LEFT JOIN st ON st.scene = gr.scene AND st.tile_id = gr.tile_id)
          SELECT scene, tile_id, CASE WHEN ok THEN hits ELSE 0 END AS pixel_count, status,
            '(' || height || ', 256)' AS raster_shape, '(' || h || ', ' || w || ')' AS tile_shape, {_BOUNDS}
          FROM (SELECT *, status = 'SUCCESS' AS ok FROM j) s""",
        "px", "po", "hd",
    ),
)
def scene_flood_tiles(spark, folder):
    stored, heads = _scenes(spark, folder)
    return _snapped(chunks.flood_tiles(stored, heads, WIDTH, fixtures.AFFINE, TILE))


_OTSU = f"""WITH {_PAIRS}, d AS (SELECT scene, tile_id, pre, CASE WHEN pre IS NOT NULL AND post IS NOT NULL THEN {DIFF} END AS d FROM sc),
 rng AS (SELECT scene, tile_id, min(d) AS lo, max(d) AS hi, max(pre) AS max_pre,
           CAST(sum(CASE WHEN d < -5.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_fixed FROM d GROUP BY ALL),
 hist AS (SELECT scene, tile_id, CASE WHEN hi = lo THEN 0 ELSE least(255, floor((d - lo)/(hi - lo)*256)) END AS bin, count(*) AS n
          FROM d JOIN rng USING (scene, tile_id) WHERE d IS NOT NULL GROUP BY ALL),
 bins AS (SELECT r.scene, r.tile_id, b.i AS bin, lo, hi, lo + (b.i + 0.5::DOUBLE)*(hi - lo)/256 AS c,
            coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY r.scene, r.tile_id) AS f
          FROM rng r CROSS JOIN (SELECT unnest(range(256)) AS i) b
          LEFT JOIN hist h ON h.scene = r.scene AND h.tile_id = r.tile_id AND h.bin = b.i WHERE lo IS NOT NULL),
 cls AS (SELECT scene, tile_id, bin, c, lo, hi,
           sum(f) OVER up AS w1, sum(f*c) OVER up AS s1, sum(f) OVER dn AS w2, sum(f*c) OVER dn AS s2 FROM bins
         WINDOW up AS (PARTITION BY scene, tile_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                dn AS (PARTITION BY scene, tile_id ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
 scored AS (SELECT *, round(w1*w2*(s1/w1 - s2/nullif(w2, 0))*(s1/w1 - s2/nullif(w2, 0)), 9) AS v FROM cls),
 best AS (SELECT scene, tile_id, CASE WHEN lo = hi THEN lo ELSE c END AS thr FROM
            (SELECT *, row_number() OVER (PARTITION BY scene, tile_id ORDER BY v DESC NULLS LAST, bin) AS rn FROM scored) s WHERE rn = 1),
 st AS (SELECT gr.scene, gr.tile_id, CASE WHEN coalesce(max_pre, 0) <= 0 THEN 'EMPTY_OR_NODATA' WHEN thr IS NULL THEN 'SUCCESS_FIXED'
            WHEN thr < -3.0 THEN 'SUCCESS_OTSU' ELSE 'SUCCESS_FALLBACK' END AS status, thr
        FROM gr LEFT JOIN rng ON rng.scene = gr.scene AND rng.tile_id = gr.tile_id
          LEFT JOIN best ON best.scene = gr.scene AND best.tile_id = gr.tile_id),
 us AS (SELECT *, CASE status WHEN 'EMPTY_OR_NODATA' THEN NULL WHEN 'SUCCESS_OTSU' THEN thr ELSE -5.5::DOUBLE END AS used FROM st)"""


@query(
    "scene_flood_otsu",
    sql(
        _OTSU
        + f"""SELECT scene, tile_id, pixel_count, status, {snap_sql('used', 6)} AS threshold,
               CASE WHEN pixel_count > 0 THEN 'masks/scene=' || scene || '/tile_id=' || tile_id END AS mask_path
             FROM (SELECT us.scene, us.tile_id, any_value(status) AS status, any_value(used) AS used,
                     CAST(sum(CASE WHEN d < used THEN 1 ELSE 0 END) AS BIGINT) AS pixel_count
                   FROM us LEFT JOIN d ON d.scene = us.scene AND d.tile_id = us.tile_id GROUP BY us.scene, us.tile_id) s""",
        "px", "po", "hd",
    ),
)
def scene_flood_otsu(spark, folder):
    stored, heads = _scenes(spark, folder)
    return chunks.flood_tiles_otsu(stored, heads, WIDTH, TILE).withColumn("threshold", snap(F.col("threshold"), 6))


@query(
    "scene_flood_mask",
    sql(
        f"""WITH {_PAIRS} SELECT scene, y, x, {snap_sql(DIFF, 6)} AS diff_db, CASE WHEN {DIFF} < -5.5 THEN 1 ELSE 0 END AS mask
            FROM sc WHERE pre IS NOT NULL AND post IS NOT NULL""",
        "px", "po", "hd",
    ),
)
def scene_flood_mask(spark, folder):
    stored, _ = _scenes(spark, folder)
    cells = chunks.flood_mask(stored, tile=TILE, names={chunks.DIFF: "diff_db", chunks.MASK: "mask"})
    return cells.select("scene", "y", "x", snap(F.col("diff_db"), 6).alias("diff_db"), F.col("mask").cast("int").alias("mask"))


def _stored(spark, pixels):
    return cut_lineage(chunks.to_chunks(pixels, WIDTH, TILE))


def _pre(spark, folder):
    pre = fixtures.pre_raster(spark, folder)
    return _stored(spark, pre.select(F.lit(0).alias("scene"), F.lit(1).alias("band"), "y", "x", "value"))


def _complex(spark, folder):
    pair = fixtures.complex_pair(spark, folder)
    return _stored(spark, pair.selectExpr("0 AS scene", "y", "x", "stack(4, 1, a1, 2, p1, 3, a2, 4, p2) AS (band, value)"))


@query(
    "chunk_boxcar",
    sql(f"SELECT y, x, {snap_sql('s/n', 5)} AS mean, n FROM ({_window_sql('sum(b.pre) AS s', 'px', (-5, 4), (-5, 4))}) w", "px"),
)
def chunk_boxcar(spark, folder):
    cells = chunk_focal.boxcar(_pre(spark, folder), TILE, WIDTH, 10, names={1: "mean", 2: "n"})
    return cells.select("y", "x", snap(F.col("mean"), 5).alias("mean"), F.col("n").cast("bigint").alias("n"))


@query(
    "chunk_lee_filter",
    sql(
        f"""SELECT y, x, {snap_sql('m + least(greatest(coalesce((q - m*m*0.25::DOUBLE)/nullif(q*1.25::DOUBLE, 0), 0), 0), 1)*(v - m)', 4)} AS filtered, n
            FROM (SELECT y, x, v, n, s1/n AS m, greatest(s2/n - (s1/n)*(s1/n), 0) AS q FROM ({_LEE}) w) u""",
        "px",
    ),
)
def chunk_lee_filter(spark, folder):
    cells = chunk_focal.lee_filter(_pre(spark, folder), TILE, WIDTH, enl=4.0, names={1: "filtered", 2: "n"})
    return cells.select("y", "x", snap(F.col("filtered"), 4).alias("filtered"), F.col("n").cast("bigint").alias("n"))


@query(
    "chunk_interferogram",
    sql(
        f"""SELECT y, x, {snap_sql('atan2(im/n, re/n)', 4)} AS phase
            FROM ({_window_sql('any_value(a.a1) AS a1, sum(b.re) AS re, sum(b.im) AS im', 'cpx', (-5, 4), (-5, 4))}) w WHERE a1 <> 0""",
        "cpx",
    ),
)
def chunk_interferogram(spark, folder):
    """Phases where the first image has a signal."""
    cells = chunk_focal.interferogram(_complex(spark, folder), TILE, WIDTH, 10, names={1: "phase"})
    return cells.select("y", "x", snap(F.col("phase"), 4).alias("phase"))


@query(
    "chunk_coherence",
    sql(
        f"""SELECT y, x, {snap_sql('sqrt(re*re + im*im)/sqrt(e1*e2)', 5)} AS coherence, n
            FROM ({_window_sql('sum(b.re) AS re, sum(b.im) AS im, sum(b.e1) AS e1, sum(b.e2) AS e2', 'cpx', (-1, 1), (-5, 4))}) w
            WHERE e1*e2 > 0""",
        "cpx",
    ),
)
def chunk_coherence(spark, folder):
    """Coherence where both windows have energy."""
    cells = chunk_focal.coherence(_complex(spark, folder), TILE, WIDTH, 3, 10, names={1: "coherence", 2: "n"})
    return cells.filter("coherence IS NOT NULL").select(
        "y", "x", snap(F.col("coherence"), 5).alias("coherence"), F.col("n").cast("bigint").alias("n")
    )
