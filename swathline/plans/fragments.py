"""Common table expressions for the reference SQL; they mirror sources.fixtures."""

from __future__ import annotations

DIFF = "10*log10(greatest(post, 1e-6)) - 10*log10(greatest(pre, 1e-6))"

_ENGINE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'SPARK' WHEN '2-HIGH' THEN 'DASK' ELSE 'PYSNAP' END"

FRAGMENTS = {
    "px": (
        (),
        """SELECT y, x, (y//64)*4 + x//64 AS tile_id, base, q,
             CASE WHEN (y//64)%4 = 3 THEN CAST(0 AS DOUBLE) ELSE base END AS pre,
             CASE WHEN (y//64)%4 = 3 THEN CAST(0 AS DOUBLE) ELSE base*q/50 END AS post
           FROM (SELECT id//256 AS y, id%256 AS x, min(l_extendedprice)/1000 AS base, min(l_quantity) AS q
                 FROM (SELECT l_orderkey*7 + l_linenumber - 1 AS id, l_extendedprice, l_quantity FROM lineitem) s
                 GROUP BY id) g""",
    ),
    "hd": (("px",), "SELECT max(y) + 1 AS height FROM px"),
    "fl": (
        ("px",),
        f"SELECT *, {DIFF} AS diff_db, CASE WHEN {DIFF} < -5.5 THEN 1 ELSE 0 END AS mask FROM px",
    ),
    "po": (
        ("px",),
        """SELECT y, x, tile_id, pre,
             CASE WHEN (y//64)%4 = 3 THEN 0 WHEN tile_id%3 = 1 THEN base*(40 + q/5)/50 ELSE post END AS post FROM px""",
    ),
    "tr": (
        ("px",),
        """SELECT *, CASE WHEN (y//64)%4 = 3 THEN -9999 WHEN q <= 12 THEN 1 ELSE 0 END AS label FROM px""",
    ),
    "bands": (
        ("px",),
        "SELECT y, x, tile_id, 1 AS band, pre AS value FROM px UNION ALL SELECT y, x, tile_id, 2, post FROM px",
    ),
    "cube": (
        (),
        """SELECT t, y, x, CASE WHEN (y*16 + x)%7 = 0 THEN CAST(0 AS DOUBLE)
                                ELSE floor(m * 1e6 + 0.3141592) / 1e6 END AS value
           FROM (SELECT CAST(ts AS DATE) AS t, (user_id//16)%16 AS y, user_id%16 AS x, avg(value) AS m
                 FROM events GROUP BY 1, 2, 3) c""",
    ),
    "cdb": (("cube",), "SELECT *, 10*log10(nullif(value, 0)) AS db FROM cube"),
    "cpx": (
        ("px",),
        """SELECT y, x, a1, re1*re2 + im1*im2 AS re, im1*re2 - re1*im2 AS im, a1*a1 AS e1, a2*a2 AS e2
           FROM (SELECT y, x, pre AS a1, post AS a2,
                   pre*cos((x%8)*0.5::DOUBLE) AS re1, pre*sin((x%8)*0.5::DOUBLE) AS im1,
                   post*cos((y%8)*0.5::DOUBLE) AS re2, post*sin((y%8)*0.5::DOUBLE) AS im2 FROM px) c""",
    ),
    "scenes": (
        (),
        """SELECT c_custkey AS scene_id, c_mktsegment AS product_type, c_name AS scene_name,
             (c_nationkey%5)*10 AS x0, (c_nationkey//5)*10 AS y0,
             (c_nationkey%5)*10 + 10 AS x1, (c_nationkey//5)*10 + 10 AS y1
           FROM customer WHERE c_acctbal >= 0""",
    ),
    "jobs": (
        (),
        f"""SELECT o_orderkey AS job_id, 'job_' || o_orderkey AS job_name, o_custkey AS scene_id, {_ENGINE} AS engine,
             CASE o_orderstatus WHEN 'O' THEN 'CREATED' WHEN 'P' THEN 'QUEUED' ELSE 'FINISHED' END AS job_status,
             o_orderdate AS created_at FROM orders""",
    ),
    "artifacts": (
        (),
        """SELECT l_orderkey + 25 AS job_id, CAST(l_linenumber AS BIGINT) AS artifact_no,
             CAST(floor(l_extendedprice) AS BIGINT) AS file_size_bytes, l_quantity AS preprocessing_seconds,
             l_discount*100 AS upload_seconds, l_tax*100 AS conversion_seconds, l_shipdate AS created_at
           FROM lineitem""",
    ),
    "runs": (
        (),
        f"""SELECT o_orderkey AS run_id, o_custkey AS scene_id, {_ENGINE} AS engine,
             floor(o_totalprice/1000*1e2 + 0.3141592)/1e2 AS duration,
             CASE WHEN o_orderstatus IN ('O', 'P') THEN 'SUCCESS' ELSE 'ERROR' END AS status FROM orders""",
    ),
    "zones": (
        (),
        """SELECT CAST(n_nationkey AS BIGINT) AS zone_id, n_name AS zone_name,
             (n_nationkey%5)*10 AS zx, (n_nationkey//5)*10 AS zy FROM nation""",
    ),
    "points": (
        (),
        """SELECT c_custkey AS point_id, CAST(c_custkey%50 AS DOUBLE) AS px,
             CAST((c_custkey//50)%50 AS DOUBLE) AS py FROM customer""",
    ),
    "tif": (
        (),
        """SELECT o_orderkey AS job_id, CAST(floor(o_totalprice) AS BIGINT) AS tif_bytes FROM orders
           WHERE o_orderpriority <> '4-NOT SPECIFIED'""",
    ),
    "zar": (
        (),
        """SELECT o_orderkey AS job_id, CAST(floor(o_totalprice*0.7::DOUBLE) AS BIGINT) AS zarr_bytes FROM orders
           WHERE o_orderstatus <> 'P'""",
    ),
    "tiles": (
        ("px", "hd"),
        """SELECT tile_id, (tile_id//4)*64 AS y0, (tile_id%4)*64 AS x0,
             least(64, height - (tile_id//4)*64) AS h, CAST(64 AS BIGINT) AS w
           FROM (SELECT DISTINCT tile_id FROM px) d, hd""",
    ),
}


def sql(body: str, *needs: str) -> str:
    """SELECT ``body`` over the named fragments and whatever they need in turn."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for dep in FRAGMENTS[name][0]:
                visit(dep)
            ordered.append(name)

    for need in needs:
        visit(need)
    if not ordered:
        return body
    head = ",\n".join(f"{n} AS ({FRAGMENTS[n][1]})" for n in ordered)
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body.lstrip()[len('WITH RECURSIVE'):]}"
    if body.lstrip().upper().startswith("WITH"):
        return f"WITH {head},\n{body.lstrip()[len('WITH'):]}"
    return f"WITH {head}\n{body}"
