"""Feature tables and forests."""

from __future__ import annotations

from pyspark.sql import functions as F

from swathline.functions.numeric import snap, snap_sql
from swathline.operators import change, ml
from swathline.plans.fragments import sql
from swathline.plans.registry import query
from swathline.session import cut_lineage
from swathline.sources import fixtures

TILE, WIDTH = fixtures.TILE, fixtures.WIDTH

_HASH = "(y*7919 + x*104729 + 12345) % 1000003"


def _labelled(spark, folder):
    """Both acquisitions and the ground truth on one row per pixel."""
    both = fixtures.px(spark, folder).select("y", "x", "tile_id", "pre", "post")
    return both.join(fixtures.truth(spark, folder), ["y", "x"])


@query(
    "sample_tiles",
    sql("SELECT tile_id FROM (SELECT DISTINCT tile_id FROM px) t ORDER BY (tile_id*104729 + 42*7919 + 12345) % 1000003, tile_id LIMIT 20", "px"),
)
def sample_tiles(spark, folder):
    """Twenty tiles in hash order (a sampling operator)."""
    tiles = fixtures.pre_raster(spark, folder).select(fixtures.tile_of().alias("tile_id")).distinct()
    return ml.sample_tiles(tiles, 20)


_STATS = ", ".join(
    f"{snap_sql(f'{fn}({col}) OVER (PARTITION BY tile_id)', 4)} AS {name}_{kind}"
    for name, col in (("pre", "pre"), ("post", "post"), ("diff", "post - pre"))
    for kind, fn in (("std", "stddev_pop"), ("var", "var_pop"))
)


@query(
    "rf_features",
    sql(
        f"""SELECT * FROM (SELECT tile_id, y, x, label, pre, post, {snap_sql('post - pre', 6)} AS diff, {_STATS} FROM tr) s
            WHERE label <> -9999""",
        "tr",
    ),
)
def rf_features(spark, folder):
    got = ml.tile_features(_labelled(spark, folder))
    digits = {c: 4 for c in ml.TILE_FEATURES[3:]} | {"diff": 6}
    return got.withColumns({c: snap(F.col(c), d) for c, d in digits.items()})


def _patch_sql() -> str:
    cells, joins = [], []
    for k in range(9):
        joins.append(f"LEFT JOIN tr n{k} ON n{k}.y = a.y + {k // 3 - 1} AND n{k}.x = a.x + {k % 3 - 1}")
    for base, term in ((0, "n{k}.pre"), (9, "n{k}.post"), (18, "n{k}.post - n{k}.pre")):
        for k in range(9):
            cells.append(f"{snap_sql(f'coalesce({term.format(k=k)}, 0)', 6)} AS f{base + k}")
    valid = "CASE WHEN label <> -9999 THEN {c} END"
    stats = []
    for i, (fn, col) in enumerate((fn, c) for fn in ("stddev_pop", "var_pop") for c in ("pre", "post", "post - pre")):
        stats.append(f"{snap_sql(f'{fn}({valid.format(c=col)})', 4)} AS f{27 + i}")
    return f"""SELECT a.tile_id, a.y, a.x, a.label, {', '.join(cells)}, s.* EXCLUDE (tid)
      FROM tr a {' '.join(joins)} JOIN (SELECT tile_id AS tid, {', '.join(stats)} FROM tr GROUP BY tile_id) s ON s.tid = a.tile_id, hd
      WHERE a.label <> -9999 AND a.y >= 1 AND a.x >= 1 AND a.y < height - 1 AND a.x < 255"""


@query("rf_features_patch", sql(_patch_sql(), "tr", "hd"))
def rf_features_patch(spark, folder):
    got = ml.patch_features(_labelled(spark, folder), TILE, fixtures.height(spark, folder), WIDTH)
    return got.withColumns({f"f{i}": snap(F.col(f"f{i}"), 6 if i < 27 else 4) for i in range(33)})


@query(
    "balance_classes",
    sql(
        f"""SELECT label, y, x FROM (
              SELECT label, y, x, row_number() OVER (PARTITION BY label ORDER BY {_HASH}, y, x) AS r FROM tr WHERE label <> -9999) s
            WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM tr WHERE label <> -9999 GROUP BY label) c)""",
        "tr",
    ),
)
def balance_classes(spark, folder):
    labelled = fixtures.truth(spark, folder).filter(F.col("label") != -9999)
    return ml.balance_classes(labelled).select("label", "y", "x")


@query(
    "train_test_split",
    sql(f"SELECT y, x, label, CASE WHEN (({_HASH})*43 + 42) % 100 < 20 THEN 'test' ELSE 'train' END AS part FROM tr", "tr"),
)
def train_test_split(spark, folder):
    return ml.split(fixtures.truth(spark, folder)).select("y", "x", "label", "part")


def _trained(spark, folder, trees, depth):
    """A forest on the balanced training part, and the feature table it came from."""
    features = cut_lineage(ml.tile_features(_labelled(spark, folder)))
    balanced = ml.balance_classes(features.select("label", "y", "x"))
    train = ml.split(balanced).filter(F.col("part") == "train").select("y", "x")
    rows = features.join(train, ["y", "x"])
    return ml.train_forest(rows, ml.TILE_FEATURES, trees, depth), features


@query("rf_train_predict")
def rf_train_predict(spark, folder):
    """Confusion of the forest over all labelled pixels of the scene."""
    model, features = _trained(spark, folder, trees=20, depth=6)
    predicted = model.transform(features).select("label", F.col("prediction").cast("int").alias("predicted"))
    return ml.confusion(predicted)


@query("rf_inspect")
def rf_inspect(spark, folder):
    """Feature importances, tree count and depth of a trained forest."""
    model, _ = _trained(spark, folder, trees=10, depth=5)
    return spark.createDataFrame(
        ml.inspect(model, ml.TILE_FEATURES), "feature string, importance double, trees int, depth int"
    )


@query(
    "confusion_report",
    sql(
        f"""WITH c AS (SELECT label, mask, count(*) AS n FROM tr JOIN fl USING (y, x) WHERE label <> -9999 GROUP BY 1, 2),
              s AS (SELECT l AS label, sum(CASE WHEN label = l THEN n ELSE 0 END) AS support, sum(CASE WHEN mask = l THEN n ELSE 0 END) AS claimed,
                      sum(CASE WHEN label = l AND mask = l THEN n ELSE 0 END) AS hits,
                      sum(CASE WHEN label = mask THEN n ELSE 0 END)/sum(n) AS acc
                    FROM c, (SELECT unnest([0, 1]) AS l) x GROUP BY l)
            SELECT label, CAST(support AS BIGINT) AS support, {snap_sql('hits/claimed', 6)} AS precision, {snap_sql('hits/support', 6)} AS recall,
              {snap_sql('2*hits/(support + claimed)', 6)} AS f1, {snap_sql('acc', 6)} AS accuracy FROM s""",
        "tr",
        "fl",
    ),
)
def confusion_report(spark, folder):
    """The threshold rule judged against the ground truth."""
    pairs = change.with_change(
        change.align(fixtures.pre_raster(spark, folder), fixtures.post_raster(spark, folder), how="inner")
    )
    judged = fixtures.truth(spark, folder).filter(F.col("label") != -9999).join(pairs.select("y", "x", "mask"), ["y", "x"])
    report = ml.report(ml.confusion(judged, "label", "mask"))
    return report.withColumns({c: snap(F.col(c), 6) for c in ("precision", "recall", "f1", "accuracy")})
