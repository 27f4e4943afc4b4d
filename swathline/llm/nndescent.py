"""Near-duplicate vectors by NN-descent.

1. Equal vectors are one node with a count. Nodes whose angle to a pivot is at most half the link angle are put into the
   pivot's ball: any two of them are linked by the triangle inequality, so that a dense group costs comparisons with its
   pivots, not of all its pairs. Balls are formed inside leaves of a random-hyperplane tree, of bounded size.
2. A neighbour graph of the pivots begins with the nearest ones inside the leaves of other such trees. Rounds of
   neighbours-of-neighbours joins refine it: each pivot's forward and reverse neighbours are compared with each other.
   A list is saturated when every neighbour on it could still hold a link; such lists are doubled.
3. Of each label a hash sample of about ``audit`` pivots is compared with all its pivots, in blocks; the sample is doubled until
   it holds ``evidence`` pivots with near pairs or is the whole label. While the graph holds less than ``recall`` of the near
   pairs of some label, counted by pairs or by pivots, another tree is added and the graph refined again. A label that
   still holds less after all trees is compared whole, in blocks. Near pairs found by comparison are kept.
4. Of each edge that could hold a link, the members of both balls are compared by cosine in double precision. Links below
   the threshold are never reported. Components come from the ball edges.

Vectors that are null, zero, empty or hold null or non-finite components, and rows with a null label or id, link with
nothing. Vectors of different lengths link with nothing. Rows are counted one by one: a repeated row is another vector;
ids that head different vectors tie these into one component.
Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathline.llm.common import map_batches
from swathline.operators.vectorize import resolve
from swathline.session import cut_lineage

TREE_BITS = 30
SAFE = 1e-9
#: Pivots and bytes of vectors in one pass of the audit; a round that changes no greater share of the edges is the last one.
PASS_ROWS, PASS_BYTES = 4096, 16 << 20
UPDATES = 0.001


def _planes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((trees * TREE_BITS, dim))


def _prepared(vectors: DataFrame, trees: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, key, dim, vec, codes) by row; the key is null where a vector links with nothing."""
    kinds = dict(vectors.dtypes)
    schema = f"vec_id {kinds[id_col]}, label {kinds[label_col]}, key binary, dim int, vec binary, codes array<bigint>"

    def make():
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(TREE_BITS, dtype=np.int64)[::-1]

        def one(vector, label, usable):
            if not usable or not vector or any(x is None for x in vector):
                return None, None, None, None
            v = np.asarray(vector, dtype=np.float64)
            top = np.abs(v).max()
            if not np.isfinite(top) or top == 0:
                return None, None, None, None
            v = v / top
            v = v / math.sqrt(float(v @ v))
            dim = len(v)
            if dim not in planes:
                planes[dim] = _planes(dim, trees)
            codes = ((planes[dim] @ v > 0).reshape(trees, TREE_BITS) * powers).sum(axis=1)
            raw = v.tobytes()
            return xxhash.xxh3_128_digest(repr((label, dim)).encode() + raw), dim, raw, codes

        def work(batch: pa.RecordBatch) -> dict:
            ids, labels = batch.column(0), batch.column(2)
            rows = [
                one(v, x, x is not None and i is not None)
                for i, v, x in zip(ids.to_pylist(), batch.column(1).to_pylist(), labels.to_pylist())
            ]
            return {"vec_id": ids, "label": labels} | {
                name: [r[j] for r in rows] for j, name in enumerate(("key", "dim", "vec", "codes"))
            }

        return work

    return map_batches(vectors.select(id_col, vector_col, label_col), schema, make)


def _leaves(nodes: DataFrame, tree: int, leaf: int) -> DataFrame:
    """Adds ``leaf``: the cell of a tree, halved often enough for about ``leaf`` nodes; larger cells are dealt in parts."""
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("_all"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_all") / leaf))).cast("int")
    unused = F.lit(TREE_BITS) - F.least(bits, F.lit(TREE_BITS))
    cell = F.floor(F.element_at("codes", tree + 1) / F.pow(F.lit(2.0), unused)).cast("bigint")
    cells = nodes.join(sizes, ["label", "dim"]).withColumn("_cell", cell)
    full = cells.groupBy("label", "dim", "_cell").agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("node", F.lit(tree)), F.ceil(F.col("_n") / (4 * leaf)).cast("bigint"))
    return cells.join(full, ["label", "dim", "_cell"]).withColumn("_part", part).drop("_all", "_n")


def _matrix(column, dim: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dim)


def _balls(nodes: DataFrame, half: float, leaf: int) -> DataFrame:
    """(node, label, dim, vec, codes, radius, keys, counts, vecs): one row per ball, with at most 4 * leaf or so members."""
    kinds = dict(nodes.dtypes)
    schema = (
        f"node {kinds['node']}, label {kinds['label']}, dim int, vec binary, codes array<bigint>, radius double, "
        "keys array<binary>, counts array<bigint>, vecs binary"
    )

    def cover(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        dim = table.column("dim")[0].as_py()
        v = _matrix(table.column("vec"), dim)
        cos = v @ v.T
        free = np.ones(len(v), bool)
        rows = []
        for i in range(len(v)):
            if free[i]:
                own = free & (cos[i] >= half)
                own[i] = True
                free &= ~own
                rows.append((i, np.flatnonzero(own)))
        at = [i for i, _ in rows]
        head = table.take(pa.array(at, pa.int64()))
        keys, counts = table.column("key").combine_chunks(), table.column("count").to_numpy()
        radius = [float(np.arccos(np.clip(cos[i][m].min(), -1, 1))) if len(m) > 1 else 0.0 for i, m in rows]
        return pa.table(
            {
                "node": head.column("node"), "label": head.column("label"), "dim": head.column("dim"),
                "vec": head.column("vec"), "codes": head.column("codes"), "radius": pa.array(radius, pa.float64()),
                "keys": pa.array([keys.take(pa.array(m)).to_pylist() for _, m in rows], pa.list_(pa.binary())),
                "counts": pa.array([counts[m].tolist() for _, m in rows], pa.list_(pa.int64())),
                "vecs": pa.array([v[m].tobytes() for _, m in rows], pa.binary()),
            }
        )

    return _leaves(nodes, 0, leaf).groupBy("label", "dim", "_cell", "_part").applyInArrow(cover, schema)


def _leaf_neighbours(pivots: DataFrame, tree: int, leaf: int, k: int) -> DataFrame:
    """(u, v, cos): the nearest ``k`` of each pivot inside its leaf."""
    kind = dict(pivots.dtypes)["node"]

    def nearest(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        v = _matrix(table.column("vec"), dim)
        ids = table.column("node").combine_chunks()
        cos = v @ v.T
        np.fill_diagonal(cos, -2)
        size = min(k, len(v) - 1)
        best = np.argsort(-cos, axis=1, kind="stable")[:, :size]
        u = np.repeat(np.arange(len(v)), size)
        w = best.ravel()
        return pa.table({"u": ids.take(pa.array(u)), "v": ids.take(pa.array(w)), "cos": pa.array(cos[u, w], pa.float64())})

    cells = _leaves(pivots.select("node", "label", "dim", "vec", "codes"), tree, leaf)
    return cells.groupBy("label", "dim", "_cell", "_part").applyInArrow(nearest, f"u {kind}, v {kind}, cos double")


def _lists(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nearest of each node's edges, as many as its list may hold: (u, v, cos, fresh, place, size)."""
    window = Window.partitionBy("u").orderBy(F.desc("cos"), "v")
    return (
        edges.groupBy("u", "v").agg(F.max("cos").alias("cos"), F.min("fresh").alias("fresh"))
        .join(sizes, "u")
        .withColumn("place", F.row_number().over(window))
        .filter(F.col("place") <= F.col("size"))
    )


def _round(graph: DataFrame, pivots: DataFrame) -> DataFrame:
    """New candidate edges (u, v, cos): what neighbours of one pivot find among each other."""
    kind = dict(pivots.dtypes)["node"]
    last = graph.groupBy("u").agg(
        F.when(F.max("place") < F.first("size"), F.lit(-2.0)).otherwise(F.min("cos")).alias("worst")
    )
    forward = graph.select(F.col("u").alias("p"), F.col("v").alias("x"), "cos", "size")
    # As many reverse neighbours as the list may hold, taken in two steps so that a hub isn't ranked in one task.
    step = Window.partitionBy("p", "_salt").orderBy(F.desc("cos"), "x")
    rank = Window.partitionBy("p").orderBy(F.desc("cos"), "x")
    sizes = graph.select(F.col("u").alias("p"), F.col("size").alias("_s")).distinct()
    reverse = (
        graph.select(F.col("v").alias("p"), F.col("u").alias("x"), "cos").join(sizes, "p")
        .withColumn("_salt", F.pmod(F.xxhash64("x"), F.lit(32)))
        .withColumn("_r", F.row_number().over(step)).filter(F.col("_r") <= F.col("_s"))
        .withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= F.col("_s"))
        .select("p", "x", "cos", F.col("_s").alias("size"))
    )
    own = graph.select(F.col("u").alias("p"), F.col("u").alias("x")).distinct()
    around = forward.select("p", "x").union(reverse.select("p", "x")).union(own).distinct()
    vectors = pivots.select(F.col("node").alias("x"), "dim", "vec").join(
        last.withColumnRenamed("u", "x"), "x", "left"
    )
    met = around.join(vectors, "x").groupBy("p").agg(
        F.collect_list(F.struct("x", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "vec")).alias("near"),
        F.first("dim").alias("dim"),
    )

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            lists = batch.column("near")
            starts, inner = lists.offsets.to_numpy(), lists.values
            dims = batch.column("dim").to_pylist()
            worst = inner.field("worst").to_numpy()
            raw, ids = inner.field("vec"), inner.field("x")
            left, right, cosines = [], [], []
            for row, dim in enumerate(dims):
                a, b = starts[row], starts[row + 1]
                v = _matrix(raw.slice(a, b - a), dim)
                cos = v @ v.T
                np.fill_diagonal(cos, -3)
                i, j = np.nonzero(cos > worst[a:b, None])
                left.append(i + a)
                right.append(j + a)
                cosines.append(cos[i, j])
            u, w = np.concatenate(left), np.concatenate(right)
            return {"u": ids.take(pa.array(u)), "v": ids.take(pa.array(w)), "cos": np.concatenate(cosines)}

        return work

    return map_batches(met.select("near", "dim"), f"u {kind}, v {kind}, cos double", make)


def _reach(angle: float):
    """Whether two balls may hold a link: the angle of their pivots against the link angle and both radii."""
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("cos")))) <= F.lit(angle + 1e-7) + F.col("ru") + F.col("rv")


def _near(edges: DataFrame, radii: DataFrame, angle: float) -> DataFrame:
    left = radii.select(F.col("node").alias("u"), F.col("radius").alias("ru"))
    right = radii.select(F.col("node").alias("v"), F.col("radius").alias("rv"))
    return edges.join(left, "u").join(right, "v").filter(_reach(angle)).select("u", "v")


def _passes(queries: DataFrame):
    """The queries' rows in lists of bounded size."""
    held, size = [], 0
    for row in queries.select("node", "label", "dim", "vec", "radius").toLocalIterator():
        held.append(tuple(row))
        size += len(row.vec)
        if len(held) >= PASS_ROWS or size >= PASS_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _compared(pivots: DataFrame, queries: DataFrame, angle: float) -> DataFrame:
    """(u, v, label, dim): all near pairs of the queries, which are pivots too."""
    kind, label = dict(pivots.dtypes)["node"], dict(pivots.dtypes)["label"]
    found = pivots.sparkSession.createDataFrame([], f"u {kind}, v {kind}, label {label}, dim int")
    for rows in _passes(queries):
        found = found.unionByName(cut_lineage(_scan(pivots, rows, angle)))
    return found


def _scan(pivots: DataFrame, queries: list[tuple], angle: float) -> DataFrame:
    kind, kind_of_label = dict(pivots.dtypes)["node"], dict(pivots.dtypes)["label"]
    spaces: dict[tuple, tuple] = {}
    for node, label, dim, vec, radius in queries:
        spaces.setdefault((label, dim), ([], [], []))
        for part, value in zip(spaces[label, dim], (node, np.frombuffer(bytes(vec)), radius)):
            part.append(value)
    handle = pivots.sparkSession.sparkContext.broadcast(spaces)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            spaces = handle.value
            u, v, labels, dims = [], [], [], []
            ids, raw = batch.column("node").to_pylist(), batch.column("vec").to_pylist()
            radii = batch.column("radius").to_numpy()
            where: dict[tuple, list[int]] = {}
            for i, space in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist())):
                where.setdefault(space, []).append(i)
            for space, rows in where.items():
                if space in spaces:
                    nodes, vectors, own = spaces[space]
                    block = np.frombuffer(b"".join(raw[i] for i in rows)).reshape(len(rows), -1)
                    own, around = np.array(own), radii[rows]
                    cos = np.array(vectors) @ block.T
                    q, x = np.nonzero(cos >= math.cos(min(math.pi, angle + 1e-6 + own.max() + around.max())) - SAFE)
                    close = np.arccos(np.clip(cos[q, x], -1, 1)) <= angle + 1e-7 + own[q] + around[x]
                    for a, b in zip(q[close], x[close]):
                        if nodes[a] != ids[rows[b]]:
                            u.append(nodes[a])
                            v.append(ids[rows[b]])
                            labels.append(space[0])
                            dims.append(space[1])
            return {"u": u, "v": v, "label": labels, "dim": dims}

        return work

    source = pivots.select("node", "label", "dim", "vec", "radius")
    return map_batches(source, f"u {kind}, v {kind}, label {kind_of_label}, dim int", make)


def _place(pivots: DataFrame) -> DataFrame:
    """Adds ``place``, from 0 to 1 by hash: the order in which pivots come into the audit."""
    return pivots.withColumn("place", F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 30)) / (1 << 30))


def _audit(pivots: DataFrame, angle: float, audit: int, evidence: int) -> tuple[DataFrame, DataFrame]:
    """The near pairs of the sampled pivots, and (label, dim, upto): the share of each label that was sampled."""
    placed, space = _place(pivots), ["label", "dim"]
    ends = pivots.groupBy(space).agg(F.least(F.lit(1.0), F.lit(float(audit)) / F.count("*")).alias("upto"))
    ends = cut_lineage(ends.withColumn("since", F.lit(0.0)))
    true = None
    while True:
        new = placed.join(ends, space).filter((F.col("place") >= F.col("since")) & (F.col("place") < F.col("upto")))
        found = _compared(pivots, new, angle)
        true = cut_lineage(found if true is None else true.unionByName(found))
        seen = true.groupBy(space).agg(F.countDistinct("u").alias("_seen"))
        more = (F.coalesce("_seen", F.lit(0)) < evidence) & (F.col("upto") < 1)
        ends = cut_lineage(
            ends.join(seen, space, "left").select(
                *space, F.when(more, F.least(F.lit(1.0), F.col("upto") * 2)).otherwise(F.col("upto")).alias("upto"),
                F.col("upto").alias("since"),
            )
        )
        if ends.filter(F.col("upto") > F.col("since")).isEmpty():
            return true, ends.select(*space, "upto")


def _missed(true: DataFrame, ends: DataFrame, near: DataFrame, recall: float) -> DataFrame:
    """(label, dim, upto) of the labels of which the graph holds too few near pairs, unless all of their pivots were compared."""
    held = near.select("u", "v").union(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    by_pivot = true.join(held.withColumn("held", F.lit(1)), ["u", "v"], "left").groupBy("label", "dim", "u").agg(
        F.count("*").alias("n"), F.count("held").alias("found")
    )
    shares = by_pivot.groupBy("label", "dim").agg(
        F.least(F.sum("found") / F.sum("n"), F.avg(F.col("found") / F.col("n"))).alias("share")
    )
    few = F.coalesce("share", F.lit(0.0)) < recall
    return ends.join(shares, ["label", "dim"], "left").filter((F.col("upto") < 1) & few).select("label", "dim", "upto")


def _links(near: DataFrame, balls: DataFrame, threshold: float) -> DataFrame:
    """Of each pair of balls: (key, links) of every member with links across, and one row (u, v) if there are any."""
    kind = dict(balls.dtypes)["node"]
    left = balls.select(*(F.col(c).alias(f"{c}_u") for c in ("node", "dim", "keys", "counts", "vecs")))
    right = balls.select(*(F.col(c).alias(f"{c}_v") for c in ("node", "keys", "counts", "vecs")))
    joined = near.join(left, F.col("u") == F.col("node_u")).join(right, F.col("v") == F.col("node_v")).drop("node_u", "node_v")

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"key": [], "links": [], "u": [], "v": []}
            names = ("u", "v", "dim_u", "keys_u", "keys_v", "counts_u", "counts_v", "vecs_u", "vecs_v")
            for u, v, dim, iu, iv, cu, cv, vu, vv in zip(*(batch.column(n).to_pylist() for n in names)):
                a, b = np.frombuffer(vu).reshape(-1, dim), np.frombuffer(vv).reshape(-1, dim)
                linked = a @ b.T >= threshold
                if linked.any():
                    for keys, links in ((iu, linked @ np.array(cv)), (iv, np.array(cu) @ linked)):
                        for i, n in zip(keys, links.tolist()):
                            if n:
                                out["key"].append(i)
                                out["links"].append(n)
                                out["u"].append(None)
                                out["v"].append(None)
                    for name, value in (("key", None), ("links", None), ("u", u), ("v", v)):
                        out[name].append(value)
            return out

        return work

    return map_batches(joined, f"key binary, links bigint, u {kind}, v {kind}", make)


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, k: int = 6, leaf: int = 64, trees: int = 3, extra_trees: int = 5,
    rounds: int = 12, audit: int = 400, recall: float = 0.98, evidence: int = 100, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector.

    ``rounds`` bounds one refinement, which otherwise ends when next to no edge changes and no list is saturated.
    """
    angle = math.acos(threshold)
    half = math.cos(angle / 2) + SAFE
    rows = cut_lineage(_prepared(vectors, 1 + trees + extra_trees, id_col, vector_col, label_col))
    nodes = cut_lineage(
        rows.filter(F.col("key").isNotNull()).groupBy("key").agg(
            F.min("vec_id").alias("node"), F.count("*").alias("count"), F.first("label").alias("label"),
            F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.first("codes").alias("codes"),
        )
    )
    balls = cut_lineage(_balls(nodes, half, leaf))
    pivots = balls.select("node", "label", "dim", "vec", "codes", "radius")
    true, ends = _audit(pivots, angle, audit, evidence)
    edges, tree = None, 1
    while True:
        found = None
        for t in range(tree, tree + (trees if edges is None else 1)):
            own = _leaf_neighbours(pivots, t, leaf, k)
            found = own if found is None else found.unionByName(own)
        tree += trees if edges is None else 1
        sizes = pivots.select(F.col("node").alias("u"), F.lit(k).alias("size")) if edges is None else sizes
        found = found.withColumn("fresh", F.lit(1))
        edges = found if edges is None else graph.select("u", "v", "cos", "fresh").unionByName(found)
        graph = cut_lineage(_lists(edges, sizes))
        changed = True
        for _ in range(rounds):
            near = _near(graph, pivots, angle)
            full = near.groupBy("u").agg(F.count("*").alias("n")).join(sizes, "u").filter(F.col("n") >= F.col("size"))
            saturated = full.count()
            if not changed and not saturated:
                break
            if saturated:
                grown = full.select("u", F.lit(2).alias("_by"))
                sizes = cut_lineage(
                    sizes.join(grown, "u", "left").select("u", (F.col("size") * F.coalesce("_by", F.lit(1))).alias("size"))
                )
            old, new = graph.select("u", "v", "cos", F.lit(0).alias("fresh")), _round(graph, pivots)
            graph = cut_lineage(_lists(old.unionByName(new.withColumn("fresh", F.lit(1))), sizes))
            count = graph.agg(F.sum("fresh").alias("new"), F.count("*").alias("n")).first()
            changed = (count.new or 0) > UPDATES * count.n
        near = _near(graph, pivots, angle)
        missed = cut_lineage(_missed(true, ends, near, recall))
        if tree > trees + extra_trees or missed.isEmpty():
            break
    rest = _place(pivots).join(missed, ["label", "dim"]).filter(F.col("place") >= F.col("upto"))
    near = near.union(true.select("u", "v")).union(_compared(pivots, rest, angle).select("u", "v"))
    pairs = near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    across = cut_lineage(_links(pairs, balls, threshold))
    roots = resolve(across.filter(F.col("u").isNotNull()).select("u", "v"))
    members = balls.select(
        "node", F.explode(F.arrays_zip("keys", "counts")).alias("m"),
        F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("inside"),
    ).select("node", "inside", F.col("m.keys").alias("key"))
    outside = across.filter(F.col("key").isNotNull()).groupBy("key").agg(F.sum("links").alias("outside"))
    result = (
        members.join(roots.withColumnRenamed("node", "_p"), F.col("node") == F.col("_p"), "left")
        .join(outside, "key", "left")
        .select(
            "key", (F.col("inside") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"),
            F.coalesce("root", "node").alias("component_id"),
        )
    )
    return rows.select("vec_id", "key").join(result, "key", "left").select(
        F.col("vec_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
