"""N-gram Jaccard join by a token-group matrix.

A document's set holds 64-bit hashes of its word shingles; equal sets are one node, the smallest of their ids. Tokens
have one global order, rare ones first, by their counts in a sketch over the whole corpus (``4 * 2 ** sketch_bits``
bytes, a fixed size; it only steers the order, never the result).

1. Two linked sets must share a token among the first few of each (prefix filter). Each token names the smallest node
   and the greatest node that has it there; a set is first held against the nodes that most of its tokens name.
   Verified pairs partition the sets into groups of similar documents, linear in the number of copies. While the
   matrix would meet its queries in more than ``CROWDED`` rows an entry, a further round does the same with members of
   other groups, drawn anew, so that near copies that link neither end still fall together. Rounds steer the work only.
2. The token-group matrix holds, for each token, the groups in whose members' prefixes it stands, with the least and
   greatest set size and the most tokens that follow it in a member: the token union of a group is one entry per token,
   however many members it has. Every set is a query on it; a group qualifies when it isn't the query's own and shares a
   prefix token, within the sizes that allow a link and with enough tokens left on both sides for its overlap. Only qualifying groups are opened, in chunks of bounded size: members are bounded by the tokens that the ordered
   prefixes prove to be missing, and what remains is compared token by token.

Links found in both steps give the components. A link is left out only between documents whose groups are already one.

Null or empty text, or text without words: empty set, linked with nothing, its own component. Null id: component null,
never a node. Rows that share an id and have different
sets are told apart by their sets, unless that id heads both. Empty table: empty result. Ids may be of any type that
can be ordered. Extra columns are ignored by ``components`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathline.llm.common import ROWS, as_bytes, map_batches, unused_names
from swathline.operators.vectorize import resolve
from swathline.session import cut_lineage, drop_stages

SKETCH_BITS = 20
SLICES = 64
SIEVE_BITS = 22
CHUNK = 128
KNOWN_WORDS = 120_000
#: Rounds of grouping end when the matrix makes no more than so many rows for each prefix token, or none is left.
CROWDED = 2
ROUNDS = 2
#: A round after the first holds each set against twice as many others at most.
DRAWS = 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.empty(0, np.uint64)


class Shingler:
    """Sorted distinct hashes of the word shingles of a text."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        value = self.known.get(word)
        if value is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            value = self.known[word] = xxhash.xxh64_intdigest(word)
        return value

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # bytes: A-Z only; white space is space and \x09-\x0D
        if not words:
            return _EMPTY
        each = np.fromiter(map(self._hash, words), np.uint64, len(words))
        width = min(self.words, len(words))
        count = len(words) - width + 1
        mixed = np.full(count, width, np.uint64)
        for j in range(width):
            mixed = (mixed ^ each[j : j + count]) * _MULTIPLIER
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def least_overlap(n, percent: int):
    """The fewest tokens that a set of ``n`` shares with any set it links to."""
    return (percent * n + 99) // 100


def prefix_length(n, percent: int):
    return n - least_overlap(n, percent) + 1


def pair_overlap(n, m, percent: int):
    return -(-percent * (n + m) // (100 + percent))


def _sets(docs: DataFrame, words: int, bits: int, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray]:
    """(doc, n, set) of every document, and the counts of the token sketch."""
    width = (1 << bits) // SLICES
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc {kind}, n bigint, key binary, slice int, part int, counts binary"

    def run(batches):
        shingle, total, seen = Shingler(words), np.zeros(1 << bits, np.int32), 0
        names = ["doc", "n", "key", "slice", "part", "counts"]
        kinds = [None, pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            docs_in, kinds[0] = batch.column(0), batch.column(0).type
            sets = [shingle(t.as_py()) for t in batch.column(1)]
            slots = np.concatenate([_EMPTY, *sets]) >> np.uint64(64 - bits)
            total += np.bincount(slots.astype(np.int64), minlength=1 << bits).astype(np.int32)
            seen += len(sets)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            columns = [docs_in, [len(s) for s in sets], keys, *([None] * len(sets) for _ in range(3))]
            yield pa.RecordBatch.from_arrays(
                [docs_in, *(pa.array(c, k) for c, k in zip(columns[1:], kinds[1:]))], names=names
            )
        if seen:
            import pyspark

            task = pyspark.TaskContext.get().partitionId() % 256
            columns = [
                pa.nulls(SLICES, kinds[0]), pa.nulls(SLICES, kinds[1]), pa.nulls(SLICES, kinds[2]),
                pa.array(range(SLICES), kinds[3]), pa.array([task] * SLICES, kinds[4]),
                pa.array([total[i * width : (i + 1) * width].tobytes() for i in range(SLICES)], kinds[5]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).alias("doc"), as_bytes(text_col).alias("text"))
    rows = cut_lineage(source.mapInArrow(run, schema))

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for counts in table.column("counts"):
            total += np.frombuffer(counts.as_py(), np.int32)
        total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32).tobytes()
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total], pa.binary())})

    parts = rows.filter(F.col("slice").isNotNull()).select("slice", "part", "counts")
    halfway = parts.groupBy("slice", "part").applyInArrow(add, "slice int, counts binary")
    merged = halfway.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()  # one row a slice
    sketch = np.zeros(1 << bits, np.int32)
    for r in merged:
        sketch[r.slice * width : (r.slice + 1) * width] = np.frombuffer(bytes(r.counts), np.int32)
    return rows.filter(F.col("slice").isNull()).select("doc", "n", "key"), sketch


def _prefixes(docs: DataFrame, words: int, percent: int, sketch: np.ndarray, bits: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, prefix): the first tokens of each set in the global order, as ordered numbers."""
    handle = docs.sparkSession.sparkContext.broadcast(sketch)  # a fixed size
    schema = f"doc {dict(docs.dtypes)[id_col]}, n bigint, prefix array<bigint>"

    def make():
        shingle, counts = Shingler(words), handle.value

        def first(text):
            tokens = shingle(text)
            n = len(tokens)
            if not n:
                return 0, []
            seen = np.minimum(counts[(tokens >> np.uint64(64 - bits)).astype(np.int64)], (1 << 14) - 1).astype(np.uint64)
            ranks = (seen << np.uint64(49)) | (tokens >> np.uint64(15))
            size = prefix_length(n, percent)
            return n, np.sort(np.partition(ranks, size - 1)[:size]).astype(np.int64)

        def work(batch: pa.RecordBatch) -> dict:
            both = [first(t.as_py()) for t in batch.column(1)]
            return {"doc": batch.column(0), "n": [n for n, _ in both], "prefix": [p for _, p in both]}

        return work

    source = docs.select(F.col(id_col).alias("doc"), as_bytes(text_col).alias("text")).filter(F.col(id_col).isNotNull())
    return map_batches(source, schema, make)


def _possible(n: int, m: int, p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sets may link: tokens below the end of both ordered prefixes that only one has are missing in the other."""
    last = min(p[-1], q[-1])
    a, b = p[: np.searchsorted(p, last)], q[: np.searchsorted(q, last)]
    common = len(np.intersect1d(a, b))
    return min(n - len(np.unique(a)), m - len(np.unique(b))) + common >= pair_overlap(n, m, percent)


def _bounded(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose prefixes don't rule a link out."""
    kind = dict(pairs.dtypes)["u"]
    left = prefixes.select(F.col("doc").alias("u"), F.col("n").alias("nu"), F.col("prefix").alias("pu"))
    right = prefixes.select(F.col("doc").alias("v"), F.col("n").alias("nv"), F.col("prefix").alias("pv"))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            n, m = batch.column("nu").to_numpy(), batch.column("nv").to_numpy()
            p, q = batch.column("pu"), batch.column("pv")
            ps, pi, qs, qi = p.offsets.to_numpy(), p.values.to_numpy(), q.offsets.to_numpy(), q.values.to_numpy()
            keep = [
                i for i in range(len(n)) if _possible(n[i], m[i], pi[ps[i] : ps[i + 1]], qi[qs[i] : qs[i + 1]], percent)
            ]
            at = pa.array(keep, pa.int64())
            return {"u": batch.column("u").take(at), "v": batch.column("v").take(at)}

        return work

    joined = pairs.join(left, "u").join(right, "v").select("u", "v", "nu", "nv", "pu", "pv")
    return map_batches(joined, f"u {kind}, v {kind}", make)


def _sieve(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows with ``maybe``: whether their id may be among the wanted ones, by a bitmap of ``2 ** SIEVE_BITS`` hashed ids, a fixed size.

    It spares the shuffle of most rows; when it is full, all pass and the join that follows sorts them out.
    """
    slot = F.pmod(F.xxhash64("doc"), F.lit(1 << SIEVE_BITS))
    bit = F.expr("shiftleft(1L, cast(_slot % 64 as int))")
    bitmap = (
        wanted.select(slot.alias("_slot")).groupBy(F.floor(F.col("_slot") / 64).cast("bigint").alias("_word"))
        .agg(F.bit_or(bit).alias("_bits"))
    )
    marked = rows.withColumn("_slot", slot).withColumn("_word", F.floor(F.col("_slot") / 64).cast("bigint"))
    held = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return marked.join(F.broadcast(bitmap), "_word", "left").select(*rows.columns, held.alias("maybe"))


def _sieved(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose id may be among the wanted ones."""
    return _sieve(rows, wanted).filter("maybe").drop("maybe")


def _linked(pairs: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (u, v) that are links; only the texts of documents in a pair are moved, but for a few that the sieve lets by."""
    kind = dict(pairs.dtypes)["u"]
    involved = cut_lineage(pairs.select(F.explode(F.array("u", "v")).alias("doc")).distinct())
    source = docs.select(F.col(id_col).alias("doc"), as_bytes(text_col).alias("text"))
    source = _sieved(source, involved).join(involved, "doc")

    def sets():
        shingle = Shingler(words)
        return lambda batch: {
            "doc": batch.column("doc"), "tokens": [shingle(t.as_py()).tobytes() for t in batch.column("text")]
        }

    tokens = cut_lineage(map_batches(source.select("doc", "text"), f"doc {kind}, tokens binary", sets))

    def make():
        def linked(a: bytes, b: bytes) -> bool:
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            return 100 * both >= percent * (len(a) + len(b) - both)

        def work(batch: pa.RecordBatch) -> dict:
            both = zip(batch.column("tu").to_pylist(), batch.column("tv").to_pylist())
            at = pa.array([i for i, (a, b) in enumerate(both) if linked(a, b)], pa.int64())
            return {"u": batch.column("u").take(at), "v": batch.column("v").take(at)}

        return work

    joined = pairs.join(tokens.select(F.col("doc").alias("u"), F.col("tokens").alias("tu")), "u").join(
        tokens.select(F.col("doc").alias("v"), F.col("tokens").alias("tv")), "v"
    )
    linked = cut_lineage(map_batches(joined.select("u", "v", "tu", "tv"), f"u {kind}, v {kind}", make))
    drop_stages(involved, tokens)
    return linked


def _shared(prefixes: DataFrame) -> DataFrame:
    """(token, doc, n, at, low, high): the tokens that several sets have, with the smallest and the greatest of these sets.

    Most tokens stand in one set alone and say nothing. All are dealt by token once, here, and only the shared ones are kept.
    """
    entries = prefixes.select("doc", "n", F.posexplode("prefix").alias("at", "token"))
    alike = Window.partitionBy("token")
    ends = entries.withColumns({"low": F.min("doc").over(alike), "high": F.max("doc").over(alike)})
    return ends.filter(F.col("low") != F.col("high")).select("token", "doc", "n", "at", "low", "high")


def _ends(grouped: DataFrame, turn: int) -> DataFrame:
    """(token, ends): some (group, doc) of each token that stands in several groups, drawn by hash."""
    seeds = [F.lit(turn * DRAWS + i) for i in range(DRAWS)]
    orders = [F.struct(F.xxhash64("group", x), "group", F.xxhash64("doc", x), "doc") for x in seeds]
    ends = grouped.groupBy("token").agg(
        *(end(order).alias(f"_{end.__name__}_{i}") for i, order in enumerate(orders) for end in (F.min, F.max))
    )
    several = F.col("_min_0.group") != F.col("_max_0.group")
    named = [F.struct(F.col(f"{c}.group"), F.col(f"{c}.doc")) for c in ends.columns[1:]]
    return ends.filter(several).select("token", F.array(*named).alias("ends"))


def _spokes(named: DataFrame) -> DataFrame:
    """(u, v): each set with the sets of other groups that most of its tokens name, one for each kind of end.

    ``named``: (doc, group, ends) of each token.
    """
    votes = named.select("doc", "group", F.posexplode("ends").alias("kind", "end"))
    best = (
        votes.filter(F.col("group") != F.col("end.group")).groupBy("kind", "doc", F.col("end.doc").alias("u"))
        .agg(F.count("*").alias("both"))
        .groupBy("kind", "doc").agg(F.min(F.struct((-F.col("both")).alias("less"), "u")).alias("best"))
        .select(F.col("best.u").alias("u"), F.col("doc").alias("v"))
    )
    return best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _crowded(grouped: DataFrame, in_index: Column) -> bool:
    """Whether the matrix would make more than ``CROWDED`` rows an entry."""
    each = grouped.groupBy("token", "group").agg(F.count("*").alias("k"), F.max(in_index.cast("int")).alias("indexed"))
    met = each.groupBy("token").agg(F.sum("k").alias("k"), F.sum("indexed").alias("groups"))
    row = met.agg(F.sum("k").alias("entries"), F.sum(F.col("k") * F.col("groups")).alias("rows")).first()
    return (row.rows or 0) > CROWDED * (row.entries or 0)


def _opened(queries: DataFrame, members: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of queries (v, target) and members (target, u) that the prefixes don't rule out.

    A group's members are dealt into chunks of a bounded number; a query meets each chunk as a whole, in one row.
    """
    kind = dict(queries.dtypes)["v"]
    wanted = members.join(queries.select("target").distinct(), "target").select("target", F.col("u").alias("doc"))
    wanted = cut_lineage(wanted)
    prefixes = _sieved(prefixes, wanted.select("doc").unionByName(queries.select(F.col("v").alias("doc"))))
    sizes = wanted.groupBy("target").agg(F.count("*").alias("_all"))
    chunk = F.pmod(F.xxhash64("doc"), F.ceil(F.col("_all") / CHUNK).cast("bigint")).alias("chunk")
    chunks = (
        wanted.join(sizes, "target").join(prefixes, "doc").select("target", chunk, "doc", "n", "prefix")
        .groupBy("target", "chunk").agg(F.collect_list(F.struct("doc", "n", "prefix")).alias("held"))
    )
    probe = prefixes.select(F.col("doc").alias("v"), F.col("n").alias("nv"), F.col("prefix").alias("pv"))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sizes, lists, probes = batch.column("nv").to_numpy(), batch.column("held"), batch.column("pv")
            starts, held, probe_starts, probed = lists.offsets.to_numpy(), lists.values, probes.offsets.to_numpy(), probes.values.to_numpy()
            docs, others, prefixes_ = held.field("doc"), held.field("n").to_numpy(), held.field("prefix")
            inner, tokens = prefixes_.offsets.to_numpy(), prefixes_.values.to_numpy()
            left, right = [], []
            for i, m in enumerate(sizes):
                q = probed[probe_starts[i] : probe_starts[i + 1]]
                for j in range(starts[i], starts[i + 1]):
                    n = others[j]
                    if 100 * min(n, m) >= percent * max(n, m):
                        if _possible(n, m, tokens[inner[j] : inner[j + 1]], q, percent):
                            left.append(j)
                            right.append(i)
            return {"u": docs.take(pa.array(left, pa.int64())), "v": batch.column("v").take(pa.array(right, pa.int64()))}

        return work

    met = queries.join(probe, "v").join(chunks, "target").select("v", "nv", "pv", "held")
    pairs = cut_lineage(map_batches(met, f"u {kind}, v {kind}", make))
    drop_stages(wanted)
    return pairs


def components(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bits: int = SKETCH_BITS
) -> DataFrame:
    """(id, n_shingles, component_id), one row per input row; links: 100 * intersection >= percent * union."""
    sets, sketch = _sets(docs, words, bits, id_col, text_col)
    nodes = (
        sets.filter(F.col("doc").isNotNull() & F.col("key").isNotNull()).groupBy("key").agg(F.min("doc").alias("node"))
    )
    nodes = cut_lineage(nodes)
    prefixes = _prefixes(docs, words, percent, sketch, bits, id_col, text_col)
    # Ids that head no set are copies; the few rows that may be theirs are held against all such ids.
    heads = nodes.select(F.col("node").alias("doc")).distinct()
    copies = cut_lineage(sets.filter(F.col("doc").isNotNull()).select("doc").distinct().join(heads, "doc", "left_anti"))
    marked = cut_lineage(_sieve(prefixes, copies))
    alone = marked.filter(~F.col("maybe")).unionByName(marked.filter("maybe").join(copies, "doc", "left_anti"))
    prefixes = cut_lineage(alone.select("doc", "n", "prefix"))
    drop_stages(marked, copies)

    n = F.col("n")
    in_index = F.col("at") < n - F.ceil(F.lit(2 * percent) * n / (100 + percent)).cast("bigint") + 1

    # Step 1: groups around sets of other groups that most tokens of a set name.
    shared = cut_lineage(_shared(prefixes))
    first, stored = None, [shared]
    for turn in range(ROUNDS):
        if turn == 0:  # each set is its own group; the ends are the smallest and the greatest set
            both = [F.struct(F.col(c).alias("group"), F.col(c).alias("doc")) for c in ("low", "high")]
            named = shared.select("doc", F.col("doc").alias("group"), F.array(*both).alias("ends"))
        else:
            ends = cut_lineage(_ends(grouped, turn))
            stored.append(ends)
            shared = grouped.join(ends.select("token"), "token", "left_semi")  # a token of one group says nothing
            named = grouped.join(ends, "token")
        spokes = cut_lineage(_bounded(_spokes(named), prefixes, percent))
        found = _linked(spokes, docs, words, percent, id_col, text_col)
        first = found if first is None else first.unionByName(found)
        groups = cut_lineage(resolve(first))
        grouped = cut_lineage(
            shared.join(groups.select(F.col("node").alias("doc"), "root"), "doc", "left").select(
                "token", "doc", "n", "at", F.coalesce("root", "doc").alias("group")
            )
        )
        drop_stages(spokes, groups, *stored)
        stored = [grouped]
        if found.isEmpty() or not _crowded(grouped, in_index):
            break

    # Step 2: the matrix, queries on it, and the groups they open.
    members = grouped.filter(in_index)
    matrix = members.groupBy("token", F.col("group").alias("target")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max(n - F.col("at")).alias("rest")
    )
    # The first token that a linked pair shares leaves both sets enough tokens for the overlap; a query is the larger set.
    shortest = F.greatest("least", F.ceil(F.lit(percent) * n / 100).cast("bigint"))
    needed = F.ceil(F.lit(percent) * (n + shortest) / (100 + percent)).cast("bigint")
    queries = (
        grouped.join(matrix, "token")
        .filter(F.col("group") != F.col("target"))
        .filter((F.col("least") <= n) & (F.col("most") * 100 >= n * percent))
        .filter((n - F.col("at") >= needed) & (F.col("rest") >= needed))
        .select(F.col("doc").alias("v"), "target")
        .distinct()
    )
    inside = members.select(F.col("group").alias("target"), F.col("doc").alias("u")).distinct()
    queries = cut_lineage(queries)
    pairs = _opened(queries, inside, prefixes, percent)
    drop_stages(queries, prefixes, *stored)
    second = _linked(pairs, docs, words, percent, id_col, text_col)
    drop_stages(pairs)
    roots = resolve(first.unionByName(second))

    # All members of a component, also copies, get its smallest id.
    by_set = nodes.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select(
        "key", F.coalesce("root", "node").alias("component_id")
    )
    return sets.join(by_set, "key", "left").select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"),
    )


def keep_one(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents that head their component; rows with a null id stay."""
    found = components(docs, words, percent, id_col, text_col)
    (gone,) = unused_names(docs, "gone")
    others = found.filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(gone)).distinct()
    return docs.join(others, F.col(id_col) == F.col(gone), "left_anti")
