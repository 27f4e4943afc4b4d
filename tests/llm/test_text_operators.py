"""Operators on documents against brute force, on the smallest tables and on awkward rows."""

import random
from collections import Counter, defaultdict
from zlib import crc32

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from swathline.llm import decontaminate, jaccard, linededup, packing, queries, sharding, toxicity


def rows_of(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.collect()]


# 1. Jaccard join


def check_components(frame, docs, words, percent):
    got = {d: (n, c) for d, n, c in rows_of(frame, "doc_id", "n_shingles", "component_id")}
    assert got == brute.jaccard_components(docs, words, percent)


def test_jaccard_query(spark, folder, folder_rows):
    frame = queries.op1_ngram_jaccard(spark, folder)
    check_components(frame, folder_rows("documents", "doc_id", "text"), 4, 85)


def test_jaccard_awkward(awkward):
    check_components(jaccard.components(awkward), rows_of(awkward, "doc_id", "text"), 5, 80)


def test_jaccard_chains_copies_and_common_passages(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    docs, base = [], [word() for _ in range(60)]
    for i in range(40):  # a chain in which the ends aren't alike
        base[i % len(base)] = word()
        docs.append(list(base))
    docs += [[word() for _ in range(rng.randint(2, 12))] + passage for _ in range(60)]  # alike in the passage alone
    docs += [list(docs[3])] * 20
    docs += [[word() for _ in range(n)] for n in (1, 2, 3, 4, 5, 6)] * 2
    named = [(i, " ".join(d)) for i, d in enumerate(docs)]
    rng.shuffle(named)
    frame = spark.createDataFrame(named, "doc_id long, text string").repartition(5)
    for words, percent in ((4, 85), (5, 80), (1, 60)):
        check_components(jaccard.components(frame, words, percent, bits=10), named, words, percent)


def test_jaccard_null_ids_and_repeats(spark):
    frame = spark.createDataFrame(
        [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string"
    )
    got = sorted(rows_of(jaccard.components(frame), "doc_id", "component_id"), key=str)
    assert got == [(2, 2), (2, 2), (5, 2), (None, None)]
    assert sorted(rows_of(jaccard.keep_one(frame), "doc_id"), key=str) == [(2,), (2,), (None,)]


def test_jaccard_text_ids_and_clashing_names(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 10**6)}" for _ in range(60)] for _ in range(6)]
    docs = [(f"d{i:03d}", " ".join([*base[i % 6][:57], f"x{i % 9}", "end"])) for i in range(40)]
    frame = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id string, text string, n long, gone string")
    check_components(jaccard.components(frame), docs, 5, 80)
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns and sorted(rows_of(kept, "doc_id")) == [(f"d{i:03d}",) for i in range(6)]


def test_jaccard_deals_all_entries_by_token_once(spark, monkeypatch):
    """All prefix tokens are spread once; later rounds and the matrix only read those that several sets have."""
    plans, store = [], jaccard.cut_lineage

    def watched(frame):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return store(frame)

    monkeypatch.setattr(jaccard, "cut_lineage", watched)
    rng = random.Random(4)
    own = [" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(40)) for _ in range(30)]
    docs = [*enumerate(own), *((100 + i, own[i] + " x") for i in range(5)), (200, own[0]), (201, own[0] + " x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    check_components(jaccard.components(frame, 4, 85), docs, 4, 85)
    assert sum(p.count("posexplode(prefix") for p in plans) == 1


def test_jaccard_shared_tokens(spark):
    rows = [(1, 9, [5, 6, 7]), (2, 9, [6, 8]), (3, 9, [6, 7]), (4, 9, [4])]
    frame = spark.createDataFrame(rows, "doc long, n long, prefix array<bigint>")
    got = sorted(rows_of(jaccard._shared(frame), "token", "doc", "at", "low", "high"))
    assert got == [(6, 1, 1, 1, 3), (6, 2, 0, 1, 3), (6, 3, 0, 1, 3), (7, 1, 2, 1, 3), (7, 3, 1, 1, 3)]


# 2. Sharding


def check_shards(frame, docs, shards):
    texts = dict(docs)
    slots, sizes, homes = defaultdict(list), Counter(), defaultdict(set)
    rows = frame.collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in docs)
    for r in rows:
        text = texts[r.doc_id]
        raw = text.encode() if text is not None else b""
        assert (r.size, r.text_crc32) == (len(raw) + 16, None if text is None else crc32(raw))
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        homes[text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    return sizes


def test_shard_query(spark, folder, folder_rows):
    docs = folder_rows("documents", "doc_id", "text")
    sizes = check_shards(queries.op2_sharding(spark, folder), docs, 40)
    atoms = Counter()
    for _, t in docs:
        atoms[t] += len((t or "").encode()) + 16
    assert max(sizes.values()) <= max(max(atoms.values()), sum(atoms.values()) / 40 + sorted(atoms.values())[-2])


def test_shard_awkward_and_hot(spark, awkward):
    check_shards(sharding.shard(awkward, 3), rows_of(awkward, "doc_id", "text"), 3)
    hot = [(i, "copy" if i < 300 else f"text {i}") for i in range(900)]
    frame = spark.createDataFrame(hot, "doc_id long, text string")
    sizes = check_shards(sharding.shard(frame, 10, part_rows=16), hot, 10)
    assert len(sizes) == 10
    rest = sorted(sizes.values())[:-1]
    assert max(rest) - min(rest) <= 60


@pytest.mark.parametrize("seed", range(5))
def test_minimax_capacity(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 60))]
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    for shards in (1, 2, 5, 9):
        best = {0: 0}
        for _ in range(shards):  # the least maximum by dynamic programming
            step = {}
            for at, worst in best.items():
                total = 0
                for to in range(at, len(sizes) + 1):
                    value = max(worst, total)
                    step[to] = min(step.get(to, value), value)
                    total += sizes[to] if to < len(sizes) else 0
            best = step
        assert sharding.minimax_capacity(ends, shards) == best[len(sizes)]
        placed = sharding.cut(sizes, shards)
        assert set(placed) <= set(range(shards))


# 5. Packing


def check_packing(frame, docs, capacity, tokenizer):
    rows = frame.collect()
    want = brute.pieces(docs, tokenizer, capacity)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), -(-sum(r.length for r in rows) // capacity)


def plain_tokenizer():
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_packing_query(spark, folder, folder_rows):
    used, least = check_packing(
        queries.op5_best_fit_packing(spark, folder), folder_rows("documents", "doc_id", "text"), 2048, plain_tokenizer()
    )
    assert used <= least * 1.02 + 1


def test_packing_awkward(awkward):
    docs = rows_of(awkward, "doc_id", "text")
    check_packing(packing.pack(awkward, queries.tokenizer_path(), 64, part_rows=2), docs, 64, plain_tokenizer())


def test_encoder_is_the_tokenizer():
    path, plain, rng = queries.tokenizer_path(), plain_tokenizer(), random.Random(3)
    fast = [packing.Encoder(path), packing.Encoder(path, queries.tokenizer_pattern())]
    assert packing._ranks(path) is not None
    parts = [" ", "  ", "\n", "\t", " ", "　", "a", "don't", "'s", "12", "é", "漢", "!", "?!", " \n", "\r\n", "x y", "\x85"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        ids = plain.encode(text, add_special_tokens=False).ids
        for encoder in fast:
            assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == ids, repr(text)


def test_plan_is_best_fit():
    rng = random.Random(5)
    for _ in range(30):
        histogram = {rng.randint(1, 40): rng.randint(1, 60) for _ in range(rng.randint(1, 12))}
        used = {}
        seen = Counter()
        for length, rank, items, each, first, offset in packing.plan(histogram, 40):
            for i in range(items):
                used.setdefault(first + i // each, []).append((offset + i % each * length, length))
            seen[length] += items
        assert seen == histogram
        residual = []
        for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
            fit = [r for r in residual if r >= length]
            if fit:
                residual.remove(min(fit))
            residual.append((min(fit) if fit else 40) - length)
        assert len(used) == len(residual)
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 40


# 6. Lines


def test_lines_awkward(awkward):
    docs = rows_of(awkward, "doc_id", "source", "text")
    got = dict(rows_of(linededup.remove_boilerplate(awkward, removed_col="gone"), "doc_id", "text"))
    assert got == dict(brute.without_boilerplate(docs))
    assert (got[9], got[10], got[12]) == (docs[8][2], "own text of ten", "")


def test_lines_near_the_threshold(spark):
    docs = [(100 * n + s, f"s{s}", f"line of {n} sites here\nown line number {n} {s}") for n in range(1, 40) for s in range(n)]
    docs += [(None, "s99", "line of 3 sites here"), (9001, None, "line of 3 sites here"), (9002, "s1", None)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(6)
    for threshold in (4, 20):
        found = linededup.remove_boilerplate(frame, min_sites=threshold, log_k=5)
        want = brute.without_boilerplate(docs, threshold)
        assert Counter(rows_of(found, "doc_id", "text")) == Counter(want)


def test_lines_by_any_white_space_and_script(spark):
    lines = ["版权所有不得转载", "すべての権利を保有します", "Terms\tof\tuse\tapply", "Terms of\u3000use  apply\r", "a\u00a0b c\td", "版权", "All rights reserved."]
    docs = [(s, f"s{s}", "\n".join([f"own text of number {s}", "", *lines])) for s in range(5)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = dict(rows_of(linededup.remove_boilerplate(frame), "doc_id", "text"))
    assert got[0] == docs[0][2] and got[4] == "own text of number 4\n\n版权\nAll rights reserved."
    got = dict(rows_of(linededup.remove_boilerplate(frame, min_words=1), "doc_id", "text"))
    assert got[0] == docs[0][2] and got[4] == "own text of number 4\n"
    mixed = [(s, f"s{s}", ("x y  z w", "x\ty z w\r", " x y z w", "x y z\u3000w")[s]) for s in range(4)]
    got = dict(rows_of(linededup.remove_boilerplate(spark.createDataFrame(mixed, frame.schema)), "doc_id", "text"))
    assert got == {0: mixed[0][2], 1: "", 2: "", 3: ""}


def test_lines_rows_of_one_id_and_clashing_names(spark):
    docs = [(s, f"s{s}", f"a line of four sites\nown {s}", s, "x") for s in range(5)]
    docs += [(4, "s4", "own text\na line of four sites\nown 4", 7, None), (4, "s4", docs[4][2], 8, "y")]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string, _doc long, drop string")
    got = linededup.remove_boilerplate(frame.withColumnRenamed("drop", "Body"), removed_col="gone")
    assert got.columns == ["doc_id", "source", "text", "_doc", "Body", "gone"]
    want = [t for _, t in brute.without_boilerplate([d[:3] for d in docs])]
    assert Counter(map(tuple, got.collect())) == Counter(
        (d[0], d[1], w, d[3], d[4], int(d[2] != w)) for d, w in zip(docs, want)
    )


# 8. Toxicity


def test_toxicity_query(spark, folder, folder_rows):
    got = queries.op8_toxicity_pu(spark, folder).collect()
    assert {r.doc_id for r in got} == {d for (d,) in folder_rows("documents", "doc_id")}
    for r in got:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.7)


def toxic_table(spark, n=1500):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    vocabulary, bad = [word() for _ in range(400)], ["zorgle", "krump", "blexid"]
    docs, labels = [], []
    for i in range(n):
        text, toxic = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))], int(rng.random() < 0.15)
        for _ in range(rng.randint(1, 4) * toxic):
            text.insert(rng.randint(0, len(text)), rng.choice(bad))
        docs.append((i, " ".join(text)))
        labels.append((i, toxic if rng.random() < 0.9 else None))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return frame, spark.createDataFrame(labels, "doc_id long, toxic int"), {i: sum(b in t for b in bad) > 0 for i, t in docs}


def test_toxicity_finds_held_out_documents(spark):
    docs, labels, truth = toxic_table(spark)
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in got if r.held_out]
    caught = [r.predicted for r in held if truth[r.doc_id]]
    wrong = [r.predicted for r in held if not truth[r.doc_id]]
    assert sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.02 * len(wrong)


def test_toxicity_never_reads_held_out_labels(spark):
    docs, labels, _ = toxic_table(spark, 300)
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(string(doc_id) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic")
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_toxicity_awkward(spark, awkward):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(awkward, toxicity.fit(awkward, none)).collect()} == {0.0}
    some = spark.createDataFrame([(i, int(i > 8)) for i in range(15)], "doc_id long, toxic int")
    model = toxicity.fit(awkward, some)
    got = toxicity.score(awkward, model, keep=awkward.columns)
    assert got.count() == 14 and got.columns[: len(awkward.columns)] == awkward.columns
    clashing = awkward.withColumn("score", F.lit("own")).withColumn("predicted", F.lit(0)).withColumn("held_out", F.lit(1))
    want = [tuple(r) for r in toxicity.score(awkward, model).select("doc_id", "predicted").collect()]
    assert [tuple(r) for r in toxicity.score(clashing, model).select("doc_id", "predicted").collect()] == want
    kept = toxicity.drop_toxic(clashing, model)
    assert kept.columns == clashing.columns and kept.filter("score = 'own'").count() == sum(not p for _, p in want)


# 10. Decontamination

REPORT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontaminate_query(spark, folder, folder_rows):
    want = brute.decontaminated(folder_rows("documents", "doc_id", "text"), folder_rows("benchmark", "item_id", "text"))
    assert Counter(rows_of(queries.op10_wu_manber(spark, folder), *REPORT)) == Counter(want)
    assert any(w[-1] for w in want)


def test_decontaminate_awkward_in_one_and_many_blocks(spark, awkward):
    items = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa alpha"), (2, None), (3, ""), (4, "Three"),
        (5, "two THREE"), (6, "own text of"), (7, "same line of words"), (8, "same line of words own text of ten"),
        (8, "words here"), (10, "漢字"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter(brute.decontaminated(rows_of(awkward, "doc_id", "text"), items))
    for block in (1000, 2, 1):
        got = decontaminate.decontaminate(awkward, bench, block_windows=block)
        assert Counter(rows_of(got, *REPORT)) == want
        clashing = awkward.withColumn("n_words", F.lit("own")).withColumn("contaminated", F.lit(1)).withColumn("held", F.lit(2))
        left = decontaminate.drop_contaminated(clashing, bench, block_windows=block)
        assert left.columns == clashing.columns and left.filter("n_words = 'own' and held = 2").count() == left.count()
        assert Counter(rows_of(left, "doc_id")) == Counter((w[0],) for w in want.elements() if not w[-1])
    kept = decontaminate.decontaminate(awkward, bench.limit(0), keep=awkward.columns)
    assert kept.filter("contaminated").count() == 0 and kept.count() == 14


# All


@pytest.mark.parametrize(
    "apply",
    [
        lambda d, e: jaccard.components(d), lambda d, e: sharding.shard(d), lambda d, e: linededup.remove_boilerplate(d),
        lambda d, e: packing.pack(d, queries.tokenizer_path()), lambda d, e: toxicity.score(d, toxicity.fit(d, e)),
        lambda d, e: decontaminate.decontaminate(d, e.selectExpr("doc_id item_id", "'a b' text")),
    ],
)
def test_empty_tables(spark, awkward, apply):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert apply(awkward.limit(0), labels).collect() == []
