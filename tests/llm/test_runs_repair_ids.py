"""Periodic runs, conversation repair and token-id files against brute force and exact round trips."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.llm import idfiles, periodic, queries, repair

# 11. Periodic runs


def run_rows(frame):
    return {
        r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
        for r in frame.collect()
    }


def test_runs_query(spark, folder, folder_rows):
    rows = folder_rows("documents", "doc_id", "text")
    want = {d: brute.run_report(brute.planted_words(d, t)) for d, t in rows}
    assert run_rows(queries.op11_periodic_runs(spark, folder)) == want
    assert sum(w[0] > 0 for w in want.values()) >= 5


def periodic_text(rng, n):
    found, letters = [], rng.choice(["a", "ab", "ab", "abc", "abcdefghij"])
    while len(found) < n:
        block = [rng.choice(letters) for _ in range(rng.randrange(1, 14))]
        found += block * rng.randrange(1, 8) + block[: rng.randrange(len(block) + 1)]
    return found[:n]


@pytest.mark.parametrize("least_tile", [8, 64, 4096])
def test_runs_tiles_stitched(monkeypatch, least_tile):
    monkeypatch.setattr(periodic, "LEAST_TILE", least_tile)
    rng = random.Random(least_tile)
    for _ in range(300):
        found = periodic_text(rng, rng.randrange(0, 200))
        codes = periodic.word_codes([w.encode() for w in found])
        pieces = sorted(
            (q, first + s, first + e) for k, first, part in periodic.tiles(codes) for q, s, e in periodic.solve(part, k)
        )
        whole = []
        for q, s, e in pieces:
            if whole and whole[-1][0] == q and s <= whole[-1][2]:
                whole[-1][2] = max(e, whole[-1][2])
            else:
                whole.append([q, s, e])
        got = sorted(((s, e - s + q, q) for q, s, e in whole if e - s + q >= 6), key=lambda r: (r[0], r[2]))
        assert got == brute.runs(found)


def test_runs_awkward_rows(spark, awkward, monkeypatch):
    rng = random.Random(5)
    more = [(100 + i, " ".join(periodic_text(rng, 300))) for i in range(40)]
    more += [(None, "a b " * 9), (None, None), (7, "x " * 7), (7, "x " * 7), (200, "\t".join(["ü"] * 5)), (201, "é " * 9000)]
    rows = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    clash = rows.withColumns({c: F.lit(1) for c in ("uid", "doc", "n", "runs", "octave", "codes", "start", "period")})
    documents, runs = periodic.periodic_runs(clash)
    got = sorted((str(r.doc_id), r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
                 for r in documents.collect())
    want = sorted(((str(d), *brute.run_report(brute.words(t))) for d, t in rows.collect()), key=str)
    assert sorted(got, key=str) == want
    assert runs.count() == sum(w[1] for w in want)
    documents, runs = periodic.periodic_runs(rows.limit(0))
    assert documents.count() == 0 and runs.count() == 0
    named = rows.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body"))
    documents, _ = periodic.periodic_runs(named, "name", "body")
    assert documents.count() == len(want)


def test_runs_long_text_many_tiles(spark):
    block = [f"w{i}" for i in range(3000)]
    found = ["x"] * 20_000 + block * 5 + ["y", "z"] * 9000 + [f"u{i}" for i in range(5000)]
    _, runs = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(found))], "doc_id long, text string"))
    got = sorted((r.start, r.length, r.period) for r in runs.collect())
    assert got == [(0, 20_000, 1), (20_000, 15_000, 3000), (35_000, 18_000, 2)]


# 12. Conversation repair

REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def reports(frame):
    return {r.conv_id: tuple(r[c] for c in REPORT) for r in frame.collect()}


def want_reports(rows):
    return {c: brute.repair_report(r) for c, r in brute.damaged(rows).items()}


def test_repair_query(spark, folder, folder_rows):
    want = want_reports(folder_rows("conversations", "conv_id", "turn", "role", "text"))
    assert reports(queries.op12_conversation_repair(spark, folder)) == want


def test_repair_tables_against_shortest_paths():
    rng = random.Random(11)
    table = repair.Tables()
    for block in (table, repair.Tables(1), repair.Tables(3)):
        for _ in range(400):
            weights = rng.choice([None, [3, 1, 5, 1, 5, 1, 1, 1, 2]])
            symbols = rng.choices(range(9), weights, k=rng.randrange(0, 15))
            marks = [
                ("x", "blank") if repair.SYMBOLS[s] is None else
                (repair.SYMBOLS[s][0], "truncated" if repair.SYMBOLS[s][1] else "") for s in symbols
            ]
            cost, edits = block.solve(np.array(symbols, np.int64))
            assert (cost, "".join(edits)) == brute.cheapest_edits(marks)[:2]
    assert len(table.vectors) < 64


def test_repair_awkward_rows(spark):
    rng = random.Random(2)
    texts = ["Yes.", "No!", "Cut", "", " \t", "é?", "...", "Long text. " * 3000, "Line.\n", None]
    roles = ["user", "assistant", "system", "tool", "", "User", None]
    rows = [
        (conv, rng.choice([None, *range(-3, 30)]), rng.choice(roles[: rng.choice([2, 3, 7])]), rng.choice(texts))
        for conv in [None, *range(60)] for _ in range(rng.randrange(0, 25))
    ]
    rows += [(70, 1, "user", "Same.")] * 9 + [(71, None, None, None)] + [(72, 5, "system", "Only.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = frame.withColumns({c: F.lit("x") for c in ("conv", "n", "copies", "mark", "seq", "_c", "_kind", "chunk", "edits")})
    assert reports(repair.repaired_reports(repair.damage(clash), clash)) == want_reports(rows)
    empty = frame.limit(0)
    assert repair.repaired_reports(repair.damage(empty), empty).count() == 0


def test_repair_long_conversation_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_BITS", 3)
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["A.", "B", f"{t}.", f"{t}!"])) for t in range(700)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert reports(repair.repaired_reports(repair.damage(frame), frame)) == want_reports(rows)


def test_repair_rows(spark):
    rows = [("c", 0, "system", "Be kind."), ("c", 1, "assistant", "Hello."), ("c", 2, "assistant", "Hello."), ("c", 3, "user", "Hi")]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    found, repaired = repair.repair(frame)
    (report,) = found.collect()
    # The last row isn't wanted: keeping it would cost its end and an answer.
    assert (report.audit, report.cost, report.duplicate, report.truncated) == ("KIKDD", 11, 1, 1)
    out = [(r.role, r.text) for r in repaired.orderBy("seq", "place").collect()]
    assert out == [("system", "Be kind."), ("user", ""), ("assistant", "Hello.")]


# 13. Token-id files


def word_encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path(queries.WORD_TOKENIZER))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_query(spark, folder, folder_rows):
    want = brute.id_report(folder_rows("documents", "doc_id", "text"), word_encode(), 1)
    got = queries.op13_pfor_ids(spark, folder).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


def test_ids_blocks_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 255, 256, 257, 5000):
        for kind in ("small", "wide", "spiky", "same"):
            ids = {
                "small": rng.integers(0, 50, n), "wide": rng.integers(0, 1 << 32, n), "same": np.full(n, 7),
                "spiky": np.where(rng.random(n) < 0.05, rng.integers(0, 1 << 32, n), rng.integers(1000, 1040, n)),
            }[kind].astype("<u4")
            data = idfiles.write_segment(["a", None, "ü"], [0, n, 0], ids)
            segment = idfiles.Segment(b"...." + data, 4)
            assert segment.names == ["a", None, "ü"] and segment.counts.tolist() == [0, n, 0] and segment.size == len(data)
            assert np.array_equal(segment.read(), ids)
            for _ in range(5):
                a, b = sorted(rng.integers(0, n + 1, 2).tolist())
                assert np.array_equal(segment.read(a, b), ids[a:b])
            if kind == "spiky" and n >= 256:
                assert segment.exceptions.sum() > 0 and (segment.widths[:-1] <= 6).all()
            if kind == "same":
                assert len(data) < 120 + 24 * -(-n // 256)


def test_ids_awkward_rows(spark, awkward, tmp_path):
    texts = ["It's 12 o'clock now ΑΣ ΟΔΟΣ İ <|endoftext|> éa\x1cb\x85c", "a\tb\nc\r\nd", "'S 't' ll", "ÀÉÎÕÜß Ÿÿ µª straße, (Ça?!) don't. 5th x's, e\u0301. J\u030c. É)) naïve;.", "漢字 ̀x"]
    more = [(1000 - i, t) for i, t in enumerate(texts)]
    rows = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    clash = rows.withColumns({c: F.lit(1) for c in ("doc", "hash", "path", "place", "id", "start", "_before", "value")})
    path, words = str(tmp_path / "ids"), queries.tokenizer_path(queries.WORD_TOKENIZER)
    idfiles.write(clash, path, words, 1, by_word=True, plain=queries.PLAIN_WORDS, segment_ids=5000, segments_in_file=1)
    assert len(list((tmp_path / "ids").glob("part-*"))) >= 3
    got = idfiles.read(spark, path, with_ids=True).collect()
    held = [(r.doc_id, r.text) for r in rows.collect()]
    want = brute.id_report(held, word_encode(), 1)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
    encode = word_encode()
    assert {r.doc_id: list(r.ids) for r in got} == {d: [*encode(t or ""), 1] for d, t in held}
    whole = idfiles.round_trip(rows, words, 1).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in whole} == want


def test_ids_repeated_null_and_text_ids(spark):
    rows = [("b", "two words"), ("a", "one"), (None, "none"), ("a", "one"), (None, None), ("", "blank")]
    frame = spark.createDataFrame(rows, "name string, body string")
    words = queries.tokenizer_path(queries.WORD_TOKENIZER)
    got = sorted(idfiles.round_trip(frame, words, 1, "name", "body", by_word=True).collect(), key=lambda r: r.start)
    assert sorted(r.name or "" for r in got[:2]) == ["", ""] and [r.name for r in got[2:]] == ["", "a", "a", "b"]
    assert [r.name for r in got].count(None) == 2
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))
    assert idfiles.round_trip(frame.limit(0), words, 1, "name", "body").count() == 0
