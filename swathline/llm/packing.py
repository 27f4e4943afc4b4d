"""Best-fit packing planned on the length histogram.

Tokens are counted once per document; only a histogram of piece lengths (at most ``capacity`` entries) reaches the
driver. Best-fit decreasing runs there over counts, not documents: all sequences with the same history are one range, so
the plan is a short list of (length, ranks, sequences, offsets). Pieces then take their planned place by joining on
their rank within their length.

A document is its token ids and the end id. Only documents longer than the capacity are cut, into pieces of exactly
the capacity; the first piece takes what is over. Null or empty text: one piece with the end id alone. Repeated rows are
packed each for itself; rows with a null id too. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from sys import byteorder

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathline.llm.common import map_batches
from swathline.session import cut_lineage

CAPACITY = 2048
KNOWN_WORDS = 150_000
#: A space between white space (or the end) on both sides: only there the pre-tokeniser looks past a space.
_RAGGED = re.compile(r"\s (?:\s|$)")


def pack_ids(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    The byte-level pre-tokeniser never joins what stands before a space to what follows, so a text is encoded word
    by word and the ids of words are kept, in two generations of bounded size. Texts in which white space surrounds a space
    go through the tokeniser whole. If the vocabulary is a byte-level BPE whose ids follow its merges, and its pattern is
    given, new words are merged by the ranks of that same vocabulary, which gives the same ids in less time.
    """

    def __init__(self, path: str, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        ranks = _ranks(path) if pattern else None
        if ranks:
            import tiktoken

            merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.ids = lambda text: pack_ids(merge(text))
        else:
            self.ids = self._whole
        self.known = _Words(self.ids)

    def _whole(self, text: str) -> bytes:
        return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if _RAGGED.search(text):
            return self._whole(text)
        head, *rest = text.split(" ")
        return self.ids(head) + b"".join(map(self.known.__getitem__, rest))


class _Words(dict):
    """The ids of a word after a space; words not asked for during a whole generation are forgotten."""

    def __init__(self, ids):
        super().__init__()
        self.ids, self.older = ids, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.older = dict(self)
            self.clear()
        value = self.older.get(word)
        if value is None:
            value = self.ids(" " + word)
        self[word] = value
        return value


def _ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as bytes, if it is a byte-level BPE in which each merge has the next free id."""
    import json

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    if model.get("type") != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that stand for themselves
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    vocabulary, merges = model["vocab"], model["merges"]
    for i, merge in enumerate(merges):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if vocabulary.get(left + right) != 256 + i:
            return None
    known = {t: i for t, i in vocabulary.items() if i < 256 + len(merges)}
    if len(known) != 256 + len(merges) or not all(c in byte_of for t in known for c in t):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in known.items()}


def tokenize_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, pattern: str | None = None
) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document."""
    schema = f"doc {dict(docs.dtypes)[id_col]}, piece int, start bigint, length bigint, ids_crc32 bigint"
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def make():
        encode = Encoder(tokenizer, pattern).encode

        def work(batch: pa.RecordBatch) -> dict:
            at, pieces, starts, lengths, sums = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = (encode(text) if text else b"") + end
                n, begin, piece = len(ids) // 4, 0, 0
                stop = n % capacity or capacity
                while begin < n:
                    at.append(i)
                    pieces.append(piece)
                    starts.append(begin)
                    lengths.append(stop - begin)
                    sums.append(zlib.crc32(ids[4 * begin : 4 * stop]))
                    begin, stop, piece = stop, stop + capacity, piece + 1
            return {
                "doc": batch.column(0).take(pa.array(at, pa.int64())),
                "piece": pieces, "start": starts, "length": lengths, "ids_crc32": sums,
            }

        return work

    return map_batches(docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")), schema, make)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, items, per sequence, first sequence, offset) entries."""
    ranges: dict[int, list[tuple[int, int]]] = {}  # residual -> ranges (first sequence, count)
    residuals: list[int] = []
    entries, sequences = [], 0

    def put(residual: int, first: int, count: int) -> None:
        if count and residual:
            if residual not in ranges:
                ranges[residual] = []
                insort(residuals, residual)
            ranges[residual].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(residuals, length)
            if at < len(residuals):
                residual = residuals[at]
                first, count = ranges[residual].pop()
                if not ranges[residual]:
                    del ranges[residual], residuals[at]
            else:
                residual, first, count = capacity, sequences, -(-left // (capacity // length))
                sequences += count
            each = residual // length
            full = min(count, left // each)
            if full:
                entries.append((length, rank, full * each, each, first, capacity - residual))
                put(residual - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            over = left if full < count and left < each else 0
            if over:
                entries.append((length, rank, over, over, first + full, capacity - residual))
                put(residual - over * length, first + full, 1)
                rank, left, full = rank + over, 0, full + 1
            put(residual, first + full, count - full)
    return entries


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id",
    text_col: str = "text", part_rows: int = 64, pattern: str | None = None,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    ``pattern``: that of a byte-level pre-tokeniser, for speed (see ``Encoder``). ``part_rows``: ranks are taken in parts of about this many rows, or twice the mean of the lengths if that is more.
    """
    spark = docs.sparkSession
    pieces = cut_lineage(tokenize_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, pattern))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    target = max(part_rows, 2 * sum(histogram.values()) // capacity)
    spread = spark.createDataFrame([(k, max(1, -(-n // target))) for k, n in histogram.items()], "length long, parts long")
    cells = pieces.join(F.broadcast(spread), "length").withColumn("part", F.pmod(F.xxhash64("doc", "piece"), F.col("parts")))
    starts, done = {}, {}
    for r in sorted(cells.groupBy("length", "part").agg(F.count("*").alias("n")).collect()):
        starts[r.length, r.part] = done.get(r.length, 0)  # at most 1.5 x capacity cells beyond part_rows rows each
        done[r.length] = done.get(r.length, 0) + r.n
    entries = plan(histogram, capacity)
    window = Window.partitionBy("length", "part").orderBy("doc", "piece", "ids_crc32")
    ranked = cells.withColumn("rank", F.row_number().over(window))
    columns = ["doc", "piece", "start", "length", "ids_crc32"]
    schema = ", ".join(f"{c} {t}" for c, t in ranked.select(*columns).dtypes) + ", sequence_id bigint, offset bigint"
    by_length: dict[int, list] = {}
    for entry in entries:
        by_length.setdefault(entry[0], []).append(entry[1:])
    table = {k: np.asarray(v, dtype=np.int64) for k, v in by_length.items()}

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            lengths = batch.column("length").to_numpy()
            parts, ranks = batch.column("part").to_numpy(), batch.column("rank").to_numpy()
            shift = np.fromiter((starts[k] for k in zip(lengths.tolist(), parts.tolist())), np.int64, len(lengths))
            ranks = ranks - 1 + shift
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            for chunk in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                length = int(lengths[chunk[0]])
                rows = table[length]
                entry = rows[np.searchsorted(rows[:, 0], ranks[chunk], side="right") - 1]
                inside = ranks[chunk] - entry[:, 0]
                sequence[chunk] = entry[:, 3] + inside // entry[:, 2]
                offset[chunk] = entry[:, 4] + inside % entry[:, 2] * length
            return {c: batch.column(c) for c in columns} | {"sequence_id": sequence, "offset": offset}

        return work

    return map_batches(ranked, schema, make).withColumnRenamed("doc", id_col)
