"""Token ids in binary files of patched frame-of-reference blocks.

The ids of all documents, each with an end id, stand in ascending order of document id, in files of their own format. A file
is a row of segments, a segment holds whole documents: as many as reach ``SEGMENT_IDS`` ids. Its ids are cut into blocks of
256, whatever document they belong to. From a block its minimum is subtracted; the rest is packed at a width that a
percentile of the block's values needs, taken from ``PERCENTILES`` by the bytes it costs; values that need more are
exceptions: their low bits are packed, their places and high bits are listed behind. The index holds where each block
starts, so that any range of ids is read by its blocks alone.

A segment, little-endian throughout:

    magic ``PFB1`` | bytes of the whole segment u64 | documents u32 | ids u64 | blocks u32 | bytes of document ids u32
    per document: length of its id as text i32 (-1: null)    the ids as text    per document: its number of ids u64
    per block: start u64 (from the payload on), minimum u32, exceptions u16, width u8
    payload, per block: 4 * width words of 64 bits, four lanes of 64 values | places u8 | high bits u32

Every segment is followed by one newline, because Spark's text writer puts it there: files go through that writer and come
back through the binary reader, so that any file system of Spark will do and a task that is lost leaves no torn file.
Documents are range-sorted by id, then by a hash of the text, so that a repeated id isn't one task; rows with equal ids
stand by that hash, then by text. Null ids come first. Null or empty text: the end id alone. Empty table: no segment.
One document's ids are held by one task. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.functions.ranking import running_totals
from swathline.llm.common import map_batches
from swathline.session import scratch_path

BLOCK = 256
LANES = BLOCK // 64
PERCENTILES = (1.0, 0.98, 0.95, 0.9, 0.8)
SEGMENT_IDS = 1 << 19
SEGMENTS_IN_FILE = 16
KNOWN_WORDS, KNOWN_STEMS = 50_000, 250_000
SLICE_BYTES = 1 << 22
MAGIC = b"PFB1"
HEAD = "<4sQIQII"
HEAD_SIZE = struct.calcsize(HEAD)


# Blocks


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that whole numbers below 2 ** 32 need."""
    return np.frexp(values.astype(np.float64))[1]


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 numbers below 2 ** width as rows of ``width`` words."""
    out = np.zeros((len(values), width), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[:, word] |= values[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= values[:, i] >> np.uint64(64 - shift)
    return out


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        out[:, i] = value & mask
    return out


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(starts, minima, exceptions, widths, payload) of unsigned 32-bit ids."""
    blocks = -(-len(ids) // BLOCK)
    values = np.empty(blocks * BLOCK, np.uint64)
    values[: len(ids)] = ids
    if blocks:
        values[len(ids) :] = ids[-1]  # what fills the last block up costs nothing and is never read
    values = values.reshape(blocks, BLOCK)
    minima = values.min(axis=1) if blocks else np.zeros(0, np.uint64)
    values -= minima[:, None]
    need = _bits(values)
    ranked = np.sort(need, axis=1)
    choices = np.stack([ranked[:, int(np.ceil(p * BLOCK)) - 1] for p in PERCENTILES])
    size = np.stack([8 * LANES * w + 5 * (need > w[:, None]).sum(axis=1) for w in choices])
    widths = choices[size.argmin(axis=0), np.arange(blocks)] if blocks else np.zeros(0, np.int64)
    row, place = np.nonzero(need > widths[:, None])
    high = (values[row, place] >> widths[row].astype(np.uint64)).astype("<u4")
    counts = np.bincount(row, minlength=blocks)
    listed = np.concatenate([[0], np.cumsum(counts)])
    parts: list[bytes] = [b""] * blocks
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        low = values[at].reshape(-1, 64) & np.uint64((1 << width) - 1)
        packed = pack(low, width).astype("<u8").reshape(len(at), -1)
        for i, b in enumerate(at.tolist()):
            parts[b] = packed[i].tobytes()
    places = place.astype(np.uint8)
    for b in np.flatnonzero(counts).tolist():
        first, last = listed[b], listed[b + 1]
        parts[b] += places[first:last].tobytes() + high[first:last].tobytes()
    sizes = 8 * LANES * widths + 5 * counts
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return starts.astype("<u8"), minima.astype("<u4"), counts.astype("<u2"), widths.astype(np.uint8), b"".join(parts)


def write_segment(names: list[str | None], counts: list[int], ids: np.ndarray) -> bytes:
    """One segment from the documents' ids as text, their numbers of token ids, and these."""
    texts = [b"" if n is None else n.encode() for n in names]
    lengths = np.array([-1 if n is None else len(t) for n, t in zip(names, texts)], "<i4")
    starts, minima, exceptions, widths, payload = encode_blocks(ids)
    body = b"".join(
        (lengths.tobytes(), *texts, np.array(counts, "<u8").tobytes(), starts.tobytes(), minima.tobytes(),
         exceptions.tobytes(), widths.tobytes(), payload)
    )
    head = struct.pack(HEAD, MAGIC, HEAD_SIZE + len(body), len(names), len(ids), len(widths), sum(map(len, texts)))
    return head + body


class Segment:
    """A segment that stands at ``at`` in a file's bytes."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        magic, self.size, self.documents, self.ids, self.blocks, named = struct.unpack_from(HEAD, data, at)
        if magic != MAGIC or at + self.size > len(data):
            raise ValueError("not a segment")
        self._data, self._at = data, at + HEAD_SIZE
        lengths = self._take("<i4", self.documents)
        text = bytes(data[self._at : self._at + named])
        self._at += named
        stops = np.cumsum(np.maximum(lengths, 0))
        self.names = [
            None if n < 0 else text[s - n : s].decode() for n, s in zip(lengths.tolist(), stops.tolist())
        ]
        self.counts = self._take("<u8", self.documents).astype(np.int64)
        self.starts = self._take("<u8", self.blocks).astype(np.int64)
        self.minima, self.exceptions = self._take("<u4", self.blocks), self._take("<u2", self.blocks).astype(np.int64)
        self.widths = self._take("u1", self.blocks).astype(np.int64)
        self._payload = np.frombuffer(data, np.uint8, at + self.size - self._at, self._at)

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, n, self._at)
        self._at += out.nbytes
        return out

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from ``start`` to ``stop``; only their blocks are opened."""
        stop = self.ids if stop is None else min(stop, self.ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // BLOCK, -(-stop // BLOCK)
        out = np.empty((last - first, BLOCK), np.uint64)
        widths, starts, counts = self.widths[first:last], self.starts[first:last], self.exceptions[first:last]
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            spots = starts[at, None] + np.arange(8 * LANES * width)
            words = self._payload[spots].view("<u8").reshape(-1, width) if width else np.zeros((len(at) * LANES, 0), np.uint64)
            out[at] = unpack(words, width).reshape(len(at), BLOCK)
        for b in np.flatnonzero(counts).tolist():
            n, at = int(counts[b]), int(starts[b] + 8 * LANES * widths[b])
            places = self._payload[at : at + n]
            high = self._payload[at + n : at + 5 * n].copy().view("<u4")
            out[b, places] |= high.astype(np.uint64) << np.uint64(widths[b])
        out += self.minima[first:last, None]
        return out.reshape(-1)[start - first * BLOCK : stop - first * BLOCK].astype("<u4")


def segments(data: bytes | memoryview) -> Iterator[Segment]:
    """The segments of a file."""
    at = 0
    while at < len(data):
        segment = Segment(data, at)
        yield segment
        at += segment.size + 1


# Encoding


class Kept:
    """Values by key, in two generations of bounded size: what isn't asked for during a whole one is forgotten."""

    def __init__(self, make: Callable[[list[str]], Iterable[array]], size: int):
        self.make, self.size, self.now, self.older = make, size, {}, {}

    def all(self, keys: list[str]) -> list[array]:
        """The values of distinct keys; missing ones are made together."""
        now, older = self.now, self.older
        for key in keys if older else ():
            if key not in now and key in older:
                now[key] = older[key]
        missing = [key for key in keys if key not in now]
        now.update(zip(missing, self.make(missing)))
        values = list(map(now.__getitem__, keys))
        if len(now) >= self.size:
            self.now, self.older = {}, now
        return values


class Encoder:
    """Token ids of texts by the tokenizers library.

    ``by_word``: the tokeniser drops white space and never looks past it. Then texts are cut at white space, each word of
    some texts is encoded once, and the ids of words are kept; the result is that of the whole texts. ``plain``, a pattern
    with the groups ``stem`` and ``tail``: the tokeniser lower-cases such a word, takes its stem as one piece and the tail as
    others, and its model is a BPE over byte-level pieces. Then the model itself gets the stem, without the steps before it.
    """

    def __init__(self, path: str, by_word: bool = False, plain: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.by_word, self.plain = by_word, plain
        self.whole, self.stems = Kept(self._whole, KNOWN_WORDS), Kept(self._stems, KNOWN_STEMS)

    def _whole(self, texts: Iterable[str]) -> Iterator[array]:
        for text in texts:
            yield array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _stems(self, words: list[str]) -> Iterator[array]:
        pieces = "\n".join(words).encode().decode("latin-1").translate(_BYTE_LEVEL).split("\n") if words else ()
        tokenize = self.tokenizer.model.tokenize
        for piece in pieces:
            yield array("I", [token.id for token in tokenize(piece)])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each with the end id; their numbers)."""
        if not self.by_word:
            found = [ids + array("I", [end_id]) for ids in self._whole(texts.to_pylist())]
            return np.frombuffer(b"".join(found), np.uintc), np.array([len(f) for f in found], np.int64)
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        offsets = split.offsets.to_numpy()
        pieces, head, tail = self._pieces(words.dictionary)
        # Of every word its stem and what follows, of every text the end id: pieces in the order of the texts.
        index = words.indices.to_numpy()
        at = np.arange(len(index)) * 2 + np.repeat(np.arange(len(texts)), np.diff(offsets))
        order = np.full(2 * len(index) + len(texts), len(pieces))
        order[at], order[at + 1] = head[index], tail[index]
        pieces.append(array("I", [end_id]))
        sizes = np.array([len(p) for p in pieces], np.int64)
        flat = np.frombuffer(b"".join(pieces), np.uintc)
        taken = sizes[order]
        stops = np.cumsum(taken)
        shift = (np.cumsum(sizes) - sizes)[order] - (stops - taken)
        ids = flat[np.repeat(shift, taken) + np.arange(len(shift) and stops[-1])]
        ends = stops[2 * offsets[1:] + np.arange(len(texts))]
        return ids, np.diff(ends, prepend=0)

    def _pieces(self, words: pa.Array) -> tuple[list[array], np.ndarray, np.ndarray]:
        """Ids of pieces, and the numbers of each word's two pieces; the first piece is empty."""
        pieces, head, tail = [array("I")], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        other = np.ones(len(words), bool)
        if self.plain:
            found = pc.extract_regex(words, self.plain)
            other = found.is_null().to_numpy(zero_copy_only=False)
            found = found.filter(pa.array(~other))
            for numbers, part, known in (
                (head, pc.utf8_lower(pc.struct_field(found, "stem")), self.stems),
                (tail, pc.struct_field(found, "tail"), self.whole),
            ):
                part = part.dictionary_encode()
                numbers[~other] = part.indices.to_numpy() + len(pieces)
                pieces += known.all(_strings(part.dictionary))
        head[other] = np.arange(other.sum()) + len(pieces)
        pieces += self.whole.all(_strings(words.filter(pa.array(other))))
        return pieces, head, tail


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()  # much faster than value by value


@lru_cache(maxsize=1)
def encoder(path: str, by_word: bool, plain: str | None) -> Encoder:
    """One encoder for the tasks of a Python worker, with the words that it keeps (two times the bounds above)."""
    return Encoder(path, by_word, plain)


def _byte_level() -> dict[int, str]:
    """The characters that byte-level tokenisers show bytes as: printable Latin-1 as itself, the others from 256 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    others = sorted(set(range(256)) - set(shown))
    return {b: chr(256 + i) for i, b in enumerate(others) if b != ord("\n")}  # which parts words here


_BYTE_LEVEL = _byte_level()


# Files


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``SLICE_BYTES`` of text, so that what is made of them stays small."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    by_word: bool = False, plain: str | None = None, segment_ids: int = SEGMENT_IDS, segments_in_file: int = SEGMENTS_IN_FILE,
) -> None:
    """Writes the ids of all documents below ``path``. ``by_word``, ``plain``: see ``Encoder``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    order = ["doc", "hash", "text"]
    ranged = rows.repartitionByRange("doc", "hash").sortWithinPartitions(*order)
    ranged = ranged.select(F.col("doc").cast("string").alias("doc"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, by_word, plain).encode
        names, counts, held = [], [], []

        def flush():
            segment = write_segment(names, counts, np.concatenate(held))
            for part in (names, counts, held):
                part.clear()
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.binary())], names=["segment"])

        total = 0
        for batch in batches:
            for some in _slices(batch):
                ids, lengths = encode(some.column("text"), end_id)
                stop = 0
                for name, n in zip(some.column("doc").to_pylist(), lengths.tolist()):
                    start, stop = stop, stop + n
                    names.append(name)
                    counts.append(n)
                    held.append(ids[start:stop])
                    total += n
                    if total >= segment_ids:
                        yield flush()
                        total = 0
        if names:
            yield flush()

    packed = ranged.mapInArrow(run, "segment binary").select(F.col("segment").cast("string").alias("value"))
    packed.write.option("maxRecordsPerFile", segments_in_file).option("lineSep", "\n").text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files; their names ascend as their documents do."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read(spark: SparkSession, path: str, id_type: str = "bigint", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document of the files, with ``ids`` if asked for.

    ``start`` counts the ids of all documents before it: a prefix sum over files, then over those of a file.
    """
    schema = "path string, place bigint, id string, start bigint, n_tokens bigint, ids_crc32 bigint"
    if with_ids:
        schema += ", ids array<bigint>"
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = {c: [] for c in columns}
            for row in range(batch.num_rows):
                name, data, before = batch.column("path")[row].as_py(), batch.column("content")[row].as_buffer(), 0
                for segment in segments(memoryview(data)):
                    ids, stops = segment.read(), np.cumsum(segment.counts).tolist()
                    raw = ids.tobytes()
                    n = segment.documents
                    out["path"] += [name] * n
                    out["place"] += range(len(out["place"]), len(out["place"]) + n)
                    out["id"] += segment.names
                    first = [0, *stops][:-1]
                    out["start"] += [before + s for s in first]
                    out["n_tokens"] += segment.counts.tolist()
                    out["ids_crc32"] += [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first, stops)]
                    if with_ids:
                        out["ids"] += [ids[a:b].tolist() for a, b in zip(first, stops)]
                    before += segment.ids
            return out

        return work

    documents = map_batches(files(spark, path), schema, make)
    starts = _file_starts(spark, path)
    columns = ["n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return documents.join(starts, "path").select(
        F.col("id").cast(id_type).alias(id_col), (F.col("start") + F.col("_before")).alias("start"), *columns
    )


def _file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(path, _before): ids in the files before. Only heads of segments are read in Python."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            totals = []
            for row in range(batch.num_rows):
                data, at, total = memoryview(batch.column("content")[row].as_buffer()), 0, 0
                while at < len(data):
                    _, size, _, ids, _, _ = struct.unpack_from(HEAD, data, at)
                    at, total = at + size + 1, total + ids
                totals.append(total)
            return {"path": batch.column("path"), "ids": totals}

        return work

    totals = map_batches(files(spark, path), "path string, ids bigint", make)
    # Files are named part-<task>-<run>-c<number in the task>; the numbers may outgrow their zeros.
    numbers = [F.lpad(F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)[^/]*$", g), 12, "0") for g in (1, 2)]
    ordered = running_totals(totals.withColumn("name", F.concat(*numbers)), "name", ["ids"])
    return ordered.select("path", F.col("ids_before").alias("_before"))


def round_trip(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", by_word: bool = False,
    plain: str | None = None,
) -> DataFrame:
    """Writes the files below the shared folder and reads every document back from them."""
    spark = docs.sparkSession
    path = scratch_path(spark, "ids")
    write(docs, path, tokenizer, end_id, id_col, text_col, by_word, plain)
    return read(spark, path, dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"], id_col)
