"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items, grouped by their number of words. For each group a shift table is
keyed by blocks of two words: a block that ends no later than ``j`` words before the end of a window may not be passed
by more than ``j`` words, any other block allows a jump over the whole window. Where a shift is zero, the block is also the
key of a suffix bucket of candidate windows, which are compared directly.

The windows of the benchmark travel to the tasks in blocks of at most ``block_windows`` windows, a bounded size; a larger
benchmark takes one pass over the documents for each block, and the spans of a document's passes are united.

Null or empty text: no words, not contaminated. Items without words have no window. Null or repeated item ids are
allowed; an item that is there twice counts once. Documents that come twice are reported twice (rows are told apart by
nothing but their position, so nothing is joined when the benchmark fits one block). Extra columns are ignored, and kept by
``drop_contaminated`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import as_bytes, map_batches
from swathline.session import cut_lineage

WINDOW = 10
BLOCK_WINDOWS = 200_000
REPORT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
#: A-Z to a-z; every byte that is neither a digit, a letter nor part of a character beyond ASCII to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Searcher:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int, windows: dict[tuple, tuple]):
        self.length, self.width = length, min(2, length)
        self.jump = length - self.width + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for window, items in windows.items():
            for end in range(self.width, length + 1):
                key = window[end - 1] if self.width == 1 else (window[end - 2], window[end - 1])
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.buckets.setdefault(key, {})[window] = items

    def find(self, text: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """(start, items) of every occurrence."""
        length, jump, shift = self.length, self.jump, self.shift.get
        at, last = length - 1, len(text)
        if self.width == 1:
            for at in range(last):
                if (found := self.buckets.get(text[at])) and (items := found.get((text[at],))):
                    yield at, items
            return
        while at < last:
            key = (text[at - 1], text[at])
            step = shift(key, jump)
            if step == 0:
                items = self.buckets[key].get(tuple(text[at - length + 1 : at + 1]))
                if items:
                    yield at - length + 1, items
                step = 1
            at += step


def windows_of(item: bytes | None, window: int = WINDOW) -> list[tuple]:
    """The windows of one item; an item of fewer words is one window."""
    text = words(item)
    if not text:
        return []
    size = min(window, len(text))
    return [tuple(text[i : i + size]) for i in range(len(text) - size + 1)]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block: int) -> Iterator[list[Searcher]]:
    """Searchers for at most ``block`` windows (and one item more) at a time; items are read one by one."""
    gathered: dict[int, dict[tuple, set]] = {}
    held = 0

    def built() -> list[Searcher]:
        return [Searcher(k, {w: tuple(sorted(i)) for w, i in g.items()}) for k, g in sorted(gathered.items())]

    rows = benchmark.select(F.col(id_col).cast("string"), as_bytes(text_col)).toLocalIterator()
    for item, text in rows:
        for w in windows_of(bytes(text) if text is not None else None, window):
            group = gathered.setdefault(len(w), {})
            if w not in group:
                held += 1
            group.setdefault(w, set()).add(item if item is not None else "")
        if held >= block:
            yield built()
            gathered, held = {}, 0
    if gathered:
        yield built()


def _united(spans: list[tuple[int, int]]) -> int:
    total, reached = 0, 0
    for start, stop in sorted(spans):
        total += max(0, stop - max(start, reached))
        reached = max(reached, stop)
    return total


def _report(n_words: list, spans: list, items: list) -> pa.Array:
    """A struct of ``REPORT`` for each document."""
    hits = [_united(s) for s in spans]
    return pa.StructArray.from_arrays(
        [
            pa.array(n_words, pa.int64()),
            pa.array(hits, pa.int64()),
            pa.array([len(i) for i in items], pa.int64()),
            pa.array([hashlib.sha256(b",".join(sorted(x.encode() for x in i))).hexdigest() for i in items], pa.string()),
            pa.array([h > 0 for h in hits], pa.bool_()),
        ],
        names=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def _reported(
    docs: DataFrame, benchmark: DataFrame, window: int, block_windows: int, text_col: str, item_col: str,
    item_text_col: str, carried: list[str],
) -> DataFrame:
    """(held, report): the carried columns of each document as one struct, and what was found in its text as another.

    Only texts go to the Python tasks and only reports come back.
    """
    spark = docs.sparkSession
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_windows)
    first, second = next(blocks, []), next(blocks, None)
    held = F.struct(*carried).alias("held")

    def scan(searchers) -> Callable[[pa.Array], tuple]:
        handle = spark.sparkContext.broadcast(searchers)

        def search(texts: pa.Array) -> tuple:
            counts, spans, items = [], [], []
            for text in texts:
                text = words(text.as_py())
                own, named = [], set()
                for searcher in handle.value:
                    for start, found in searcher.find(text):
                        own.append((start, start + searcher.length))
                        named.update(found)
                counts.append(len(text))
                spans.append(own)
                items.append(named)
            return counts, spans, items

        return search

    if second is None:
        search = scan(first)

        def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield _report(*search(texts))

        return docs.select(held, F.arrow_udf(whole, REPORT)(as_bytes(text_col)).alias("report"))

    # Several blocks: documents get a number that stays, each block reports the documents it hits, and these are united.
    apart = [] if text_col in carried else [as_bytes(text_col).alias("body")]
    numbered = cut_lineage(docs.select(held, *apart, F.monotonically_increasing_id().alias("row")))
    body = F.col("body") if apart else as_bytes(F.col("held")[text_col])

    def pending():
        yield first
        yield second
        yield from blocks

    def hits_of(searchers) -> DataFrame:
        search = scan(searchers)

        def make():
            def work(batch: pa.RecordBatch) -> dict:
                _, spans, items = search(batch.column("body"))
                hit = [i for i, s in enumerate(spans) if s]
                return {
                    "row": batch.column("row").take(pa.array(hit, pa.int64())),
                    "starts": [[a for a, _ in spans[i]] for i in hit],
                    "stops": [[b for _, b in spans[i]] for i in hit],
                    "items": [sorted(items[i]) for i in hit],
                }

            return work

        part = "row bigint, starts array<bigint>, stops array<bigint>, items array<string>"
        return cut_lineage(map_batches(numbered.select("row", body.alias("body")), part, make))

    union = None
    for searchers in pending():
        found = hits_of(searchers)
        union = found if union is None else union.unionByName(found)
    merged = union.groupBy("row").agg(
        *(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "stops")),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )

    def united(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, starts, stops, items in batches:
            spans = [list(zip(a or (), b or ())) for a, b in zip(starts.to_pylist(), stops.to_pylist())]
            yield _report([len(words(t.as_py())) for t in texts], spans, [i or () for i in items.to_pylist()])

    report = F.arrow_udf(united, REPORT)(body, F.col("starts"), F.col("stops"), F.col("items"))
    return numbered.join(merged, "row", "left").select("held", report.alias("report"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated), one row per document.

    ``keep``: columns of the documents to carry along unchanged instead of the id alone.
    """
    found = _reported(docs, benchmark, window, block_windows, text_col, item_col, item_text_col, keep or [id_col])
    return found.select("held.*", "report.*")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The documents without any occurrence, their columns unchanged whatever their names."""
    found = _reported(docs, benchmark, window, block_windows, text_col, item_col, item_text_col, docs.columns)
    return found.filter(~F.col("report")["contaminated"]).select("held.*")
