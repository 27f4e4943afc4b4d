"""Conversation structure repair by Four-Russians block tables.

A conversation's roles should read ``(s?(ua)+)?`` by their initials: at most one system turn in front, then user and assistant
in turn. Rows are faulty if blank (no character but white space), duplicate (role and text seen earlier) or truncated (the
last character is none of ``. ! ?``), the first that holds. Edits of a row: Keep 0, Rerole to user or assistant 3, Delete 4
(the only one for blank and duplicate rows); undeleted truncated rows cost 3 more; an empty user or assistant turn may be
Inserted anywhere for 3. Wanted are the cheapest edits, ties by the least string of their initials.

Method. The costs to go from the four states of the pattern (nothing yet, after s, u, a) form a vector; less its minimum it
is one of a few dozen, because any state reaches any later one by two inserts. A table holds, for each normalised vector
after a block of ``BLOCK`` row symbols and each such block, the vector before it and the cost added. A conversation is
walked from its end by one lookup per block. For the trace the blocks are expanded backward, from the vector stored behind
each, and read forward: in a state the least edit that keeps to the cost to go is taken. The edit fixes the next state, so
that this gives the least string.

Spark's part. Equal rows of a conversation are counted, not kept (their copies can only be duplicates); the first turn of a
role and text comes from an aggregate and a join on a digest. Rows are range-sorted, and a conversation's symbols, one
character a row, are put together from chunks of at most ``CHUNK`` rows. Edits go back to rows by their number, so texts
are never gathered: a conversation may be spread over many tasks. Only the audit string and the symbols of one
conversation, each one value, are in one place; the digest of a conversation is taken over its sorted rows as a stream.

Order: by turn (nulls first), then role, then text; equal rows are neighbours. Null roles and texts count as one space. A
role whose first letter is none of s, u, a (the empty one too) can't be kept. Null ids form one conversation. Repeated rows
are duplicates of the first. A conversation without rows: no edits, cost 0. Extra columns are ignored. Empty table: empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathline.llm.common import map_batches
from swathline.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 4
CHUNK_BITS = 12  # a chunk holds at most 2 ** 12 rows
SPACES = " \t\n\x0b\x0c\r"
#: States: nothing yet, after s, after u, after a. Ends are allowed before anything and after a.
STATES, ENDS = range(4), (0, 3)
#: What a state turns into by an initial.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: Symbols: initial and whether truncated, or a row that must go.
INITIALS = "suax"
SYMBOLS = [(initial, cut) for initial in INITIALS for cut in (False, True)] + [None]
#: Faults as they stand in a row's character: initial * 4 + fault.
SOUND, BLANK, DUPLICATE, CUT = range(4)


def _inserted(state: int) -> int:
    """The state after an insert: the only turn that may follow in it."""
    return 3 if state == 2 else 2


def _options(state: int, symbol) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) for one row."""
    found = [("D", DELETE, state)]
    if symbol is not None:
        initial, cut = symbol
        extra = TRUNCATED if cut else 0
        if (state, initial) in NEXT:
            found.append(("K", KEEP + extra, NEXT[state, initial]))
        found.append(("R", REROLE + extra, _inserted(state)))
    return found


def _with_inserts(costs: list[int]) -> list[int]:
    costs = list(costs)
    for _ in STATES:
        costs = [min(c, INSERT + costs[_inserted(s)]) for s, c in enumerate(costs)]
    return costs


class Tables:
    """Vectors, steps by symbol, block transitions and the edits of each state and step."""

    def __init__(self, block: int = BLOCK):
        far = 1 << 20
        end = tuple(_with_inserts([0 if s in ENDS else far for s in STATES]))
        self.block, self.vectors, number = block, [end], {end: 0}
        self.base = min(end)
        assert self.base == 0
        step, cost, at = [], [], 0
        while at < len(self.vectors):
            vector, row, added = self.vectors[at], [], []
            for symbol in SYMBOLS:
                plain = [min(c + vector[t] for _, c, t in _options(s, symbol)) for s in STATES]
                costs = _with_inserts(plain)
                low = min(costs)
                key = tuple(c - low for c in costs)
                if key not in number:
                    number[key] = len(self.vectors)
                    self.vectors.append(key)
                row.append(number[key])
                added.append(low)
            step.append(row)
            cost.append(added)
            at += 1
        self.step, self.cost = np.array(step), np.array(cost)
        # Blocks by composition: the last symbol of a block is met first.
        self.after, self.added = self.step, self.cost
        for _ in range(block - 1):
            n = self.after.shape[1]
            self.added = (self.added[:, None, :] + self.cost[self.after].transpose(0, 2, 1)).reshape(len(self.step), -1)
            self.after = self.step[self.after].transpose(0, 2, 1).reshape(len(self.step), -1)
            assert self.after.shape[1] == n * len(SYMBOLS)
        self.edits = {}

    def trace(self, state: int, symbol: int, vector: int) -> tuple[str, int]:
        """The least edits up to and with the one of this row, and the state after, given the vector behind the row."""
        key = state, symbol, vector
        if key not in self.edits:
            behind, done = self.vectors[vector], ""
            plain = [min(c + behind[t] for _, c, t in _options(s, SYMBOLS[symbol])) for s in STATES]
            costs = _with_inserts(plain)
            while True:
                fitting = [(e, t, True) for e, c, t in _options(state, SYMBOLS[symbol]) if c + behind[t] == costs[state]]
                if INSERT + costs[_inserted(state)] == costs[state]:
                    fitting.append(("I", _inserted(state), False))
                edit, state, final = min(fitting)
                done += edit
                if final:
                    break
            self.edits[key] = done, state
        return self.edits[key]

    def solve(self, symbols: np.ndarray) -> tuple[int, list[str]]:
        """(cost, edits by row), with those behind the last row as one more entry."""
        n, width = len(symbols), len(SYMBOLS)
        whole = n // self.block * self.block
        powers = width ** np.arange(self.block - 1, -1, -1)
        codes = (symbols[:whole].reshape(-1, self.block) @ powers).tolist()
        vector, cost, tail = 0, 0, []
        for symbol in symbols[whole:][::-1].tolist():
            tail.append(vector)
            vector, cost = int(self.step[vector, symbol]), cost + int(self.cost[vector, symbol])
        behind = []
        for code in reversed(codes):
            behind.append(vector)
            vector, cost = int(self.after[vector, code]), cost + int(self.added[vector, code])
        cost += self.vectors[vector][0]
        state, edits = 0, []
        for at, last in zip(range(0, whole, self.block), reversed(behind)):
            inside, vectors = symbols[at : at + self.block].tolist(), [last]
            for symbol in reversed(inside[1:]):
                vectors.append(int(self.step[vectors[-1], symbol]))
            for symbol, vector in zip(inside, reversed(vectors)):
                edit, state = self.trace(state, symbol, vector)
                edits.append(edit)
        for symbol, vector in zip(symbols[whole:].tolist(), reversed(tail)):
            edit, state = self.trace(state, symbol, vector)
            edits.append(edit)
        end = ""
        while state not in ENDS:
            end, state = end + "I", _inserted(state)
        return cost, edits + [end]


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def rows_to_symbols(marks: np.ndarray) -> np.ndarray:
    """Symbols from (initial * 4 + fault) marks."""
    initial, fault = marks // 4, marks % 4
    return np.where((fault == BLANK) | (fault == DUPLICATE), len(SYMBOLS) - 1, 2 * initial + (fault == CUT))


#: By (initial, next initial): su, ua and au are the pairs that may stand.
_LEGAL = np.zeros((4, 4), bool)
for _pair in ("su", "ua", "au"):
    _LEGAL[INITIALS.index(_pair[0]), INITIALS.index(_pair[1])] = True


# Rows


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def _distinct_rows(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n, mark): equal rows once with their number; ``mark`` is initial * 4 + fault of the first."""
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    # The first turn of a role and text; an aggregate is combined before its exchange however hot a conversation is.
    first = rows.groupBy("conv", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("later"), "turn")).alias("first")
    )
    first = first.select(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    same = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    seen = ~F.col("first.turn").eqNullSafe(F.col("turn"))
    said = _trimmed(F.col("text"))
    fault = (
        F.when(said == "", BLANK)
        .when(seen, DUPLICATE)
        .when(~F.right(said, F.lit(1)).isin(".", "!", "?"), CUT)
        .otherwise(SOUND)
    )
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    return rows.join(first, same).select(
        "conv", "turn", "role", "text", "n", (initial * 4 + fault).cast("int").alias("mark")
    )


def _characters(mark: Column, n: Column) -> Column:
    """A row's marks as characters: copies after the first are duplicates, or blank if it is."""
    base = ord("A")
    more = mark - mark % 4 + F.when(mark % 4 == BLANK, BLANK).otherwise(DUPLICATE)
    return F.concat(F.char(mark + base), F.repeat(F.char(more + base), (n - 1).cast("int")))


def _solve(chunks: DataFrame, conv_type: str) -> DataFrame:
    """Per conversation counts, cost, audit and the edits of each distinct row."""
    schema = (
        f"conv {conv_type}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
        "seq array<bigint>, edits array<string>"
    )

    def make():
        table = tables()

        def work(batch: pa.RecordBatch) -> dict:
            out = {c: [] for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "seq", "edits")}
            for row in range(batch.num_rows):
                chunks = batch.column("chunks")[row].as_py()
                marks = np.frombuffer("".join(c["marks"] for c in chunks).encode(), np.uint8) - ord("A")
                initial, fault = marks // 4, marks % 4
                cost, edits = table.solve(rows_to_symbols(marks.astype(np.int64)))
                seqs = [s for c in chunks for s in c["seqs"]]
                copies = [n for c in chunks for n in c["copies"]]
                by_row, at = [], 0
                for n in copies:
                    by_row.append("".join(edits[at : at + n]))
                    at += n
                by_row[-1] += edits[-1]
                values = (
                    int((fault == BLANK).sum()), int((fault == DUPLICATE).sum()), int((fault == CUT).sum()),
                    int((~_LEGAL[initial[:-1], initial[1:]]).sum()), cost, "".join(edits), seqs, by_row,
                )
                for column, value in zip(out.values(), values):
                    column.append(value)
            return out | {"conv": batch.column("conv")}

        return work

    return map_batches(chunks, schema, make)


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    count_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired). Reports, one per conversation that has rows: id, gaps, blank, duplicate, truncated, illegal, cost,
    audit. Repaired: (id, seq, place, role, text), in the order of (seq, place).

    ``count_col``: how often a row stands there.
    """
    count = F.col(count_col).cast("bigint") if count_col else F.lit(1).cast("bigint")
    given = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), count.alias("n"),
    )
    conv_type = dict(given.dtypes)["conv"]
    distinct = cut_lineage(_distinct_rows(given))
    order = ["conv", "turn", "role", "text"]
    ordered = cut_lineage(
        distinct.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    )
    row = F.struct("seq", "n", _characters(F.col("mark"), F.col("n")).alias("marks"))
    chunks = ordered.groupBy("conv", F.shiftright("seq", CHUNK_BITS).alias("chunk")).agg(
        F.sort_array(F.collect_list(row)).alias("rows")
    )
    chunk = F.struct(
        "chunk", F.col("rows.seq").alias("seqs"), F.col("rows.n").alias("copies"),
        F.array_join("rows.marks", "").alias("marks"),
    )
    whole = chunks.groupBy("conv").agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))
    solved = cut_lineage(_solve(whole, conv_type))

    turns = ordered.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps")
    )
    turns = turns.select(F.col("conv").alias("_c"), "gaps")
    reports = solved.join(turns, F.col("conv").eqNullSafe(F.col("_c"))).select(
        F.col("conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )
    edits = solved.select(F.explode(F.arrays_zip("seq", "edits")).alias("e")).select("e.seq", "e.edits")
    return reports, _apply(ordered.join(edits, "seq"), conv_col)


def _apply(rows: DataFrame, conv_col: str) -> DataFrame:
    """The repaired rows of a conversation, each with its number.

    Whatever is put out alternates between user and assistant, so a row's turn follows from how many were put out before;
    counts are summed by chunk first, then inside chunks.
    """
    stays = F.length(F.regexp_replace("edits", "D", ""))
    # A kept system turn is the first of all and doesn't take part in the alternation.
    system = (F.substring("role", 1, 1) == "s") & F.col("edits").contains("K")
    rows = rows.withColumn("system", system.cast("int")).withColumn("put", (stays - F.col("system")).cast("bigint"))
    rows = rows.withColumn("chunk", F.shiftright("seq", CHUNK_BITS))
    sums = rows.groupBy("conv", "chunk").agg(F.sum("put").alias("_put"))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv").alias("_c"), F.col("chunk").alias("_k"), F.coalesce(F.sum("_put").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("conv", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k"))
    numbered = rows.join(sums, same).withColumn("start", F.col("_before") + F.coalesce(F.sum("put").over(inside), F.lit(0)))
    letters = F.split(F.regexp_replace("edits", "D", ""), "")
    stayed = numbered.filter(F.col("edits").rlike("[IKR]")).select(
        F.col("conv").alias(conv_col), "seq", "role", "text", (F.col("start") - F.col("system")).alias("start"),
        F.posexplode(F.filter(letters, lambda e: e != "")).alias("place", "edit"),
    )
    due = F.when((F.col("start") + F.col("place")) % 2 == 0, "user").otherwise("assistant")
    return stayed.select(
        conv_col, "seq", "place",
        F.when(F.col("edit") == "K", F.col("role")).otherwise(due).alias("role"),
        F.when(F.col("edit") == "I", F.lit("")).otherwise(F.col("text")).alias("text"),
    )


def digests(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(id, repaired_sha256) of ``role:text`` lines, joined by a newline, hashed as a sorted stream."""
    kind = dict(repaired.dtypes)[conv_col]
    line = F.concat("role", F.lit(":"), "text").cast("binary").alias("line")
    lines = repaired.select(F.col(conv_col).alias("conv"), "seq", "place", line)
    lines = lines.repartition("conv").sortWithinPartitions("conv", "seq", "place").select("conv", "line")
    schema = pa.schema([("conv", _arrow(lines, "conv")), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, names, sums = None, None, [], []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(names, schema.field(0).type), pa.array(sums, pa.string())], schema=schema)
            names.clear()
            sums.clear()
            return out

        for batch in batches:
            lines = batch.column("line")
            for i, name in enumerate(batch.column("conv").to_pylist()):
                if digest is None or name != conv:
                    if digest is not None:
                        names.append(conv)
                        sums.append(digest.hexdigest())
                    conv, digest = name, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(lines[i].as_py())
            yield flush()
        if digest is not None:
            names.append(conv)
            sums.append(digest.hexdigest())
            yield flush()

    return lines.mapInArrow(run, f"conv {kind}, repaired_sha256 string").withColumnRenamed("conv", conv_col)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def damage(rows: DataFrame) -> DataFrame:
    """Test damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``. ! ?``, 3 repeats it
    (``copies`` is 2), 4 makes its role user. Nulls count as one space there and in role and text.
    """
    def filled(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(filled("text"), "[.!?]", ""))
    return (
        rows.select("conv_id", "turn", "role", "text")
        .withColumn("_kind", kind)
        .filter(F.col("_kind") != 0)
        .select(
            "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(filled("role")).alias("role"),
            text.otherwise(filled("text")).alias("text"), F.when(F.col("_kind") == 3, 2).otherwise(1).alias("copies"),
        )
    )


def repaired_reports(rows: DataFrame, all_rows: DataFrame) -> DataFrame:
    """A report for every conversation of ``all_rows``, of its rows in ``rows`` (with ``copies``)."""
    reports, repaired = repair(rows, count_col="copies")
    sums = digests(repaired).select(F.col("conv_id").alias("_d"), "repaired_sha256")
    names = all_rows.select(F.col("conv_id").alias("_c")).distinct()
    out = names.join(reports, F.col("_c").eqNullSafe(F.col("conv_id")), "left")
    out = out.join(sums, F.col("_c").eqNullSafe(F.col("_d")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        F.col("_c").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
