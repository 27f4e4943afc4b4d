"""Chat formatting with schema fingerprints.

A record's fingerprint is the hash of the tree of its nested field paths, names in order and without types. It selects one
of the declarative ``MAPPINGS``, which say in SQL how that layout becomes canonical turns: rows by turn, message lists,
prompt and response, instruction with input and output. JSON records are fingerprinted one by one, so one column may mix
layouts; a typed frame has the fingerprint of its schema.

The template writes each turn as ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed. Inside texts
and roles a backslash is doubled and ``<|`` becomes ``<\\|``, in roles also line feeds are marked, so no text can hold a
control string, and undoing it gives the text back exactly. ``read_back`` parses the formatted string alone; the loss mask
is a list of (start, length) spans in code points that cover the assistant texts.

Null text or role: empty. Null turn: first. Turns with the same number are ordered by role and text. Repeated rows are
repeated turns. Rows with a null conversation id are one conversation. JSON that can't be parsed, or whose fingerprint has
no mapping, keeps its row with a null layout and null turns. Empty table: empty result. Extra columns are ignored in
frames of turns; in a record any other field makes another fingerprint.

A conversation is one value of the result, so its turns meet in one task; nothing else does.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def shape(kind: DataType) -> str:
    """The tree of field paths of a type, as one text: names in order, no types of leaves."""
    if isinstance(kind, StructType):
        inner = ((f.name, shape(f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name))
        return f"OBJECT<{', '.join(f'{n}: {s}' if s else n for n, s in inner)}>"
    if isinstance(kind, ArrayType):
        inner = shape(kind.elementType)
        return f"ARRAY<{inner}>" if inner else "ARRAY"
    return ""


def fingerprint_of(kind: DataType) -> str:
    return hashlib.sha256(shape(kind).encode()).hexdigest()


def fingerprint_json(payload: Column) -> Column:
    """The fingerprint of a JSON text; null if it can't be parsed."""
    tree = F.schema_of_variant(F.try_parse_json(payload))
    leaf = r"(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9,]+\)|BOOLEAN|VOID|VARIANT)"
    bare = F.regexp_replace(F.regexp_replace(tree, f": {leaf}(?=[,>])", ""), f"<{leaf}>", "")
    return F.sha2(bare.cast("binary"), 256)


@dataclass(frozen=True)
class Mapping:
    """A layout: the fields of a record, and in SQL the canonical turns of a record column ``{r}``."""

    name: str
    fields: str
    turns: str

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(StructType.fromDDL(self.fields))


def _pair(user: str, assistant: str) -> str:
    return f"array(named_struct('role', 'user', 'text', {user}), named_struct('role', 'assistant', 'text', {assistant}))"


MAPPINGS = (
    Mapping(
        "turn",
        "conv_id bigint, turn bigint, role string, text string",
        "array(named_struct('role', {r}.role, 'text', {r}.text))",
    ),
    Mapping(
        "messages",
        "messages array<struct<role:string,content:string>>",
        "transform({r}.messages, m -> named_struct('role', m.role, 'text', m.content))",
    ),
    Mapping(
        "conversations",
        "conversations array<struct<`from`:string,value:string>>",
        "transform({r}.conversations, m -> named_struct('role', "
        "CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END, 'text', m.value))",
    ),
    Mapping("prompt", "prompt string, response string", _pair("{r}.prompt", "{r}.response")),
    Mapping("completion", "prompt string, completion string", _pair("{r}.prompt", "{r}.completion")),
    Mapping("instruction", "instruction string, output string", _pair("{r}.instruction", "{r}.output")),
    Mapping(
        "instruction with input",
        "instruction string, input string, output string",
        _pair(
            "concat(coalesce({r}.instruction, ''), if(coalesce({r}.input, '') = '', '', concat('\\n\\n', {r}.input)))",
            "{r}.output",
        ),
    ),
    Mapping(
        "system",
        "system string, prompt string, response string",
        "concat(array(named_struct('role', 'system', 'text', {r}.system)), " + _pair("{r}.prompt", "{r}.response") + ")",
    ),
)


def turns_from_json(records: DataFrame, payload: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The records with ``fingerprint``, ``layout`` and ``turns``, for a column of JSON texts of mixed layouts."""
    marked = records.withColumn("fingerprint", fingerprint_json(F.col(payload)))
    for i, m in enumerate(mappings):
        same = F.col("fingerprint") == m.fingerprint
        marked = marked.withColumn(f"_r{i}", F.when(same, F.from_json(F.col(payload), m.fields)))
    layout = F.coalesce(*(F.when(F.col(f"_r{i}").isNotNull(), F.lit(m.name)) for i, m in enumerate(mappings)))
    turns = F.coalesce(
        *(F.when(F.col(f"_r{i}").isNotNull(), F.expr(m.turns.format(r=f"_r{i}")).cast(TURNS)) for i, m in enumerate(mappings))
    )
    return marked.withColumn("layout", layout).withColumn("turns", turns).drop(*(f"_r{i}" for i in range(len(mappings))))


def turns_from_frame(frame: DataFrame, fields: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The frame with ``turns``, by the mapping that fits the named fields; other columns are carried along."""
    found = fingerprint_of(StructType([frame.schema[f] for f in fields]))
    mapping = next((m for m in mappings if m.fingerprint == found), None)
    if mapping is None:
        raise ValueError(f"no mapping for the layout {fields}")
    record = F.struct(*fields)
    return frame.withColumn("_r", record).withColumn("turns", F.expr(mapping.turns.format(r="_r")).cast(TURNS)).drop("_r")


def canonical_rows(turns: DataFrame, id_col: str, turn_col: str | None = None) -> DataFrame:
    """(id, turn, place, role, text): one row per canonical turn."""
    place = F.lit(None).cast("bigint") if turn_col is None else F.col(turn_col).cast("bigint")
    return turns.select(
        F.col(id_col), place.alias("turn"), F.posexplode("turns").alias("place", "m")
    ).select(id_col, "turn", "place", F.coalesce("m.role", F.lit("")).alias("role"), F.coalesce("m.text", F.lit("")).alias("text"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def format_rows(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, formatted, loss_spans) of each conversation."""
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    body = escape(F.col("text"))
    order = Window.partitionBy(id_col).orderBy("turn", "place", "role", "text")
    parts = rows.select(
        id_col, "turn", "place", "role", "text", head.alias("head"), body.alias("body")
    ).withColumn("part", F.concat("head", "body", F.lit(END + "\n")))
    placed = parts.select(
        id_col,
        F.row_number().over(order).alias("at"),
        F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.length("head").alias("head"),
        F.length("body").alias("body"),
        (F.col("role") == LEARNT).alias("learnt"),
        "part",
    )
    span = F.struct(
        (F.coalesce("before", F.lit(0)) + F.col("head")).cast("bigint").alias("start"), F.col("body").cast("bigint").alias("length")
    )
    held = placed.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", "part", "learnt", span.alias("span")))).alias("all"))
    return held.select(
        id_col,
        F.array_join(F.col("all.part"), "").alias("formatted"),
        F.transform(F.filter("all", lambda t: t["learnt"]), lambda t: t["span"]).alias("loss_spans"),
    )


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Adds ``turns`` and ``loss_text``, parsed from ``formatted`` and ``loss_spans`` alone."""

    def turn(piece: Column) -> Column:
        whole = F.substring(piece, F.lit(1), F.length(piece) - len(END) - 1)
        role = F.regexp_extract(whole, r"(?s)^((?:[^\\\n]++|\\.)*+)\n", 1)
        return F.struct(
            unescape(role).alias("role"), unescape(F.substr(whole, F.length(role) + 2, F.length(whole))).alias("text")
        )

    pieces = F.split("formatted", r"<\|im_start\|>")
    learnt = F.transform(
        "loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    )
    return formatted.withColumn("turns", F.transform(F.slice(pieces, 2, F.size(pieces)), turn)).withColumn(
        "loss_text", F.array_join(learnt, "")
    )


def digests(read: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what was read back."""
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        id_col,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(every.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
