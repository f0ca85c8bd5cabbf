"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A layout of chat data (prompt and completion, instruction records, message
lists, rows of turns) is known by its nested field paths.  Their canonical
form is hashed; the hash is the layout's fingerprint and selects its mapping, a
declaration of which path holds which role's text.  Only paths that a layout
names are hashed, so fields beside them don't matter.  Typed tables are
recognised by their schema, JSON records one by one by the schema of their
own value, so a table may mix layouts.  ``format_chats`` takes any of them.

Turns are written as ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line
break.  Inside roles and texts every ``<`` before backslashes and ``|`` gets one
more backslash, so no control string can appear there, and reading takes it away
again.  DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"
BLOCK_TURNS = 256
_TURN = "struct<role: string, text: string>"


@dataclass(frozen=True)
class Layout:
    """``ddl`` gives the fields.  ``turns`` lists (role, field) in order, or ``items`` names a list of (role field,
    text field) records, or ``rows`` names (conversation, turn, role, text) of a table with a row for each turn;
    ``optional`` fields are left out where empty."""

    name: str
    ddl: str
    turns: tuple = ()
    items: tuple = ()
    rows: tuple = ()
    optional: tuple = ()


# Field names and role names of common layouts.
LAYOUTS = [
    Layout("turn_rows", "conv_id long, turn long, role string, text string",
           rows=("conv_id", "turn", "role", "text")),
    Layout("messages", "messages array<struct<role: string, content: string>>", items=("messages", "role", "content")),
    Layout("share", "conversations array<struct<from: string, value: string>>", items=("conversations", "from", "value")),
    Layout("prompt", "prompt string, completion string", turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", "instruction string, input string, output string",
           turns=(("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Layout("instruction_only", "instruction string, output string",
           turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("system_prompt", "system string, prompt string, response string",
           turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("question", "question string, answer string", turns=(("user", "question"), ("assistant", "answer"))),
]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def nested_paths(kind: T.DataType) -> str:
    """The canonical form of a schema's nested field paths, as ``schema_of_variant`` writes it."""
    if isinstance(kind, T.StructType):
        fields = sorted((f.name, nested_paths(f.dataType)) for f in kind.fields)
        return "OBJECT<" + ", ".join(f"{n}: {p}" for n, p in fields) + ">"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{nested_paths(kind.elementType)}>"
    return kind.simpleString().upper()


def fingerprint_of(paths: str) -> int:
    """Equal to ``xxhash64(paths)`` in Spark."""
    h = xxhash.xxh64_intdigest(paths.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def layout_fingerprints() -> dict[int, Layout]:
    return {fingerprint_of(nested_paths(T._parse_datatype_string(x.ddl))): x for x in LAYOUTS}


def by_size() -> list[tuple[int, Layout]]:
    """(fingerprint, layout), most fields first: a record that several layouts fit is of the first."""
    return sorted(layout_fingerprints().items(), key=lambda x: -len(T._parse_datatype_string(x[1].ddl).fields))


def _named(kind: T.DataType, own: T.DataType) -> T.DataType:
    """``own`` without the fields that ``kind`` doesn't name."""
    if isinstance(kind, T.StructType) and isinstance(own, T.StructType):
        return T.StructType([T.StructField(f.name, _named(kind[f.name].dataType, f.dataType)) for f in own.fields if f.name in kind.names])
    if isinstance(kind, T.ArrayType) and isinstance(own, T.ArrayType):
        return T.ArrayType(_named(kind.elementType, own.elementType))
    return own


def recognise(schema: T.StructType) -> Layout | None:
    """The layout whose fingerprint the schema's paths have; fields that it doesn't name are passed over."""
    for mark, layout in by_size():
        if fingerprint_of(nested_paths(_named(T._parse_datatype_string(layout.ddl), schema))) == mark:
            return layout
    return None


def _role(role: Column) -> Column:
    """Role names in one spelling; others stay as they are, null is empty."""
    named = F.coalesce(role, F.lit(""))
    for alias, name in ROLES.items():
        named = F.when(named == alias, F.lit(name)).otherwise(named)
    return named


def turns_of(layout: Layout, record: Column) -> Column:
    """array<struct<role, text>> of a record of that layout; null texts are empty, null lists have no turns."""
    if layout.items:
        items, role, text = layout.items
        return F.coalesce(F.transform(record[items], lambda m: F.struct(
            _role(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))), F.array().cast(f"array<{_TURN}>"))
    said = [(r, F.coalesce(record[f], F.lit("")), f in layout.optional) for r, f in layout.turns]
    turn = lambda r, t: F.array(F.struct(F.lit(r).alias("role"), t.alias("text")))
    return F.concat(*[F.when(t != "", turn(r, t)).otherwise(F.array().cast(f"array<{_TURN}>")) if skip else turn(r, t) for r, t, skip in said])


def _variant_paths(value: Column, kind: T.DataType) -> Column:
    """The canonical form of those paths of a JSON value that ``kind`` names; null where the value is absent.

    A null stands for the text it could be; a list has the paths that its items share, the named ones if it is empty.
    """
    if isinstance(kind, T.StructType):
        own = [(f.name, _variant_paths(F.try_variant_get(value, f"$.{f.name}", "variant"), f.dataType))
               for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.concat(F.lit("OBJECT<"), F.array_join(F.array(*[F.concat(F.lit(n + ": "), p) for n, p in own]), ", "), F.lit(">"))
    if isinstance(kind, T.ArrayType):
        items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: _variant_paths(v, kind.elementType))
        items = F.concat(F.lit("ARRAY<"), F.array_join(F.array_distinct(items), " | ", ""), F.lit(">"))
        return F.when(items == "ARRAY<>", F.lit(nested_paths(T.ArrayType(kind.elementType)))).otherwise(items)
    return F.regexp_replace(F.schema_of_variant(value), "VOID", "STRING")


def json_turns(records: DataFrame, column: str) -> DataFrame:
    """``records`` with ``layout`` (null where no layout has the record's fingerprint) and ``turns`` (null there).

    Text that isn't JSON has no layout.  A field that is null counts as a string, an empty list of messages has no
    turns, fields that a layout doesn't name are passed over, and a record that several layouts fit is of
    the one with most fields.
    """
    parsed = F.try_parse_json(F.col(f"`{column}`"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{_TURN}>")
    for mark, layout in reversed(by_size()):
        if not layout.rows:
            fits = F.xxhash64(_variant_paths(parsed, T._parse_datatype_string(layout.ddl))) == F.lit(mark)
            name = F.when(fits, F.lit(layout.name)).otherwise(name)
            turns = F.when(fits, turns_of(layout, F.from_json(F.col(f"`{column}`"), layout.ddl))).otherwise(turns)
    return records.select("*", name.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def turn_segments(role: Column, text: Column) -> Column:
    """array<struct<piece, loss>>: the turn's head, its escaped text (under the loss mask if the assistant's), its end."""
    seg = lambda piece, loss: F.struct(piece.alias("piece"), loss.alias("loss"))
    off = F.lit(False)
    return F.array(seg(F.concat(F.lit(START), escape(role), F.lit(SEP)), off),
                   seg(escape(text), role == LEARNED_ROLE), seg(F.lit(END), off))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["piece"]), "")


def format_chats(chats: DataFrame, id_col: str = "conv_id", json_col: str | None = None) -> DataFrame:
    """(conv_id, n_rows, segments) of chats in any known layout, as their fingerprint selects the mapping.

    With ``json_col`` that column holds JSON records; one that has no known layout keeps its row, with null segments.
    Otherwise the table's own schema is recognised; a ValueError if no layout has its fingerprint.  Layouts of
    one record for each conversation give a row for each record, repeats included, and role names in one spelling.
    A table with a row for each turn is grouped, its role names stay as they are.
    """
    if json_col is not None:
        return _format_records(json_turns(chats.select(F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{json_col}`").alias("record")), "record"))
    layout = recognise(chats.schema)
    if layout is None:
        raise ValueError(f"no mapping for the fields of {chats.schema.simpleString()}")
    if layout.rows:
        return _format_rows(chats, layout)
    record = F.struct(*[F.col(f"`{f}`") for f in T._parse_datatype_string(layout.ddl).names])
    found = chats.select(F.col(f"`{id_col}`").alias("conv_id"), record.alias("record"))
    return _format_records(found.select("conv_id", turns_of(layout, F.col("record")).alias("turns")))


def _format_records(records: DataFrame) -> DataFrame:
    segments = F.flatten(F.transform("turns", lambda t: turn_segments(t["role"], t["text"])))
    return records.select("conv_id", F.size("turns").cast("long").alias("n_rows"), segments.alias("segments"))


def _format_rows(chats: DataFrame, layout: Layout) -> DataFrame:
    """Turns in order of (turn, role, text).

    A conversation comes together in two steps, blocks of ``BLOCK_TURNS`` turn numbers first, so its
    many rows don't meet in one task before they are few and long.  Rows that repeat are turns of their
    own.  A null conv_id is a conversation; null turns come first; null roles and texts
    are empty.
    """
    conv, turn, role, text = (F.col(f"`{c}`") for c in layout.rows)
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    turns = chats.select(conv.alias("conv_id"), F.floor(turn / BLOCK_TURNS).alias("block"),
                         F.struct(turn.alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    blocks = turns.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    blocks = blocks.select("conv_id", F.struct("block", F.size("ts").cast("long").alias("n"), F.flatten(
        F.transform("ts", lambda t: turn_segments(t["role"], t["text"]))).alias("segments")).alias("b"))
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    return whole.select("conv_id", F.aggregate("bs", F.lit(0).cast("long"), lambda acc, b: acc + b["n"]).alias("n_rows"),
                        F.flatten(F.transform("bs", lambda b: b["segments"])).alias("segments"))


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> parsed from a formatted string."""
    quoted = lambda s: "\\Q" + s + "\\E"
    parts = F.split(text, quoted(END))
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))  # behind the last end stands nothing

    def turn(part: Column) -> Column:
        both = F.split(F.substring(part, len(START) + 1, 2**31 - 1), quoted(SEP), 2)
        return F.struct(unescape(both[0]).alias("role"), unescape(both[1]).alias("text"))

    return F.transform(parts, turn)


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all from formatted text and mask."""
    chats = chats.select("conv_id", formatted(F.col("segments")).alias("formatted"), F.array_join(F.transform(
        F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["piece"])), "").alias("learned"))
    chats = chats.select("conv_id", "formatted", "learned", read_turns(F.col("formatted")).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                        F.char_length("formatted").cast("long").alias("formatted_chars"))
