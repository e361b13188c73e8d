"""Chat formatting with a grammar round trip, in DataFrame functions only.

Each conversation is rendered with a template, parsed again by a deterministic grammar and
compared with its source. Control strings inside a text are escaped before rendering; a
conversation whose reparse still differs is rendered again with every bracket escaped. A row that
differs even then raises an error instead of passing on a lossy text.

Defined results: null texts and null roles count as empty strings; turns are ordered by
(turn, role, text), nulls first, and repeated rows stay; an empty table gives no rows; other
columns of the input are ignored. Conversations are the unit of the result, so one conversation
is held in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The escape lead and the control strings of the template, in the order of their codes.
LEAD = "\u241b"
CONTROLS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<<ROLE ", "<</ROLE>>", "<s>", "</s>"]
#: Escaped as well when a conversation does not come back with the codes above alone.
BRACKETS = ["<", ">", "[", "]"]
#: role: (opens, closes); any other role is written in its opening mark.
TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
ROLE_OPEN, ROLE_SEP, ROLE_CLOSE = "<<ROLE ", ">>", "<</ROLE>>"
GRAMMAR = (
    "(?s)<<SYS>>.*?<</SYS>>|\\[INST\\] .*? \\[/INST\\]|<s>.*?</s>|<<ROLE .*?>>.*?<</ROLE>>"
)


def _codes(strings: list[str], first: int) -> list[tuple[str, str]]:
    return [(s, LEAD + chr(first + i)) for i, s in enumerate(strings)]


def _replace(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, brackets: bool = False) -> Column:
    """``text`` without control strings; ``unescape`` gives it back.

    The lead goes first (its code is 0); the codes hold no bracket, so no new control string
    appears when two pieces meet.
    """
    pairs = [(LEAD, LEAD + "0"), *_codes(CONTROLS, ord("1"))]
    return _replace(text, pairs + (_codes(BRACKETS, ord("a")) if brackets else []))


def unescape(text: Column) -> Column:
    pairs = [(new, old) for old, new in _codes(BRACKETS, ord("a")) + _codes(CONTROLS, ord("1"))]
    return _replace(text, [*pairs, (LEAD + "0", LEAD)])


def _marks(role: Column) -> tuple[Column, Column]:
    """The length-bearing opening and closing marks of a role."""
    opens = F.concat(F.lit(ROLE_OPEN), escape(role, True), F.lit(ROLE_SEP))
    closes = F.lit(ROLE_CLOSE)
    for name, (a, b) in TEMPLATE.items():
        opens = F.when(role == name, F.lit(a)).otherwise(opens)
        closes = F.when(role == name, F.lit(b)).otherwise(closes)
    return opens, closes


def render(turns: Column, brackets: bool = False) -> Column:
    """The formatted text of an array of (turn, role, text)."""

    def one(t: Column) -> Column:
        opens, closes = _marks(t["role"])
        return F.concat(opens, escape(t["text"], brackets), closes)

    return F.array_join(F.transform(turns, one), "")


def _segment(s: Column) -> Column:
    """(role, text, head, tail) of a segment that the grammar found; head and tail in code points."""
    named = F.substring_index(F.substr(s, F.lit(len(ROLE_OPEN) + 1)), ROLE_SEP, 1)
    role = unescape(named)
    head, tail = F.length(named) + len(ROLE_OPEN) + len(ROLE_SEP), F.lit(len(ROLE_CLOSE))
    for name, (a, b) in TEMPLATE.items():
        starts = s.startswith(F.lit(a))
        role = F.when(starts, F.lit(name)).otherwise(role)
        head = F.when(starts, F.lit(len(a))).otherwise(head)
        tail = F.when(starts, F.lit(len(b))).otherwise(tail)
    text = unescape(F.substr(s, head + 1, F.length(s) - head - tail))
    return F.struct(role.alias("role"), text.alias("text"), head.alias("head"), tail.alias("tail"), F.length(s).alias("chars"))


def parse(formatted: Column) -> Column:
    """The segments of a formatted text; null if they do not cover it without gaps."""
    found = F.regexp_extract_all(formatted, F.lit(GRAMMAR), F.lit(0))
    return F.when(F.array_join(found, "") == formatted, F.transform(found, _segment))


def _same(parsed: Column, turns: Column) -> Column:
    plain = lambda a: F.transform(a, lambda t: F.struct(t["role"], t["text"]))
    return F.coalesce(plain(parsed) == plain(turns), F.lit(False))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_spans) of the rows (conv_id, turn, role, text).

    ``turns`` are the segments parsed from ``formatted``; ``loss_spans`` are the half-open spans,
    in code points of ``formatted``, of the assistant texts.
    """
    gathered = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("source")
    )
    first = gathered.withColumn("formatted", render(F.col("source")))
    first = first.withColumn("turns", parse(F.col("formatted"))).withColumn("same", _same(F.col("turns"), F.col("source")))
    again = first.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(render(F.col("source"), True)))
    again = again.withColumn("turns", F.when(F.col("same"), F.col("turns")).otherwise(parse(F.col("formatted"))))
    again = again.withColumn(
        "turns",
        F.when(_same(F.col("turns"), F.col("source")), F.col("turns")).otherwise(
            F.raise_error(F.concat(F.lit("conversation does not come back: "), F.col("conv_id").cast("string")))
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        span = F.struct((acc["at"] + t["head"]).alias("start"), (acc["at"] + t["chars"] - t["tail"]).alias("end"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + t["chars"]).alias("at"), spans.alias("spans"))

    return again.select("conv_id", "formatted", "turns", F.aggregate("turns", start, step)["spans"].alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )
