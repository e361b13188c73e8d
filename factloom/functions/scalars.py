"""Column helpers (survey C1 to C14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_nanos(c: Column) -> Column:
    """Nanoseconds of a text such as ``12.3 ms``; null if it is none."""
    pattern = "^([0-9]+(?:\\.[0-9]+)?)\\s*(ns|µs|us|ms|s)$"
    text = F.trim(c)
    unit = F.regexp_extract(text, pattern, 2)
    factor = F.when(unit == "ns", 1).when(unit.isin("us", "µs"), 1_000).when(unit == "ms", 1_000_000).when(unit == "s", 1_000_000_000)
    amount = F.regexp_extract(text, pattern, 1)
    return F.when(factor.isNotNull(), F.floor(amount.try_cast("double") * factor + 0.5).cast("long"))


def pascal_case(c: Column) -> Column:
    """``snake_case`` to ``SnakeCase``; letters after the first stay as they are."""
    parts = F.filter(F.split(c, "_"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")


def strip_underscores(c: Column) -> Column:
    """Without leading underscores."""
    return F.regexp_replace(c, "^_+", "")


_SIMPLE_ESCAPES = {"n": 10, "r": 13, "t": 9, "0": 0, "\\": 92, "'": 39, '"': 34}


def byte_literal(c: Column) -> Column:
    """C4: the bytes of a literal ``b"..."`` or ``b'.'`` as upper-case hex; null for anything else.

    Escapes are ``\\n \\r \\t \\0 \\\\ \\' \\"`` and ``\\xNN``; an unknown escape makes the literal opaque.
    """
    quoted = F.regexp_extract(F.trim(c), "(?s)^b\"((?:[^\"\\\\]|\\\\.)*)\"$|^b'((?:[^'\\\\]|\\\\.))'$", 0)
    body = F.substr(quoted, F.lit(3), F.length(quoted) - 3)
    parts = F.regexp_extract_all(body, F.lit("(?s)\\\\x[0-9A-Fa-f]{2}|\\\\.|[^\\\\]"), F.lit(0))

    def one(p: Column) -> Column:
        escaped = F.when(p.rlike("^\\\\x[0-9A-Fa-f]{2}$"), F.upper(F.substr(p, F.lit(3))))
        for mark, code in _SIMPLE_ESCAPES.items():
            escaped = escaped.when(p == "\\" + mark, F.lit(f"{code:02X}"))
        return F.when(p.startswith("\\"), escaped).otherwise(F.hex(p.cast("binary")))

    out = F.transform(parts, one)
    return F.when((quoted != "") & ~F.exists(out, lambda x: x.isNull()), F.array_join(out, ""))


def literal_prefix(c: Column) -> Column:
    """The joined hex of an array of byte literals up to the first that is opaque."""
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        known = byte_literal(x)
        more = acc["open"] & known.isNotNull()
        return F.struct(F.when(more, F.concat(acc["text"], known)).otherwise(acc["text"]).alias("text"), more.alias("open"))

    return F.aggregate(c, start, step)["text"]


def topic_slug(c: Column, root: str) -> Column:
    """The document name of a topic below ``root/``; null for others."""
    rest = F.regexp_replace(F.substr(c, F.lit(len(root) + 2)), "[./]", "-")
    return F.when(c.startswith(root + "/"), F.concat(F.lit(root + "-"), rest))


def topic_url(c: Column, root: str, base: str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), topic_slug(c, root), F.lit(".md"))


def sarif_level(c: Column) -> Column:
    """Severity to SARIF level."""
    s = F.lower(c)
    return F.when(s == "error", "error").when(s.isin("information", "hint"), "note").otherwise("warning")


def normal_name(c: Column) -> Column:
    """Trimmed, without double quotes around it, ``-`` as ``_``."""
    return F.replace(F.regexp_replace(F.trim(c), '^"+|"+$', ""), F.lit("-"), F.lit("_"))


def is_base58_key(c: Column) -> Column:
    """32 to 44 characters of the base58 alphabet."""
    return c.rlike("^[1-9A-HJ-NP-Za-km-z]{32,44}$")


def elapsed_days(a: Column, b: Column) -> Column:
    """Whole days from ISO time ``a`` to ``b``; null if either is none."""
    seconds = F.unix_seconds(F.try_to_timestamp(b)) - F.unix_seconds(F.try_to_timestamp(a))
    return F.floor(seconds / 86400).cast("long")


def elapsed_hours(a: Column, b: Column) -> Column:
    seconds = F.unix_seconds(F.try_to_timestamp(b)) - F.unix_seconds(F.try_to_timestamp(a))
    return seconds / 3600


def is_proof_url(c: Column, host: str, parts: int = 2) -> Column:
    """C11: an https URL of ``host`` with at least so many path parts."""
    return c.rlike(f"^https://{host.replace('.', chr(92) + '.')}(/[A-Za-z0-9._-]+){{{parts},}}/?(#.*)?$")


def primary_type(c: Column) -> Column:
    """The last path part of the outermost type name."""
    return F.element_at(F.split(F.regexp_extract(F.trim(c), "^&?(?:mut )?([A-Za-z_0-9:]+)", 1), "::"), -1)


def word_hits(text: Column, word: str) -> Column:
    """C14: (line, start_char) of a word with identifier boundaries, both from 0, as an array."""
    def in_line(line: Column, number: Column) -> Column:
        pieces = F.split(line, f"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])", -1)
        places = F.sequence(F.lit(1), F.size(pieces) - 1)
        hits = F.when(F.size(pieces) > 1, F.transform(places, lambda i: F.struct(
            number.alias("line"),
            (F.length(F.array_join(F.slice(pieces, 1, i), "")) + (i - 1) * len(word)).alias("start_char"),
        ))).otherwise(F.expr("cast(array() as array<struct<line:int,start_char:int>>)"))
        return hits

    return F.flatten(F.transform(F.split(text, "\n"), in_line))
