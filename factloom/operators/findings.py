"""The findings pipeline (survey F2 to F7, F24 to F27, W1, W2, W5, W6, J22, J23, J27, U3).

A finding is a row (file, start_line, start_char, end_line, end_char, rule_seq, emit_seq, code, severity,
topic, rule, confidence, message, ...); rule_seq and emit_seq give the order in which rules report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators import tiles

RANGE = ["start_line", "start_char", "end_line", "end_char"]
ORDER = ["rule_seq", "emit_seq"]
PHASES = ("syntax", "structure", "semantic", "security", "artifact")


def pattern_scan(lines: DataFrame, patterns: list[dict]) -> DataFrame:
    """Findings of lines (file, line, text) for patterns (code, regex, topic, confidence, severity).

    Every pattern is a column of one pass over the lines, not a join. The first match of a line counts; an empty one is none.
    """
    hits = []
    lines = lines.select("file", "line", "text", *[F.regexp_extract("text", p["regex"], 0).alias(f"_m{seq}") for seq, p in enumerate(patterns)])
    for seq, p in enumerate(patterns):
        match = F.col(f"_m{seq}")
        start = F.instr("text", match) - 1
        hits.append(
            F.when(
                match != "",
                F.struct(
                    F.lit(seq).alias("rule_seq"),
                    start.alias("start_char"),
                    (start + F.length(match)).alias("end_char"),
                    *[F.lit(p[k]).alias(k) for k in ("code", "topic", "confidence", "severity")],
                ),
            )
        )
    found = lines.select("file", "line", F.explode(F.array_compact(F.array(*hits))).alias("_"))
    return found.select("file", F.col("line").alias("start_line"), "_.start_char", F.col("line").alias("end_line"), "_.end_char", "_.rule_seq", F.lit(0).alias("emit_seq"), "_.code", "_.topic", "_.confidence", "_.severity")


def collect_findings(rules: list[DataFrame]) -> DataFrame:
    """The union of rule outputs, numbered in registry order."""
    out = None
    for seq, rule in enumerate(rules):
        rule = rule.withColumn("rule_seq", F.lit(seq))
        out = rule if out is None else out.unionByName(rule, allowMissingColumns=True)
    return out


def applicable_rules(rules: DataFrame, framework: str, max_phase: str) -> DataFrame:
    """the rules (id, phase ordinal, frameworks array) of a framework up to a phase."""
    return rules.filter(F.array_contains("frameworks", framework) & (F.col("phase") <= PHASES.index(max_phase)))


def level_of(c: Column) -> Column:
    """off, warn, error or hint of a configured text; null for others."""
    return F.when(c.isin("off", "disabled", "false"), "off").when(c.isin("warn", "warning", "true"), "warn").when(c == "error", "error").when(c == "hint", "hint")


def switched_off(settings: dict[str, bool], classes: dict[str, Column]) -> Column:
    """whether a finding belongs to a class whose setting is off; a class without a setting is on."""
    out = F.lit(False)
    for name, member in classes.items():
        if not settings.get(name, True):
            out = out | F.coalesce(member, F.lit(False))
    return out


def apply_settings(findings: DataFrame, off_codes: Column, levels: DataFrame | None = None) -> DataFrame:
    """without the findings whose code a setting switches off; levels (config_key, level) rewrite severities.

    Findings without a code are never touched. off_codes: a condition on ``code`` and other columns.
    """
    coded = F.col("code").isNotNull()
    kept = findings.filter(~(coded & F.coalesce(off_codes, F.lit(False))))
    if levels is None:
        return kept
    names = levels.select(F.col("config_key").alias("_key"), level_of(F.col("level")).alias("_level"))
    joined = kept.join(names, coded & (F.col("config_key") == F.col("_key")), "left")
    joined = joined.filter(F.col("_level").isNull() | (F.col("_level") != "off"))
    spelled = F.when(F.col("_level") == "warn", "warning").otherwise(F.col("_level"))
    return joined.withColumn("severity", F.coalesce(spelled, "severity")).drop("_key", "_level")


def default_severity(provability: Column) -> Column:
    """the highest severity that a kind's provability allows."""
    return F.when(provability == "proven", "error").when(provability == "likely", "warning").otherwise("hint")


def severity_violations(findings: DataFrame) -> DataFrame:
    """findings above the ceiling of their ``provability``."""
    rank = lambda c: F.when(c == "error", 3).when(c == "warning", 2).when(c == "information", 1).otherwise(0)
    return findings.filter(rank(F.col("severity")) > rank(default_severity(F.col("provability"))))


def confidence_rank(c: Column) -> Column:
    return F.when(c.isin("authoritative", "high"), 3).when(c.isin("derived", "medium"), 2).when(c.isin("heuristic", "low"), 1).otherwise(0)


def arbitrate(findings: DataFrame) -> DataFrame:
    """Of findings with one file, range and topic the one of highest confidence stays, ties to the first;
    the others become its ``related`` (code: message texts in order), counted in ``demoted``. Null topics pass."""
    key = ["file", *RANGE, "topic"]
    place = F.row_number().over(W.partitionBy(*key).orderBy(confidence_rank(F.col("confidence")).desc(), *ORDER))
    message = F.coalesce(F.concat_ws(": ", "code", "message"), F.lit(""))
    lost = F.collect_list(F.when(F.col("_place") > 1, message)).over(W.partitionBy(*key).orderBy("_place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    topical = findings.filter("topic is not null").withColumn("_place", place).withColumn("related", F.array_distinct(lost))
    topical = topical.withColumn("demoted", F.size("related")).filter("_place = 1").drop("_place")
    rest = findings.filter("topic is null").withColumns({"related": F.expr("cast(array() as array<string>)"), "demoted": F.lit(0)})
    return topical.unionByName(rest)


def dedupe(findings: DataFrame) -> DataFrame:
    """The first of findings with one file, range, code and message."""
    key = [F.col("file"), *map(F.col, RANGE), F.coalesce("code", F.lit("")), F.col("message")]
    return findings.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*ORDER))).filter("_n = 1").drop("_n")


def in_header(lines: DataFrame, is_header: Column) -> DataFrame:
    """Lines (file, line, text) with ``leading``: all lines before are header lines."""
    before = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return lines.withColumn("leading", F.coalesce(F.min(is_header.cast("int")).over(before), F.lit(1)) == 1)


def extract_directives(lines: DataFrame, allow: str, allow_file: str, ignore: str, ignore_file: str, comment: Column, is_header: Column) -> DataFrame:
    """(file, line, pattern) of the directives in comment lines; line is null for a whole file.

    A line directive covers its own and the next line; an ignore directive is the pattern ``*``; a file
    is ignored only from its leading header.
    """
    rows = in_header(lines, is_header).filter(comment)
    text = F.col("text")
    after = lambda m: F.filter(F.split(F.substr(text, F.instr(text, m) + len(m)), "[^/.\\-_A-Za-z0-9]+"), lambda x: x != "")
    star, none = F.array(F.lit("*")), F.expr("cast(array() as array<string>)")
    has = lambda m: text.contains(m)
    whole = F.concat(F.when(has(allow_file), after(allow_file)).otherwise(none), F.when(has(ignore_file) & F.col("leading"), star).otherwise(none))
    single = F.concat(F.when(has(allow), after(allow)).otherwise(none), F.when(has(ignore) & ~has(ignore_file), star).otherwise(none))
    files = rows.select("file", F.lit(None).cast("int").alias("line"), F.explode(whole).alias("pattern"))
    own = rows.select("file", "line", F.explode(single).alias("pattern"))
    own = own.select("file", F.explode(F.array(F.col("line"), F.col("line") + 1)).alias("line"), "pattern")
    return files.unionByName(own.select("file", F.col("line").cast("int"), "pattern")).distinct()


def _suffixes(c: Column, separator: str) -> Column:
    parts = F.split(c, "\\" + separator if separator == "." else separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), separator))


def patterns_of() -> Column:
    """All patterns that would suppress a finding: topic and its dotted suffixes, rule and its path suffixes, code, code.rule, ``*``."""
    none = F.expr("cast(array() as array<string>)")
    code_rule = F.when(F.col("code").isNotNull() & F.col("rule").isNotNull(), F.concat_ws(".", "code", "rule"))
    return F.array_distinct(
        F.array_compact(F.concat(F.coalesce(_suffixes(F.col("topic"), "."), none), F.coalesce(_suffixes(F.col("rule"), "/"), none), F.array("code", code_rule, F.lit("*"))))
    )


def suppress(findings: DataFrame, directives: DataFrame, ranges: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """The findings that no directive matches.

    directives (file, line or null, pattern); ranges (file, start, end, pattern), both ends included, in packed positions
    ``line * 2^20 + char``; files (file): suppressed as a whole. Patterns are expanded so that the match is an equi
    join. A suppressed finding does not bring back one that it demoted.
    """
    patterns = lambda rows, *k: rows.groupBy(*k).agg(F.collect_set("pattern").alias("_q"))
    whole = patterns(directives.filter("line is null"), "file").select(F.col("file").alias("_f0"), F.col("_q").alias("_q0"))
    single = patterns(directives.filter("line is not null"), "file", "line").select(F.col("file").alias("_f1"), F.col("line").alias("_l1"), F.col("_q").alias("_q1"))
    # a document's directives become one row, so findings are read once and joined on equality
    rows = findings.withColumn("_p", patterns_of())
    rows = rows.join(whole, F.col("file") == F.col("_f0"), "left")
    rows = rows.join(single, (F.col("file") == F.col("_f1")) & (F.col("start_line") == F.col("_l1")), "left")
    meets = lambda q: F.coalesce(F.arrays_overlap("_p", q), F.lit(False))
    hit = meets("_q0") | meets("_q1")
    if ranges is not None:
        # a position's patterns come from the ranges whose tiles are around it
        own = ranges.select(F.col("file").alias("_f2"), "start", (F.col("end") + 1).alias("end"), "pattern")
        own = tiles.tiled(own).select("_f2", "_level", "_tile", "pattern").distinct()
        rows = rows.withColumn("_at", packed("start_line", "start_char"))
        places = tiles.around(rows.select("file", "_at").distinct(), F.col("_at"), tiles.levels_of(own))
        places = places.join(own, (F.col("file") == F.col("_f2")) & tiles.meet())
        found = places.groupBy(F.col("file").alias("_f3"), F.col("_at").alias("_at3")).agg(F.collect_set("pattern").alias("_q2"))
        rows = rows.join(found, (F.col("file") == F.col("_f3")) & (F.col("_at") == F.col("_at3")), "left")
        hit = hit | meets("_q2")
    out = rows.filter(~hit).select(*findings.columns)
    return out if files is None else out.join(files.select("file"), "file", "left_anti")


def packed(line: str, char: str) -> Column:
    return F.col(line).cast("long") * (1 << 20) + F.col(char)


def in_range(points: DataFrame, spans: DataFrame, key: str = "file") -> DataFrame:
    """Points (key, at) inside half-open spans (key, start, end), as rows of both.

    A span is the two or three tiles about as wide as itself that it touches. A point that shares one is compared, but where a
    tile is the edge of very many spans, they and its points meet on the dyadic tiles below it, which need no comparison.
    """
    s = tiles.covered(spans.withColumnRenamed(key, "_k"))
    levels = tiles.levels_of(spans.filter("start < end").select(tiles.level_of(F.col("start"), F.col("end")).alias("_level")))
    p = tiles.around(points, F.col("at"), levels)
    edge = (F.col("start") > F.expr("shiftleft(_tile, _level)")) | (F.col("end") < F.expr("shiftleft(_tile + 1, _level)"))
    cell = ["_k", "_level", "_tile"]
    crowded = F.broadcast(s.filter(edge).groupBy(*cell).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > tiles.CROWDED).select(*cell))
    dense = s.filter(edge).join(crowded, cell, "left_semi")
    s = s.join(crowded.withColumn("_edge", F.lit(True)), cell, "left").filter(F.col("_edge").isNull() | ~edge).drop("_edge")
    # the side that is many times its file's size must not be broadcast by that size
    same = (F.col(key) == F.col("_k")) & tiles.meet()
    found = p.join(s.hint("merge"), same & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    near = p.join(crowded, same, "left_semi")
    low, high = F.greatest("start", F.expr("shiftleft(_tile, _level)")), F.least("end", F.expr("shiftleft(_tile + 1, _level)"))
    fine = tiles.tiled(dense.withColumns({"_low": low, "_high": high}).withColumnsRenamed({"_level": "_at_level", "_tile": "_at_tile"}), "_low", "_high").drop("_low", "_high")
    near = tiles.around(near.withColumnsRenamed({"_point_level": "_near_level", "_point_tile": "_near_tile"}), F.col("at"), list(range(max(levels, default=-1) + 1)))
    within = same & (F.col("_near_level") == F.col("_at_level")) & (F.col("_near_tile") == F.col("_at_tile"))
    below = near.join(fine.hint("merge"), within).drop("_at_level", "_at_tile", "_near_level", "_near_tile")
    return found.unionByName(below).drop("_k", "_level", "_tile", "_point_level", "_point_tile")


def touch(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two closed ranges meet."""
    return (a_start <= b_end) & (b_start <= a_end)


def filter_by_region(findings: DataFrame, regions: DataFrame, scope: list[str], confidence: str, applicability: str, topic: str) -> DataFrame:
    """findings whose start lies in a region of ``scope``: the shortest half-open span (file, start, end, region) around it, or ``other``.
    Of equally short ones the first region counts.

    confidence, applicability and topic are filled in where they are absent.
    """
    rows = findings.withColumn("_at", packed("start_line", "start_char"))
    size = F.struct((F.col("end") - F.col("start")).alias("size"), "region")
    # the shortest span of each tile, then of the tiles around a position
    best = tiles.tiled(regions).groupBy(F.col("file").alias("_f"), "_level", "_tile").agg(F.min(size).alias("_best"))
    places = tiles.around(rows.select("file", "_at").distinct(), F.col("_at"), tiles.levels_of(tiles.tiled(regions)))
    places = places.join(best.hint("merge"), (F.col("file") == F.col("_f")) & tiles.meet())
    shortest = places.groupBy("file", "_at").agg(F.min("_best").alias("_best"))
    named = rows.join(shortest, ["file", "_at"], "left").filter(F.coalesce("_best.region", F.lit("other")).isin(*scope)).select(*findings.columns)
    fill = {"confidence": confidence, "applicability": applicability, "topic": topic}
    return named.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in findings.columns else F.lit(v) for c, v in fill.items()})


def enrich(findings: DataFrame, kinds: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Findings joined to kinds (kind, provability, docs_url, confidence, topic) and error names by kind."""
    k = kinds.select("kind", *[F.col(c).alias(f"_{c}") for c in kinds.columns if c != "kind"])
    out = findings.join(k, "kind", "left")
    for c in (c for c in kinds.columns if c != "kind"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_{c}")) if c in findings.columns else F.col(f"_{c}")).drop(f"_{c}")
    if errors is not None:
        names = errors.groupBy("kind").agg(F.sort_array(F.collect_set("name")).alias("errors"))
        out = out.join(names, "kind", "left")
    return out


def unpinned_links(lines: DataFrame) -> DataFrame:
    """lines that cite a file on a moving branch."""
    return lines.filter(F.col("text").rlike("https?://[^\\s)]+/(blob|tree)/(main|master|develop|HEAD)/"))


def oversized_sources(files: DataFrame, generated: list[str], most: int = 800) -> DataFrame:
    """(file, lines) of files over ``most`` lines outside generated roots."""
    rows = files.withColumn("lines", F.size(F.split("text", "\n"))).filter(F.col("lines") > most)
    for root in generated:
        rows = rows.filter(~F.col("file").startswith(root))
    return rows.select("file", "lines")


def unsafe_paths(entries: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """archive entries that are absolute, climb up or lie outside ``prefix``."""
    p = F.col(path)
    return entries.filter(p.startswith("/") | p.rlike("(^|/)\\.\\.(/|$)") | ~p.startswith(prefix))
