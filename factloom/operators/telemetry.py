"""Budgets, percentiles, gates and roll-ups (survey A8, A9, A13 to A16, A18 to A20, A22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, keys: list[str], value: str, p: float, buckets: int = 4096) -> DataFrame:
    """(keys, n, value) of the nearest-rank percentile: the sorted value number ceil(p n), at least the first. Nulls take no part.

    Equal values are counted first; the counts of a key's buckets (equal parts of its range) tell which bucket holds the
    rank, and only that bucket's values are ordered. So no task sees all values of a key.
    """
    key = F.struct(*keys).alias("_k")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).select(key, F.col(value).alias("_v"), "_c")
    spans = counts.groupBy("_k").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("n"))
    as_double = lambda c: F.col(c).cast("double")
    part = F.when(F.col("_hi") > F.col("_lo"), F.floor((as_double("_v") - as_double("_lo")) / (as_double("_hi") - as_double("_lo")) * buckets)).otherwise(0)
    placed = counts.join(spans, "_k").select("_k", "_v", "_c", "n", part.alias("_b"))
    want = F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1))
    upto = lambda *k: F.sum("_c").over(W.partitionBy("_k").orderBy(*k).rowsBetween(W.unboundedPreceding, 0))
    held = placed.groupBy("_k", "_b", "n").agg(F.sum("_c").alias("_c")).withColumn("_upto", upto("_b"))
    held = held.filter((F.col("_upto") >= want) & (F.col("_upto") - F.col("_c") < want)).select("_k", "_b", (F.col("_upto") - F.col("_c")).alias("_before"))
    inside = placed.join(held, ["_k", "_b"]).withColumn("_upto", F.col("_before") + upto("_v"))
    found = inside.filter(F.col("_upto") >= want).groupBy("_k").agg(F.first("n").alias("n"), F.min("_v").alias(value))
    return found.select("_k.*", "n", value)


def budget_check(measures: DataFrame, budgets: DataFrame) -> DataFrame:
    """Budgets (name, budget) with the status of measures (name, n, value): missing (none or no call), exceeded or ok."""
    status = F.when(F.col("value").isNull() | (F.coalesce("n", F.lit(0)) == 0), "missing").when(F.col("value") > F.col("budget"), "exceeded").otherwise("ok")
    return budgets.join(measures, "name", "left").select("name", "budget", "n", "value", status.alias("status"))


def rollup_totals(df: DataFrame, levels: list[str], measures: dict[str, Column]) -> DataFrame:
    """A3: measures at every level of a hierarchy in one pass; a null level is a total."""
    return df.rollup(*levels).agg(*[c.alias(n) for n, c in measures.items()])


def static_totals(findings: DataFrame, corpus: str, counters: dict[str, Column]) -> DataFrame:
    """A3: (corpus, findings, counters..., files) of each corpus and, with a null corpus, of all; files are counted once."""
    counts = [F.count_if(c).alias(n) for n, c in counters.items()]
    each = findings.groupBy(corpus, "file").agg(F.count(F.lit(1)).alias("findings"), *counts)
    sums = [F.sum(c).alias(c) for c in ("findings", *counters)]
    return each.rollup(corpus).agg(*sums, F.count(F.lit(1)).alias("files"))


def coverage_summary(df: DataFrame, one: str, other: str) -> DataFrame:
    """Counts by each of two columns and in all, by grouping sets."""
    df = df.withColumns({"_one": F.col(one), "_other": F.col(other)})
    return df.groupingSets([[F.col("_one")], [F.col("_other")], []], F.col("_one"), F.col("_other")).agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("_one").alias(one), F.col("_other").alias(other), "n")


def catalog_summary(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of each family by value, as columns; the values are given, so there is one pass."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def fuzz_rollup(runs: DataFrame, tolerance: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(hours) in all and (target, failure) of runs (target, status, shards, seconds_per_shard, fuzz_hours)."""
    hours = F.col("shards") * F.col("seconds_per_shard") / 3600
    checks = [F.when(F.col("status") != "passed", "status"), F.when(F.abs(hours - F.col("fuzz_hours")) > tolerance, "hours"), F.when(F.col("shards") <= 0, "shards")]
    failures = runs.select("target", F.explode(F.array_compact(F.array(*checks))).alias("failure"))
    return runs.agg(F.round(F.sum(hours), 2).alias("hours")), failures


def consistency(parts: DataFrame, totals: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys, declared, computed) where a declared total differs from the sum of its parts by more than the tolerance."""
    return totals.join(parts, keys).filter(F.abs(F.col("declared") - F.col("computed")) > tolerance).select(*keys, "declared", "computed")


def corpus_gate(findings: DataFrame, exclusions: list[str], program: str = "corpus") -> DataFrame:
    """(program, errors, passed): no ERROR finding outside excluded path prefixes."""
    rows = findings
    for prefix in exclusions:
        rows = rows.filter(~F.col("file").startswith(prefix))
    errors = rows.groupBy(program).agg(F.count_if(F.col("severity") == "error").alias("errors"))
    return errors.withColumn("passed", F.col("errors") == 0)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unsorted(df: DataFrame, scope: list[str], ordinal: str, name: str) -> DataFrame:
    """Rows whose name is less than that of the row before."""
    before = F.lag(name).over(W.partitionBy(*scope).orderBy(ordinal))
    return df.withColumn("previous", before).filter(F.col("previous") > F.col(name))


def tree_digest(files: DataFrame, keys: list[str], path: str, content: Column) -> DataFrame:
    """(keys, digest): a tree of digests. A leaf is the SHA-256 of the sorted lines ``path|sha256`` of the paths whose
    SHA-256 begins with the same two bytes; a branch that of its sorted ``leaf:digest`` lines, by the first byte; the root of its branches.

    65,536 leaves and branches of at most 256 lines keep a large tree out of one group.
    """
    lines = files.select(*keys, F.substring(F.sha2(F.col(path).cast("string"), 256), 1, 4).alias("_s"), F.concat_ws("|", F.col(path).cast("string"), F.sha2(content, 256)).alias("_l"))
    joined = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), "\n"), 256)
    for width in (2, 0):
        level = lines.groupBy(*keys, "_s").agg(joined("_l").alias("_d"))
        lines = level.select(*keys, F.substring("_s", 1, width).alias("_s"), F.concat_ws(":", "_s", "_d").alias("_l"))
    return lines.groupBy(*keys).agg(joined("_l").alias("digest"))


def source_coverage(rows: DataFrame, sources: DataFrame, path: str = "path") -> DataFrame:
    """(path) of sources that no row covers; a row's path covers itself or, ending in ``/*``, all paths below it.

    A source's folders are exploded, so the match is on equality.
    """
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i - 1), "/"), F.when(i > 1, "/").otherwise(""), F.lit("*")))
    asked = sources.select(path).distinct()
    wide = asked.withColumn("_p", F.explode(F.concat(F.array(path), folders)))
    covered = wide.join(rows.select(F.col(path).alias("_p")).distinct(), "_p", "left_semi").select(path).distinct()
    return asked.join(covered, path, "left_anti")


def audit_failures(rows: DataFrame, sources: DataFrame, key: str, text: str, vague: str) -> DataFrame:
    """(key, failure): sources without a row (uncovered), rows without a source (unknown), rows with a vague text."""
    uncovered = sources.select(key).distinct().join(rows.select(key).distinct(), key, "left_anti").withColumn("failure", F.lit("uncovered"))
    unknown = rows.select(key).distinct().join(sources.select(key).distinct(), key, "left_anti").withColumn("failure", F.lit("unknown"))
    bad = rows.filter(F.coalesce(F.col(text), F.lit("")).rlike(vague)).select(key).distinct().withColumn("failure", F.lit("vague"))
    return uncovered.unionByName(unknown).unionByName(bad)


def review_checks(reviews: DataFrame, signoffs: DataFrame, roles: list[str], days: int = 30) -> DataFrame:
    """(review, failure) of reviews (review, started timestamp, ended timestamp, declared_days) and signoffs (review, role)."""
    signed = signoffs.groupBy("review").agg(F.collect_set("role").alias("_roles"))
    span = F.floor((F.unix_seconds("ended") - F.unix_seconds("started")) / 86400)
    rows = reviews.join(signed, "review", "left").withColumn("_d", span)
    want = F.array(*map(F.lit, roles)) if roles else F.expr("cast(array() as array<string>)")
    checks = [
        F.when(F.col("_d").isNull(), "timestamp").when(F.col("_d") < 0, "order").when(F.col("_d") < days, "window"),
        F.when(F.col("_d") != F.col("declared_days"), "declared"),
        F.when(F.size(F.array_except(want, F.coalesce("_roles", F.expr("cast(array() as array<string>)")))) > 0, "signoff"),
    ]
    return rows.select("review", F.explode(F.array_compact(F.array(*checks))).alias("failure"))
