"""Drift between two states of a set (survey U1, U2, U4 to U8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_drift(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, drift): missing where only expected, stale where only actual."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(True))
    a = actual.select(key).distinct().withColumn("_a", F.lit(True))
    drift = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "stale")
    return e.join(a, key, "full").select(key, drift.alias("drift")).filter("drift is not null")


def lock_drift(expected: DataFrame, actual: DataFrame, keys: list[str], digest: str = "sha256") -> DataFrame:
    """(keys, drift), the first of unexpected, missing, malformed and mismatch."""
    e = expected.select(*keys, F.col(digest).alias("_e"), F.lit(True).alias("_in_e"))
    a = actual.select(*keys, F.col(digest).alias("_a"), F.lit(True).alias("_in_a"))
    drift = (
        F.when(F.col("_in_e").isNull(), "unexpected")
        .when(F.col("_in_a").isNull(), "missing")
        .when(~F.coalesce(F.col("_e").rlike("^[0-9a-f]{64}$"), F.lit(False)), "malformed")
        .when(F.col("_e") != F.col("_a"), "mismatch")
    )
    return e.join(a, keys, "full").select(*keys, drift.alias("drift")).filter("drift is not null")


def bridge_symbols(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """U4: the union of symbol tables with the first source of each key."""
    out = None
    for i, s in enumerate(sources):
        s = s.select(*key, "origin").withColumn("_i", F.lit(i))
        out = s if out is None else out.unionByName(s)
    return out.groupBy(*key).agg(F.min_by("origin", "_i").alias("origin"))


def parity(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, absent array) of keys that some but not all sets hold."""
    out = None
    for name, s in sets.items():
        s = s.select(key, F.lit(name).alias("_s")).distinct()
        out = s if out is None else out.unionByName(s)
    every = F.array(*map(F.lit, sets))
    absent = F.sort_array(F.array_except(every, F.collect_set("_s")))
    return out.groupBy(key).agg(absent.alias("absent")).filter(F.size("absent") > 0)


def merge_evidence(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Base rows with the patch's values where it has them, and the patch's new rows."""
    p = patch.select(key, *[F.col(c).alias(f"_{c}") for c in patch.columns if c != key])
    out = base.join(p, key, "full")
    return out.select(key, *[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in p.columns else F.col(c) for c in base.columns if c != key])


def coverage_gaps(groups: DataFrame, present: DataFrame, keys: list[str], first: str, last: str, number: str) -> DataFrame:
    """(keys, number) of the numbers from ``first`` to ``last`` of each group that ``present`` lacks."""
    want = groups.filter(F.col(last) >= F.col(first)).select(*keys, F.explode(F.sequence(first, last)).alias(number))
    return want.join(present.select(*keys, number).distinct(), [*keys, number], "left_anti")


def sync_plan(source: DataFrame, target: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """U8: (path, action) of a copy: new, unchanged or conflict."""
    t = target.select(path, F.col(digest).alias("_t"))
    action = F.when(F.col("_t").isNull(), "new").when(F.col("_t") == F.col(digest), "unchanged").otherwise("conflict")
    return source.join(t, path, "left").select(path, action.alias("action"))
