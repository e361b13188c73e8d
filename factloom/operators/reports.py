"""Reports (survey A4, A5, A21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged_usages(local: DataFrame, reachable: DataFrame, keys: list[str]) -> DataFrame:
    """A4: (keys, account, mutable) of local usages (any mutable one wins) and of names reached only through calls (not mutable)."""
    more = reachable.select(*keys, "account").withColumn("mutable", F.lit(False))
    return local.select(*keys, "account", "mutable").unionByName(more).groupBy(*keys, "account").agg(F.bool_or("mutable").alias("mutable"))


def instruction_report(usages: DataFrame, calls: DataFrame, keys: list[str], reasons: list[tuple[str, Column]]) -> DataFrame:
    """A4: one row for each of ``keys``: distinct usages by kind, distinct calls and review reasons, all sorted."""
    kinds = ("account", "cpi_program", "signer_use", "signer_check")
    per_kind = [F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("account")))).alias(k) for k in kinds]
    own = usages.groupBy(*keys).agg(*per_kind)
    called = calls.groupBy(*keys).agg(F.sort_array(F.collect_set("callee")).alias("calls"))
    out = own.join(called, keys, "full")
    empty = F.expr("cast(array() as array<string>)")
    out = out.withColumns({c: F.coalesce(c, empty) for c in (*kinds, "calls")})
    return out.withColumn("review", F.array_compact(F.array(*[F.when(c, name) for name, c in reasons])))


def context_report(contexts: DataFrame, fields: DataFrame, functions: DataFrame) -> DataFrame:
    """A5: (name, n_fields, used_by) of contexts; used_by is sorted."""
    n = fields.groupBy(F.col("container").alias("name")).agg(F.count(F.lit(1)).alias("n_fields"))
    used = functions.groupBy(F.col("context").alias("name")).agg(F.sort_array(F.collect_set(functions["name"])).alias("used_by"))
    out = contexts.select("name").distinct().join(n, "name", "left").join(used, "name", "left")
    return out.select("name", F.coalesce("n_fields", F.lit(0)).alias("n_fields"), F.coalesce("used_by", F.expr("cast(array() as array<string>)")).alias("used_by"))


def focused_report(usages: DataFrame, fields: DataFrame, findings: DataFrame, container: str) -> DataFrame:
    """(account, declared_type, mutable, findings) of one context: its usages with their declarations and finding codes."""
    u = usages.filter(F.col("container") == container).groupBy("account").agg(F.bool_or("mutable").alias("mutable"))
    f = fields.filter(F.col("container") == container).select(F.col("name").alias("account"), F.col("type_name").alias("declared_type"))
    d = findings.filter(F.col("container") == container).groupBy("account").agg(F.sort_array(F.collect_set("code")).alias("findings"))
    return u.join(f, "account", "left").join(d, "account", "left")
