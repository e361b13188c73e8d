"""Ordered scans and guards over body events (survey W3, A10 to A12, J11 to J15).

body_events: (keys..., seq, event, subject): what happens, in order, in one function body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sequence_violation(events: DataFrame, keys: list[str], order: list[str], trigger: Column, clear: Column, read: Column, subject: list[str] | None = None) -> DataFrame:
    """The first read after a trigger in its body, with no clear of the subject so far; one row a subject, at the first trigger.

    Columns: keys, subject, first_trigger and first_read (values of ``order[0]``).
    """
    subject = subject or []
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy(*keys, *subject).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    seen = events.withColumns(
        {
            "_t": F.min(F.when(trigger, F.col(order[0]))).over(before),
            "_c": F.coalesce(F.max(clear.cast("int")).over(own), F.lit(0)),
        }
    )
    stale = seen.filter(read & F.col("_t").isNotNull() & (F.col("_c") == 0))
    return stale.groupBy(*keys, *subject).agg(F.min("_t").alias("first_trigger"), F.min(order[0]).alias("first_read"))


def close_rule(events: DataFrame, keys: list[str], order: Column, mutation: Column, action: Column, sentinel: Column) -> DataFrame:
    """A10: bodies with a mutation and a close action but no sentinel, with where each came first."""
    agg = events.groupBy(*keys).agg(
        F.min(F.when(mutation, order)).alias("first_mutation"),
        F.min(F.when(action, order)).alias("first_action"),
        F.coalesce(F.bool_or(sentinel), F.lit(False)).alias("_s"),
    )
    return agg.filter("first_mutation is not null and first_action is not null and not _s").drop("_s")


def first_unvalidated(events: DataFrame, keys: list[str], order: Column, access: Column, validation: Column) -> DataFrame:
    """The first access of a body without any validation."""
    agg = events.groupBy(*keys).agg(F.min(F.when(access, order)).alias("first_access"), F.coalesce(F.bool_or(validation), F.lit(False)).alias("_v"))
    return agg.filter("first_access is not null and not _v").drop("_v")


def mixed_groups(rows: DataFrame, keys: list[str], one: Column, other: Column) -> DataFrame:
    """Groups that hold both kinds, with the count of each."""
    agg = rows.groupBy(*keys).agg(F.count_if(one).alias("n_one"), F.count_if(other).alias("n_other"))
    return agg.filter("n_one > 0 and n_other > 0")


def unguarded(events: DataFrame, keys: list[str], use: Column, guard: Column, off: Column | None = None, by: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Uses without a guard of the same subject (each column of ``by`` in turn counts) in the same body; a body with an ``off`` event is silent."""
    out = events.filter(use)
    guards = events.filter(guard)
    for c in by:
        out = out.join(guards.select(*keys, c).distinct(), [*keys, c], "left_anti")
    return out if off is None else out.join(events.filter(off).select(*keys).distinct(), keys, "left_anti")


def unchecked_use(uses: DataFrame, checks: DataFrame, fields: DataFrame, types: list[str], guards: list[str], workspace_uses: DataFrame | None = None) -> DataFrame:
    """(context, account) of unchecked fields that are used in reach without a constraint or a check in reach.

    uses and checks (context, account, truncated): a truncated search may defend (a check counts) but never
    accuse (a use does not). workspace_uses serve contexts for which ``uses`` has no row.
    """
    found = uses.filter("not truncated").select("context", "account")
    if workspace_uses is not None:
        rest = workspace_uses.join(uses.select("context").distinct(), "context", "left_anti").filter("not truncated")
        found = found.unionByName(rest.select("context", "account"))
    open_ = fields.filter(F.col("type_name").isin(*types) & ~F.exists("keys", lambda k: k.isin(*guards)))
    open_ = open_.select(F.col("container").alias("context"), F.col("name").alias("account"))
    return open_.join(found.distinct(), ["context", "account"], "left_semi").join(checks.select("context", "account").distinct(), ["context", "account"], "left_anti")


def unvalidated_program(uses: DataFrame, comparisons: DataFrame, fields: DataFrame, types: list[str], guards: list[str], truncated_contexts: DataFrame) -> DataFrame:
    """Unchecked programs called in reach, with no comparison to a static id on either side; a truncated search is taken as checked."""
    left = comparisons.filter("right_kind = 'static'").select("context", F.col("left").alias("account"))
    right = comparisons.filter("left_kind = 'static'").select("context", F.col("right").alias("account"))
    checks = left.unionByName(right).withColumn("truncated", F.lit(False))
    out = unchecked_use(uses, checks, fields, types, guards)
    return out.join(truncated_contexts.select("context").distinct(), "context", "left_anti")


def unchecked_program(fields: DataFrame, usages: DataFrame, types: list[str], guards: list[str]) -> DataFrame:
    """Unchecked fields used as a program in their file, with none of the guard keys."""
    rows = fields.filter(F.col("type_name").isin(*types) & ~F.exists("keys", lambda k: k.isin(*guards)))
    used = usages.filter("kind = 'cpi_program'").select("file", F.col("account").alias("name")).distinct()
    return rows.join(used, ["file", "name"], "left_semi")


def raw_risk(events: DataFrame, keys: list[str], read: Column, check: Column) -> DataFrame:
    """Groups (body and account) that read raw data without the check; a check anywhere in the group counts."""
    agg = events.groupBy(*keys).agg(F.count_if(read).alias("reads"), F.count_if(check).alias("checks"))
    return agg.filter("reads > 0 and checks = 0").drop("checks")


def missing_signer_populated(instructions: DataFrame, fields: DataFrame) -> DataFrame:
    """(context, account) without a signer; a context with an unpopulated instruction is silent, and if some field requires a signer only those count.

    instructions (context, populated); fields (context, account, requires, is_signer).
    """
    ready = instructions.groupBy("context").agg(F.bool_and(F.coalesce("populated", F.lit(False))).alias("ok")).filter("ok").select("context")
    any_required = F.coalesce(F.max(F.col("requires").cast("int")).over(W.partitionBy("context")), F.lit(0)) == 1
    rows = fields.join(ready, "context", "left_semi").withColumn("_any", any_required)
    return rows.filter((~F.col("_any") | F.col("requires")) & ~F.coalesce("is_signer", F.lit(False))).select("context", "account")
