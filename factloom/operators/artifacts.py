"""Project identity and build artifacts (survey J16 to J19, A7, A17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.scalars import normal_name


def preferred(rows: DataFrame, keys: list[str], kind: Column, priority: list[str], ties: list[Column]) -> DataFrame:
    """One row a key, by an explicit priority list, then by ``ties``; unlisted kinds come last."""
    rank = F.lit(len(priority))
    for i, p in reversed(list(enumerate(priority))):
        rank = F.when(kind == p, i).otherwise(rank)
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(rank, *ties))).filter("_n = 1").drop("_n")


def id_mismatch(declared: DataFrame, config: DataFrame, provider: str = "provider_cluster") -> DataFrame:
    """(program, declared_id, config_id, cluster) where the id in the code is not that of the chosen cluster.

    declared (program, program_id, provider_cluster); config (program, cluster, program_id, ordinal).
    """
    joined = config.join(declared.select("program", F.col("program_id").alias("declared_id"), provider), "program")
    kind = F.when(F.col("cluster") == F.col(provider), "provider").when(F.col("cluster") == "localnet", "localnet").otherwise("other")
    chosen = preferred(joined, ["program"], kind, ["provider", "localnet"], [F.col("ordinal")])
    return chosen.filter("declared_id <> program_id").select("program", "declared_id", F.col("program_id").alias("config_id"), "cluster")


def artifact_findings(programs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(root, name, issue) of programs (root, name, program_id) and artifacts (root, program, kind, state, public_key, idl_name, idl_address).

    Roots without any present artifact are no build surface and silent; a keypair is missed only where a deploy file exists.
    """
    a = artifacts.withColumn("program", normal_name(F.col("program")))
    surface = a.filter("state <> 'missing'").select("root").distinct()
    p = programs.withColumn("program", normal_name(F.col("name"))).join(surface, "root", "left_semi")
    state = lambda k: F.max(F.when(F.col("kind") == k, F.col("state")))
    wide = a.groupBy("root", "program").agg(
        *[state(k).alias(k) for k in ("deploy", "keypair", "idl", "types")],
        F.max(F.when(F.col("kind") == "keypair", F.col("public_key"))).alias("public_key"),
        F.max(F.when(F.col("kind") == "idl", F.col("idl_name"))).alias("idl_name"),
        F.max(F.when(F.col("kind") == "idl", F.col("idl_address"))).alias("idl_address"),
    )
    rows = p.join(wide, ["root", "program"], "left")
    gone = lambda k: F.coalesce(F.col(k), F.lit("missing")) == "missing"
    checks = [
        F.when(gone("deploy"), "deploy_missing").when(F.col("deploy") == "invalid", "deploy_invalid"),
        F.when(gone("keypair") & (F.col("deploy") == "present"), "keypair_missing").when(F.col("keypair") == "invalid", "keypair_invalid").when(F.col("public_key") != F.col("program_id"), "keypair_mismatch"),
        F.when(gone("idl"), "idl_missing").when(F.col("idl") == "invalid", "idl_invalid").when(normal_name(F.col("idl_name")) != F.col("program"), "idl_name").when(F.col("idl_address") != F.col("program_id"), "idl_address"),
        F.when(gone("types"), "types_missing"),
    ]
    return rows.select("root", "name", F.explode(F.array_compact(F.array(*checks))).alias("issue"))


def stale(artifacts: DataFrame, inputs: DataFrame, keys: list[str], modified: str = "modified", path: str = "path") -> DataFrame:
    """Artifacts older than an input, with the newest such input.

    Ties go to the greater path. Inputs are reduced to the newest a key before the join.
    """
    newest = inputs.groupBy(*keys).agg(F.max(F.struct(F.col(modified).alias("m"), F.col(path).alias("p"))).alias("_new"))
    joined = artifacts.join(newest, keys).filter(F.col("_new.m") > F.col(modified))
    return joined.withColumns({"newest_input": F.col("_new.p"), "newest_modified": F.col("_new.m")}).drop("_new")


def ecosystem_status(markers: DataFrame, tests: DataFrame) -> DataFrame:
    """(root, tool, status) from dependency markers (root, tool) and test files (root, tool): configured, missing_tests or detected."""
    m = markers.select("root", "tool").distinct().withColumn("_m", F.lit(True))
    t = tests.select("root", "tool").distinct().withColumn("_t", F.lit(True))
    status = F.when(F.col("_m") & F.col("_t"), "configured").when(F.col("_m"), "missing_tests").otherwise("detected")
    return m.join(t, ["root", "tool"], "full").select("root", "tool", status.alias("status"))


def compute_status(files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(file, status, reasons) from signals (file, program, reasons array) and artifact states (program, state, instructions)."""
    reasons = files.groupBy("file", "program").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    status = F.when(F.col("state").isNull() | (F.col("state") == "missing"), "no_artifact").when(F.col("state") == "invalid", "invalid_artifact").when(F.size("reasons") > 0, "review").otherwise("measured")
    return reasons.join(artifacts, "program", "left").select("file", "program", status.alias("status"), "reasons", "instructions")


#: Fields of one type name beyond which its size is broadcast.
MANY_FIELDS = 100_000


def estimate_space(fields: DataFrame, sizes: DataFrame, depth: int = 8) -> DataFrame:
    """(container, bytes) of structs, bottom up; null if a field is unknown or the nesting is recursive or deeper than ``depth``.

    fields (container, type_name, optional, is_enum_variant, count, max_len): count is an array's length, max_len a
    vector's or string's; sizes (type_name, bytes) are the primitives. A vector adds 4 bytes, an
    option 1; an enum is its largest variant and 1. Type names with more than ``MANY_FIELDS`` fields, of which there are few,
    are broadcast with their sizes, so no task gets all fields of a common type.
    """
    common = F.broadcast(fields.groupBy("type_name").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > MANY_FIELDS).select(F.col("type_name").alias("_t")))
    is_common = F.col("type_name").eqNullSafe(F.col("_t"))
    rare = fields.join(common, is_common, "left_anti")
    often = fields.join(common, is_common, "left_semi")
    known = sizes.select("type_name", F.col("bytes").cast("long").alias("bytes"))
    for _ in range(depth):
        each = rare.join(known, "type_name", "left").unionByName(often.join(F.broadcast(known.join(common, is_common, "left_semi")), "type_name", "left"))
        one = F.col("bytes") * F.coalesce("count", F.lit(1)).cast("long")
        one = F.when(F.col("max_len").isNotNull(), 4 + F.col("bytes") * F.col("max_len")).otherwise(one) + F.when(F.col("optional"), 1).otherwise(0)
        total = each.withColumn("_b", one).groupBy("container").agg(
            F.sum("_b").alias("_sum"), F.max("_b").alias("_max"), F.count("_b").alias("_k"), F.count(F.lit(1)).alias("_n"), F.bool_or("is_enum_variant").alias("_enum")
        )
        done = total.filter("_k = _n").select(F.col("container").alias("type_name"), F.when(F.col("_enum"), F.col("_max") + 1).otherwise(F.col("_sum")).cast("long").alias("bytes"))
        known = sizes.select("type_name", F.col("bytes").cast("long").alias("bytes")).unionByName(done).dropDuplicates(["type_name"])
    return fields.select("container").distinct().join(known.withColumnRenamed("type_name", "container"), "container", "left")
