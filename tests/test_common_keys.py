"""Keys that very many rows share are in no single task: type names, constraint families."""

from pyspark.sql import functions as F

from factloom.operators import artifacts, constraints
from factloom.plans import demo, demo_more  # noqa: F401


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_families_are_not_dealt_by_prefix(spark):
    keys = F.array(F.struct(F.when(F.col("id") % 2 == 0, "token::x").otherwise("mint::y").alias("key")))
    rows = spark.range(40).select(F.lit("c").alias("container"), F.col("id").alias("field"), F.lit("Mint").alias("type_name"), keys.alias("keys"))
    targets = spark.createDataFrame([("token::", ["TokenAccount"], "token-target-type"), ("mint::", ["Mint"], "mint-target-type")], "prefix string, types array<string>, issue string")
    out = constraints.token_targets(rows, targets)
    assert "hashpartitioning(prefix" not in plan_of(out)
    assert sorted(r.field for r in out.collect()) == list(range(0, 40, 2))


def test_common_types_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(artifacts, "MANY_FIELDS", 3)
    none = F.lit(None).cast("int")
    rows = [("s", "u8")] * 5 + [("t", "u8"), ("t", "u32"), ("n", None), ("o", "s"), ("x", "?")] + [(f"m{i}", None) for i in range(5)] + [(f"p{i}", "s") for i in range(5)]
    fields = spark.createDataFrame(rows, "container string, type_name string").select("*", F.lit(False).alias("optional"), F.lit(False).alias("is_enum_variant"), none.alias("count"), none.alias("max_len"))
    sizes = spark.createDataFrame([("u8", 1), ("u32", 4)], "type_name string, bytes int")
    got = {r.container: r.bytes for r in artifacts.estimate_space(fields, sizes, depth=2).collect()}
    assert got == {"s": 5, "t": 5, "n": None, "o": 5, "x": None} | {f"m{i}": None for i in range(5)} | {f"p{i}": 5 for i in range(5)}


def test_rules_share_one_scan(spark):
    assert "documents.parquet" not in plan_of(demo.QUERIES["u3_union"](spark, "/root/testdata/sf0.001"))
