"""Closest names by segments against all pairs, with one scope of very many names."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import references


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("d", [1, 2])
def test_no_pair_within_the_distance_is_missed(spark, d):
    rng = random.Random(d)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 12)))
    names, candidates = [word() for _ in range(120)], [word() for _ in range(200)]
    f = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string").withColumn("s", F.lit(1))
    got = {(r["name"], r.candidate, r.distance) for r in references.within_distance(f(names, "name"), f(candidates, "candidate"), ["s"], d).collect()}
    assert got == {(a, b, distance(a, b)) for a in names if len(a) > 2 * d + 1 for b in candidates if distance(a, b) <= d and len(b) > d}


def test_one_scope_of_very_many_names(spark):
    """60,000 candidates; the names meet few of them."""
    digits = F.lpad((F.col("id") * 7919 % 1_000_003).cast("string"), 7, "0")
    candidates = spark.range(60_000).select(F.lit(1).alias("s"), F.concat(F.lit("account_"), digits, F.lit("_field")).alias("candidate"))
    names = candidates.limit(2000).select("s", F.regexp_replace("candidate", "account", "acount").alias("name"))
    pairs = references.within_distance(names, candidates, ["s"], 2)
    assert pairs.filter("distance = 1").count() == 2000
    got = references.closest(names, candidates, ["s"], 1).collect()
    assert len(got) == 2000 and all(r.candidate == r["name"].replace("acount", "account") and r.rank == 1 for r in got)


def test_inputs_are_computed_once(spark):
    candidates = spark.range(50).select(F.lit(1).alias("s"), F.concat(F.lit("account_"), "id").alias("candidate"))
    names = spark.range(5).select(F.lit(1).alias("s"), F.concat(F.lit("acount_"), "id").alias("name"))
    out = references.closest(names, candidates, ["s"], 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Range (" not in plan and out.count() == 10 and {r.distance for r in out.filter("rank = 1").collect()} == {1}
