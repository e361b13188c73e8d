"""Range joins on tiles against plain comparisons, with one file of very many spans and points."""

import random

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import findings, tiles


def test_tiles_of_a_span_are_a_partition(spark):
    rng = random.Random(1)
    spans = [(a, a + rng.choice([0, 1, 2, 3, 7, 64, 1000, 1 << 40])) for a in [-9, -1, 0, 1, 5, 1 << 45, *(rng.randint(-1000, 1000) for _ in range(60))]]
    spans += [(5, 3), (None, 3), (3, None)]
    df = spark.createDataFrame(spans, "start long, end long").withColumn("t", tiles.span_tiles(F.col("start"), F.col("end")))
    for r in df.collect():
        if r.start is None or r.end is None or r.start >= r.end:
            assert not r.t
            continue
        parts = sorted((t.tile << t.k, (t.tile + 1) << t.k) for t in r.t)
        assert parts[0][0] == r.start and parts[-1][1] == r.end and all(x[1] == y[0] for x, y in zip(parts[:-1], parts[1:], strict=True))
        assert len(parts) <= 2 * max(1, (r.end - r.start).bit_length())


def test_one_file_of_very_many_spans(spark):
    rng = np.random.default_rng(3)
    n, top = 100_000, 1 << 31
    start, at = rng.integers(0, top, n), rng.integers(0, top, n)
    end = start + rng.integers(1, 1 << 18, n)
    spans = spark.createDataFrame([("f", int(a), int(b)) for a, b in zip(start, end, strict=True)], "file string, start long, end long")
    points = spark.createDataFrame([("f", int(p)) for p in at], "file string, at long")
    got = findings.in_range(points, spans).groupBy().agg(F.count("*").alias("n"), F.sum("at").alias("s"), F.count_if((F.col("at") < F.col("start")) | (F.col("at") >= F.col("end"))).alias("bad")).first()
    inside = np.searchsorted(np.sort(start), at, "right") - np.searchsorted(np.sort(end), at, "right")
    assert (got.n, got.s, got.bad) == (int(inside.sum()), int((inside * at).sum()), 0) and got.n > 300_000


def test_the_shortest_region_decides(spark):
    rows = [("f", 3, 0, 3, 4, i, 0, "c") for i in range(2)] + [("f", 9, 0, 9, 1, 0, 0, "c"), ("g", 3, 0, 3, 1, 0, 0, "c")]
    data = spark.createDataFrame(rows, "file string, start_line int, start_char int, end_line int, end_char int, rule_seq int, emit_seq int, code string")
    at = lambda line: line << 20
    regions = spark.createDataFrame([("f", at(0), at(20), "all"), ("f", at(2), at(5), "b"), ("f", at(1), at(4), "a"), ("f", at(3), at(3), "none")], "file string, start long, end long, region string")
    run = lambda *scope: sorted((r.file, r.start_line) for r in findings.filter_by_region(data, regions, list(scope), "low", "auto", "t").collect())
    assert run("a") == [("f", 3), ("f", 3)] and run("b") == [] and run("all") == [("f", 9)] and run("other") == [("g", 3)]


def test_tiles_that_many_spans_begin_in(spark, monkeypatch):
    monkeypatch.setattr(tiles, "CROWDED", 20)
    rng = random.Random(4)
    spans = [("f", a, a + rng.choice([0, 1, 3, 64, 100, 1000])) for a in [*range(-40, 60), *(rng.randint(-300, 300) for _ in range(200))]] + [(None, 0, 9), ("f", None, 3)]
    points = [("f", rng.randint(-400, 1200)) for _ in range(150)] + [("g", 3), ("f", None)]
    got = findings.in_range(spark.createDataFrame(points, "file string, at long"), spark.createDataFrame(spans, "file string, start long, end long"))
    assert sorted((r.file, r.at, r.start, r.end) for r in got.collect()) == sorted((f, p, a, b) for f, p in points if p is not None for g, a, b in spans if f == g and a is not None and a <= p < b)


def test_a_span_of_an_hour_is_three_rows_at_most(spark):
    hour = spark.range(100).select(F.lit("f").alias("file"), (F.col("id") * 977_777_777).alias("start")).withColumn("end", F.col("start") + 3_600_000_000)
    plan = findings.in_range(hour.select("file", F.col("start").alias("at")), hour)._jdf.queryExecution().executedPlan().toString()
    assert tiles.covered(hour).count() <= 300 and "SortMergeJoin [" in plan
