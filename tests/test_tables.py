"""Versioned tables: restarts, stops between write and commit, merges, and what a batch touches."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.streaming import tables, updates

SCHEMA = "key long, version int, payload string"


def read(table, spark):
    return sorted(tuple(r) for r in table.read(spark.createDataFrame([], SCHEMA).schema).collect())


def test_many_versions_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(4)
    want = {}
    sizes = []
    for v in range(14):
        table = tables.VersionedTable(spark, f"{tmp_path}/t", ["key"], buckets=3)
        keys = rng.sample(range(40), rng.choice([1, 2, 15]))
        rows = [(k, v, rng.choice(["a", "b", None])) for k in keys for _ in range(rng.randint(1, 3))]
        for k in keys:
            own = [r for r in rows if r[0] == k and r[2] is not None]
            want.pop(k, None)
            if own:
                want[k] = own
        assert table.replace(spark.createDataFrame(rows, SCHEMA), F.col("payload").isNull()) == v
        assert read(table, spark) == sorted(r for own in want.values() for r in own)
        sizes.append(max(len(r) for r in table.commit()["runs"].values()))
    assert max(sizes) <= 5 and len(table.versions()) == tables.KEEP
    for own in table.commit()["runs"].values():
        assert all(a[1] >= tables.RATIO * b[1] for a, b in zip(own[:-1], own[1:], strict=True))


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    table = tables.VersionedTable(spark, f"{tmp_path}/t", ["key"], buckets=8)
    table.replace(spark.range(400).selectExpr("id as key", "0 as version", "'x' as payload"))
    before = table.commit()["runs"]
    table.replace(spark.createDataFrame([(7, 1, "y")], SCHEMA))
    after = table.commit()["runs"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert [r for r in read(table, spark) if r[0] == 7] == [(7, 1, "y")] and len(read(table, spark)) == 400


def test_a_stop_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], SCHEMA).write.parquet(source)
    run = lambda: sorted(tuple(r) for r in updates.run_upserts(spark, updates.read_updates(spark, source, SCHEMA), out, "key", [F.col("version")], F.col("payload") == "gone").collect())
    assert run() == [(1, 1, "a"), (2, 1, "b")]
    assert run() == [(1, 1, "a"), (2, 1, "b")]  # nothing new, and nothing lost
    spark.createDataFrame([(2, 3, "d"), (2, 2, "c"), (1, 2, "gone"), (3, 1, "e")], SCHEMA).write.mode("append").parquet(source)
    write = tables.VersionedTable._write

    def stop(self, version, commit):
        raise OSError("stopped")

    monkeypatch.setattr(tables.VersionedTable, "_write", stop)
    with pytest.raises(Exception, match="stopped"):
        run()
    table = tables.VersionedTable(spark, f"{out}/table", ["key"])
    assert read(table, spark) == [(1, 1, "a"), (2, 1, "b")] and len(table._names("runs")) > 1
    monkeypatch.setattr(tables.VersionedTable, "_write", write)
    assert run() == [(2, 3, "d"), (3, 1, "e")]
    listed = {run for v in table.versions() for own in table._read(v)["runs"].values() for run, _ in own}
    assert set(table._names("runs")) == listed


def test_a_repeated_batch_is_left_out(spark, tmp_path):
    table = tables.VersionedTable(spark, f"{tmp_path}/t", ["key"])
    put = lambda rows, batch, query="q": table.replace(spark.createDataFrame(rows, SCHEMA), None, query, batch)
    assert put([(1, 1, "a")], 0) == 0 and put([(1, 2, "b")], 1) == 1
    assert put([(1, 1, "a")], 0) == 1 and put([(1, 2, "b")], 1) == 1
    assert read(table, spark) == [(1, 2, "b")] and put([(1, 3, "c")], 0, "other") == 2
    with pytest.raises(ValueError):
        table.replace(spark.range(1))


def test_empty_tables_and_null_keys(spark, tmp_path):
    table = tables.VersionedTable(spark, f"{tmp_path}/t", ["key"])
    assert read(table, spark) == []
    table.replace(spark.createDataFrame([], SCHEMA))
    assert read(table, spark) == []
    table.replace(spark.createDataFrame([(None, 1, "a")], SCHEMA))
    table.replace(spark.createDataFrame([(None, 2, "b"), (5, 2, "c")], SCHEMA))
    assert [r[1:] for r in table.read(spark.createDataFrame([], SCHEMA).schema).orderBy("payload").collect()] == [(2, "b"), (2, "c")]
