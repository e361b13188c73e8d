"""Streams of document updates (survey T1 to T7). Clocks are event time, not processing time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.preflight import detected_errors
from factloom.operators.references import latest
from factloom.streaming.tables import VersionedTable, run_batches


def read_updates(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def upsert_index(index: DataFrame, batch: DataFrame, key: str, order: list[Column], removed: Column | None = None) -> DataFrame:
    """The index after a batch: its latest row of each key replaces the old one; removed keys go."""
    fresh = latest(batch, [key], order)
    kept = index.join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh.filter(~removed) if removed is not None else fresh, allowMissingColumns=True)


def drop_stale(results: DataFrame, current: DataFrame, key: str, version: str = "version") -> DataFrame:
    """Results not older than the current version of their key; equal and null versions pass. For ``foreachBatch``."""
    now = current.groupBy(key).agg(F.max(version).alias("_v"))
    return results.join(now, key, "left").filter(F.col(version).isNull() | F.col("_v").isNull() | (F.col(version) >= F.col("_v"))).drop("_v")


def debounce(updates: DataFrame, key: str, ts: str, payload: str, version: str, gap: str = "700 milliseconds", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, payload, n): one row for each burst of updates less than ``gap`` apart, with its newest payload."""
    source = updates.withWatermark(ts, late) if updates.isStreaming else updates
    grouped = source.groupBy(F.col(key), F.session_window(ts, gap).alias("w"))
    out = grouped.agg(F.max_by(payload, version).alias("payload"), F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "payload", "n")


def suppress_recent(findings: DataFrame, changes: DataFrame, ttl: str = "250 milliseconds", late: str = "1 minute") -> DataFrame:
    """T4: findings (file, ts, start, end) but those that touch a range (file, ts, start, end) changed at most ``ttl`` before."""
    c = changes.select(F.col("file").alias("_f"), F.col("ts").alias("_ts"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    if findings.isStreaming:
        findings, c = findings.withWatermark("ts", late), c.withWatermark("_ts", late)
    near = (F.col("file") == F.col("_f")) & (F.col("_ts") <= F.col("ts")) & (F.col("_ts") >= F.col("ts") - F.expr(f"interval {ttl}"))
    hit = near & (F.col("start") <= F.col("_b")) & (F.col("_a") <= F.col("end"))
    return findings.join(c, hit, "left_outer").filter("_f is null").drop("_f", "_ts", "_a", "_b")


def lanes(stream: DataFrame, phase: str = "phase", hot: int = 1) -> tuple[DataFrame, DataFrame]:
    """T5: the hot lane (phases up to ``hot``) and the cold lane (all) of one stream."""
    return stream.filter(F.col(phase) <= hot), stream


def stream_preflight(invocations: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, name, n) of detected errors in each window; detection itself keeps no state."""
    source = invocations.withWatermark(ts, late) if invocations.isStreaming else invocations
    rows = source.select(ts, F.explode(detected_errors()).alias("name"))
    out = rows.groupBy(F.window(ts, window).alias("w"), "name").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "name", "n")


def changed_only(facts: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The facts to compute again: those of changed keys."""
    return facts.join(changed.select(key).distinct(), key, "left_semi")


def run_files(result: DataFrame, path: str) -> DataFrame:
    """Run a stream over all data at hand, appended to files in ``path``; return what they hold."""
    started = result.writeStream.format("parquet").option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).outputMode("append")
    started.start(f"{path}/rows").awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{path}/rows")


def run_latest(result: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Run a stream of aggregates over all data at hand in update mode; return the last row of each key. Starting again goes on from there."""
    table = VersionedTable(result.sparkSession, f"{path}/table", keys)
    run_batches(result, path, lambda batch, query, number: table.replace(batch, None, query, number), "update")
    return table.read(result.schema)


def run_upserts(spark: SparkSession, stream: DataFrame, path: str, key: str, order: list[Column], removed: Column | None = None) -> DataFrame:
    """T1 over a stream: each batch's latest row of each key replaces the key's row in the table in ``path``; return the table.

    A batch writes its own keys only; a later start on the same folder goes on with the table that is there.
    """
    table = VersionedTable(spark, f"{path}/table", [key])
    run_batches(stream, path, lambda batch, query, number: table.replace(latest(batch, [key], order), removed, query, number))
    return table.read(stream.schema)
