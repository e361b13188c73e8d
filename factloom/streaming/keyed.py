"""Streams with state of their own for each key (survey T2, T3).

Both run in ``transformWithStateInPandas``, whose state lives in RocksDB and comes back after a restart. Clocks are event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """The state store that keyed state and timers need; a setting of the session, read when a stream starts."""
    spark.conf.set(_PROVIDER, _ROCKS)


class _Debouncer(StatefulProcessor):
    """Waiting commands of a key, and the payload that is pending with its first and last time and count.

    A command counts when the watermark has passed it, so commands that arrive out of order are taken in the order of their
    times. What has to wait is at most what the watermark's delay lets arrive late.
    """

    WAITING = StructType([StructField("at", LongType()), StructField("seq", LongType()), StructField("kind", StringType()), StructField("payload", StringType())])
    PENDING = StructType([StructField("first", LongType()), StructField("last", LongType()), StructField("payload", StringType()), StructField("n", LongType())])

    def __init__(self, delay_ms: int):
        self.delay = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.pending = handle.getValueState("pending", self.PENDING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = 1 << 62
        for part in rows:
            values = list(zip(part["at"].tolist(), part["seq"].tolist(), part["kind"].tolist(), part["payload"].tolist(), strict=True))
            self.waiting.appendList(values)
            first = min(first, *(v[0] for v in values)) if values else first
        # one timer a key and batch: what waits behind it is due with it or gets the next
        if first < 1 << 62:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        every = sorted((tuple(v) for v in self.waiting.get()), key=lambda v: v[:2]) if self.waiting.exists() else []
        due, later = [v for v in every if v[0] <= now], [v for v in every if v[0] > now]
        pending = self.pending.get() if self.pending.exists() else None
        had, fired = pending is not None, []

        def fire(at: int) -> None:
            fired.append((key[0], pending[0], at, pending[2], pending[3]))

        for at, _, kind, payload in due:
            # a deadline that falls on a command comes before it
            if pending is not None and pending[1] + self.delay <= at:
                fire(pending[1] + self.delay)
                pending = None
            if kind == "schedule":
                pending = (at if pending is None else pending[0], at, payload, 1 if pending is None else pending[3] + 1)
            elif kind == "flush" and pending is not None:
                fire(at)
                pending = None
            elif kind == "cancel":
                pending = None
        if pending is not None and pending[1] + self.delay <= now:
            fire(pending[1] + self.delay)
            pending = None
        if due:
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(later[0][0])
            else:
                self.waiting.clear()
        if pending is not None:
            self.pending.update(pending)
            self.handle.registerTimer(pending[1] + self.delay)
        elif had:
            self.pending.clear()
        if fired:
            yield pd.DataFrame(fired, columns=["key", "first", "fired", "payload", "n"])

    def close(self) -> None:
        pass


def debounce_commands(commands: DataFrame, delay_ms: int = 700, late: str = "10 minutes") -> DataFrame:
    """(key, first, fired, payload, n) of a stream (key, ts, seq, kind, payload) of commands.

    ``schedule`` makes its payload the key's pending one and starts the delay anew; a payload fires when the delay is over, at
    once on ``flush``, and never after ``cancel``. first and fired are milliseconds, n counts the schedules of the burst.
    Commands of one millisecond go by ``seq``; a delay that ends as a command comes ends first. Commands later than the
    watermark are dropped, as Spark does.
    """
    use_keyed_state(commands.sparkSession)
    kind = commands.schema["key"].dataType.simpleString()
    rows = commands.select("key", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("seq").cast("long").alias("seq"), "kind", F.col("payload").cast("string").alias("payload"))
    grouped = rows.withWatermark("ts", late).groupBy("key")
    schema = f"key {kind}, first long, fired long, payload string, n long"
    return grouped.transformWithStateInPandas(_Debouncer(delay_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class _Guard(StatefulProcessor):
    """The newest version of a key, and until when it is kept."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", StructType([StructField("version", LongType()), StructField("until", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, until = self.newest.get() if self.newest.exists() else (None, 0)
        before, out = (newest, until), []
        every = [r for part in rows for r in zip(*(part[c].tolist() for c in ("seq", "version", "is_result", "at")), strict=True)]
        for seq, number, is_result, at in sorted(every, key=lambda r: r[0]):
            version = None if pd.isna(number) else int(number)
            if not is_result:
                if version is not None:
                    newest, until = version if newest is None else max(newest, version), max(until, int(at) + self.ttl)
            elif version is None or newest is None or version >= newest:
                out.append((key[0], int(seq), version))
        if newest is not None and (newest, until) != before:
            self.newest.update((newest, until))
            self.handle.registerTimer(until)
        if out:
            found = pd.DataFrame(out, columns=["key", "seq", "version"])
            found["version"] = found["version"].astype("Int64")
            yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists() and self.newest.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def guard_versions(updates: DataFrame, ttl_ms: int = 86_400_000, late: str = "10 minutes") -> DataFrame:
    """The results (key, seq, version) of a stream (key, ts, seq, version, is_result) that no newer version overtook.

    The other rows announce the version that is current from then on. A result is dropped if a larger version of its key came
    before it, in an earlier batch or with a smaller ``seq`` of the same one; equal and null versions pass. A key is forgotten
    when the watermark is ``ttl_ms`` past its last announcement, so the state holds recent keys only.
    """
    use_keyed_state(updates.sparkSession)
    kind = updates.schema["key"].dataType.simpleString()
    ts = F.col("ts").cast("timestamp")
    rows = updates.select("key", ts.alias("ts"), F.unix_millis(ts).alias("at"), F.col("seq").cast("long").alias("seq"), F.col("version").cast("long").alias("version"), F.coalesce("is_result", F.lit(False)).alias("is_result"))
    grouped = rows.withWatermark("ts", late).groupBy("key")
    return grouped.transformWithStateInPandas(_Guard(ttl_ms), outputStructType=f"key {kind}, seq long, version long", outputMode="Append", timeMode="EventTime")
