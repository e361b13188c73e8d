"""Streams with keyed state and with two watermarks, replayed in parts, against plain loops."""

import random

import pandas as pd
from pyspark.sql import functions as F

from factloom.streaming import keyed, updates

COMMANDS = "key string, ms long, seq long, kind string, payload string"


def fired_by(rows, delay):
    out, by_key = [], {}
    for r in rows:
        by_key.setdefault(r[0], []).append(r)
    for key, own in by_key.items():
        own.sort(key=lambda r: r[1:3])
        pending = None
        for _, at, _, kind, payload in [*own, (key, 10**15, 0, "end", None)]:
            if pending and pending[1] + delay <= at:
                out.append((key, pending[0], pending[1] + delay, pending[2], pending[3]))
                pending = None
            if kind == "schedule":
                pending = (pending[0] if pending else at, at, payload, pending[3] + 1 if pending else 1)
            elif kind == "flush" and pending:
                out.append((key, pending[0], at, pending[2], pending[3]))
                pending = None
            elif kind == "cancel":
                pending = None
    return sorted(out, key=repr)


def test_debounce_with_cancel_and_flush(spark, tmp_path):
    rng = random.Random(2)
    base = 1_700_000_000_000
    rows = [(rng.choice(["a", "b", "c"]), base + rng.randint(0, 200) * 100, i, rng.choice(["schedule"] * 4 + ["cancel", "flush"]), f"p{i}") for i in range(300)]
    rows += [("d", base, 0, "schedule", "x"), ("d", base + 700, 1, "cancel", None), ("e", base, 0, "schedule", "x"), ("e", base + 699, 1, "cancel", None), ("f", base, 0, "flush", None)]
    rows.sort(key=lambda r: r[1] + rng.randint(-3000, 3000))  # out of order, within the watermark's delay
    parts = [rows[:100], rows[100:200], rows[200:], [("end", base + 10**9, 0, "cancel", None)]]
    for part in parts:
        df = spark.createDataFrame(part, COMMANDS).withColumn("ts", F.timestamp_millis("ms")).drop("ms")
        df.write.mode("append").parquet(f"{tmp_path}/in")
        stream = updates.read_updates(spark, f"{tmp_path}/in", "key string, seq long, kind string, payload string, ts timestamp")
        got = updates.run_files(keyed.debounce_commands(stream, 700, "10 seconds"), f"{tmp_path}/out")
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    assert found == fired_by(rows, 700)
    assert ("d", base, base + 700, "x", 1) in found and not [r for r in found if r[0] in "ef"]


def test_guard_remembers_versions_of_earlier_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, *range(6)]), rng.random() < 0.6) for i in range(150)]
    newest, want = {}, []
    for key, seq, version, is_result in rows:
        if not is_result:
            if version is not None:
                newest[key] = max(version, newest.get(key, version))
        elif version is None or version >= newest.get(key, version):
            want.append((key, seq, version))
    day = 86_400
    rows += [("old", 150, 5, False), ("tick", 30 * day, 1, False), ("old", 30 * day + 1, 3, True)]
    schema = "key string, seq long, version int, is_result boolean"
    got = None
    for part in (rows[:75], rows[75:151], rows[151:152], rows[152:]):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq"))).write.mode("append").parquet(f"{tmp_path}/in")
        stream = updates.read_updates(spark, f"{tmp_path}/in", schema + ", ts timestamp")
        got = updates.run_files(keyed.guard_versions(stream, ttl_ms=day * 1000), f"{tmp_path}/out")
    # a version that was announced a month ago is forgotten
    want.append(("old", 30 * day + 1, 3))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want and len(want) < 90


def test_suppression_as_a_stream_equals_its_batch(spark, tmp_path):
    rng = random.Random(5)
    base = 1_700_000_000_000
    make = lambda n: [(rng.choice(["f", "g"]), base + rng.randint(0, 10_000), rng.randint(0, 50), i) for i in range(n)]
    shape = lambda rows: spark.createDataFrame(rows, "file string, ms long, start int, id int").withColumns({"ts": F.timestamp_millis("ms"), "end": F.col("start") + 5}).drop("ms")
    found, changed = make(200), make(60)
    end = [("end", base + 10**8, 0, -1)]
    want = sorted(r.id for r in updates.suppress_recent(shape(found), shape(changed)).collect())
    streams = lambda: [updates.read_updates(spark, f"{tmp_path}/{n}", "file string, start int, id int, ts timestamp, end int") for n in ("found", "changed")]
    for a, b in [(found[:100], changed[:30]), (found[100:], changed[30:]), (end, end)]:
        for name, rows in (("found", a), ("changed", b)):
            shape(rows).write.mode("append").parquet(f"{tmp_path}/{name}")
        got = updates.run_files(updates.suppress_recent(*streams()), f"{tmp_path}/out")
    assert sorted(r.id for r in got.collect() if r.id >= 0) == want and 0 < len(want) < 200


def test_a_batch_of_a_key_sets_one_timer():
    class Kept:
        def __init__(self):
            self.rows, self.timers = [], []

        appendList = lambda self, rows: self.rows.extend(rows)
        registerTimer = lambda self, at: self.timers.append(at)

    own = keyed._Debouncer(700)
    own.handle = own.waiting = kept = Kept()
    parts = [pd.DataFrame([(at, at, "schedule", "x") for at in (9, 5, 7)], columns=["at", "seq", "kind", "payload"]) for _ in range(2)]
    list(own.handleInputRows(("a",), iter(parts), None))
    assert kept.timers == [5] and len(kept.rows) == 6
