"""Keyed tables that streams write version by version and that survive restarts (survey T1, S12).

A table is a folder:

* ``runs/<name>/bucket=<b>``: the rows of one batch, or of merged batches, dealt by the hash of the key. Rows carry the version
  that wrote them and whether their key is gone.
* ``commits/<version>.json``: one small file a version, written last. It lists the runs of each bucket with their row
  counts, the schema, and the last batch of each query. What no commit lists does not exist.

A batch adds a run to the buckets of its keys and touches no other. Runs of a bucket are merged geometrically: while the
run before the last has less than ``RATIO`` times its rows, both become one; so a row is written again a logarithmic number of
times, and a reader meets few runs. A merge down to the oldest run forgets the keys that are gone.

A batch that comes again after a stop is known by its number and changes nothing; a batch that stopped before its commit leaves
only runs that no commit lists, which the next commit removes. A table has one writer at a time; readers follow
the newest commit, and runs stay for ``KEEP`` commits after they are replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new table, how many times larger an older run stays unmerged, and commits whose runs are kept.
BUCKETS, RATIO, KEEP = 32, 2, 2


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # commits

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("commits") if n.endswith(".json") and not n.startswith((".", "_"))]

    def _read(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/commits/{version:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self) -> dict | None:
        """The newest commit, if any."""
        found = self.versions()
        return self._read(found[-1]) if found else None

    def _write(self, version: int, commit: dict) -> None:
        """Written under another name and renamed, so a commit is there as a whole or not at all."""
        part, place = self._path(f"{self.path}/commits/.{uuid.uuid4().hex}"), self._path(f"{self.path}/commits/{version:020d}.json")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(commit), "utf-8"))
        out.close()
        if self._fs.exists(place) or not self._fs.rename(part, place):
            raise RuntimeError(f"version {version} of {self.path} was written by another query")

    # rows

    def _rows(self, schema: StructType, runs: Iterator[tuple[str, str]]) -> DataFrame | None:
        """The rows of (bucket, run) places."""
        paths = [f"{self.path}/runs/{run}/bucket={b}" for b, run in runs]
        full = StructType.fromJson(schema.jsonValue()).add("_version", "long").add("_gone", "boolean")
        return self.spark.read.schema(full).parquet(*paths) if paths else None

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The rows of each key's newest version. The maxima come together before they move, so a key with very many rows is no single group."""
        names = [f"_key{i}" for i in range(len(self.keys))]
        last = rows.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(self.keys, names, strict=True)]).agg(F.max("_version").alias("_last"))
        same = F.col("_version") == F.col("_last")
        for k, n in zip(self.keys, names, strict=True):
            same &= F.col(f"`{k}`").eqNullSafe(F.col(n))
        return rows.join(last, same).drop(*names, "_last")

    def read(self, schema: StructType) -> DataFrame:
        """The current rows; none before the first commit. Buckets of a single run are read as they are."""
        commit = self.commit() or {"runs": {}}
        lists = commit["runs"].items()
        one = self._rows(schema, ((b, runs[0][0]) for b, runs in lists if len(runs) == 1))
        more = self._rows(schema, ((b, run) for b, runs in lists if len(runs) > 1 for run, _ in runs))
        found = [x for x in (one, more is not None and self._newest(more)) if x]
        if not found:
            return self.spark.createDataFrame([], schema)
        out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        return out.filter("not _gone").select(*[f"`{c}`" for c in schema.names])

    def _put(self, rows: DataFrame, name: str) -> dict[str, int]:
        """Write a run; the rows of each bucket. Large buckets are split over tasks and small ones share them."""
        place = f"{self.path}/runs/{name}"
        number = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")
        rows.withColumn("bucket", number).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(place)
        if not self._fs.globStatus(self._path(f"{place}/bucket=*")):
            return {}
        found = self.spark.read.option("basePath", place).parquet(place).groupBy("bucket").count().collect()
        return {str(r["bucket"]): r["count"] for r in found}

    def replace(self, rows: DataFrame, gone: Column | None = None, query: str = "", batch: int | None = None) -> int:
        """Commit a version in which the rows of each key in ``rows`` replace all it had; rows where ``gone`` holds only clear it.

        A ``batch`` of a ``query`` that was committed before is left out. Returns the newest version.
        """
        found = self.versions()
        before = self._read(found[-1]) if found else {"version": -1, "runs": {}, "batches": {}, "buckets": self.buckets, "schema": rows.schema.jsonValue()}
        if batch is not None and batch <= before["batches"].get(query, -1):
            return before["version"]
        if [(f["name"], f["type"]) for f in before["schema"]["fields"]] != [(f["name"], f["type"]) for f in rows.schema.jsonValue()["fields"]]:
            raise ValueError(f"rows of {self.path} have other columns than before")
        self.buckets = before["buckets"]
        version = before["version"] + 1
        own = rows.withColumns({"_version": F.lit(version).cast("long"), "_gone": F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)})
        name = f"{version:020d}-{uuid.uuid4().hex}"
        runs = {b: list(map(list, r)) for b, r in before["runs"].items()}
        for b, n in self._put(own, name).items():
            runs.setdefault(b, []).append([name, n])
        self._merge(rows.schema, runs, name)
        batches = before["batches"] | ({query: batch} if batch is not None else {})
        self._write(version, before | {"version": version, "runs": runs, "batches": batches})
        self._tidy(version)
        return version

    def _merge(self, schema: StructType, runs: dict[str, list], name: str) -> None:
        """Merge the last runs of each bucket that came to be too large for those before them; all in one job."""
        due = {}
        for b, own in runs.items():
            at, size = len(own) - 1, own[-1][1]
            if own[-1][0] != name:
                continue
            while at and own[at - 1][1] < RATIO * size:
                at -= 1
                size += own[at][1]
            if at < len(own) - 1:
                due[b] = at
        if not due:
            return
        merged = f"{name}-merged"
        whole = [self._rows(schema, ((b, run) for b, at in due.items() if (at == 0) is down for run, _ in runs[b][at:])) for down in (True, False)]
        parts = [self._newest(x) for x in whole if x is not None]
        if whole[0] is not None:
            parts[0] = parts[0].filter("not _gone")
        counts = self._put(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), merged)
        for b, at in due.items():
            runs[b][at:] = [[merged, counts[b]]] if counts.get(b) else []
        for b in [b for b, own in runs.items() if not own]:
            del runs[b]

    def _tidy(self, version: int) -> None:
        """Remove commits before the last ``KEEP`` and the runs, or their buckets, that no commit lists."""
        found = self.versions()
        for v in found[:-KEEP]:
            self._fs.delete(self._path(f"{self.path}/commits/{v:020d}.json"), False)
        listed: dict[str, set[str]] = {}
        for v in found[-KEEP:]:
            for b, own in self._read(v)["runs"].items():
                for run, _ in own:
                    listed.setdefault(run, set()).add(f"bucket={b}")
        for run in self._names("runs"):
            if run not in listed:
                self._fs.delete(self._path(f"{self.path}/runs/{run}"), True)
                continue
            for part in self._names(f"runs/{run}"):
                if part.startswith("bucket=") and part not in listed[run]:
                    self._fs.delete(self._path(f"{self.path}/runs/{run}/{part}"), True)


def run_batches(stream: DataFrame, path: str, publish, mode: str = "append") -> None:
    """Run a stream over all data at hand; ``publish`` (batch, query, number) commits each batch. A later start goes on where this one ended."""

    def each(batch: DataFrame, number: int) -> None:
        publish(batch, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "", number)

    started = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).outputMode(mode)
    started.start().awaitTermination()
