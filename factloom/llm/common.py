"""Helpers that several operators share: shared staging tables and table reading."""

from __future__ import annotations

import contextlib
import ctypes
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.sources.staging import new_path

#: ASCII white space that separates words: space and \\x09-\\x0D.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    It cuts the lineage: what follows survives lost executors without running ``df`` again,
    and Spark knows the true size of the table when it picks joins.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def _give_back() -> None:
    """Return unused memory of Arrow's pool and, where there is glibc, of its heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; gives unused memory back now and then and when a task ends, since workers live on between stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        for out in run(batches):
            yield out
            if time.monotonic() - last > 1:
                _give_back()
                last = time.monotonic()
        _give_back()

    return wrapped


def dropped(*frames: DataFrame) -> None:
    """Remove the folders of ``staged`` tables that no later step reads."""
    for df in frames:
        drop_path(df.sparkSession, df.staged_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that no later step reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
