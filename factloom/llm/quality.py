"""Document quality by hierarchical empirical Bayes.

A classifier of the text gives each document a probability of good quality. Sites are hosts with
paths below them: the mean of a host is shrunk toward the global mean and that of a path toward its host's, by
pseudo-counts that the method of moments takes from how much means differ between hosts and between
the paths of a host. A document's odds are its text's likelihood ratio times the odds of its path; its own share is
taken out of the means of its path and of its host.

All statistics are sums grouped by path first, then by host, then overall, so a host with a third
of all rows is partial sums before it is shuffled.

The classifier is fitted on at most ``max_train`` labelled documents; without both classes among
them every text has the share of the class that is there (0.5 without labels).

Defined results: a null text is an empty one; null hosts and paths are groups; repeated rows count
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import textmodel as tm
from factloom.llm.common import released, staged


@dataclass
class TextModel:
    features: tm.Features
    model: tm.Linear | None
    constant: float = 0.5

    def predict(self, texts: list[bytes]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.constant)
        return self.model.predict(self.features.matrix(texts))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 6000, terms: int = 64) -> TextModel:
    """Fit the text model on at most ``max_train`` rows of ``labels`` (doc_id, quality)."""
    texts, good, weights, _ = tm.labelled_sample(docs, labels.select("doc_id", "quality"), "quality", max_train)
    if not len(good) or good.min() == good.max():
        return TextModel(tm.Features({}), None, float(good.mean()) if len(good) else 0.5)
    features = tm.Features(tm.choose_terms(texts, good, terms))
    return TextModel(features, tm.fit(features.matrix(texts), good, weights))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def url_path(url: Column) -> Column:
    """The first level of a URL's path."""
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^/?#]*)", 1)


def text_scores(docs: DataFrame, model: TextModel, host: str, path: str, key: str = "doc_id") -> DataFrame:
    """(key, host, path, p_text) of all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                p = model.predict([t or b"" for t in some.column(3).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(3)), pa.array(np.clip(p, 1e-6, 1 - 1e-6))], [key, "host", "path", "p_text"])

    kind = docs.schema[key].dataType.simpleString()
    columns = docs.select(F.col(key), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col("text").cast("string"))
    return columns.mapInArrow(released(run), f"{key} {kind}, host string, path string, p_text double")


def _strength(groups: DataFrame, mean: Column, spread: Column) -> float:
    """Pseudo-counts of groups (n, s) around ``mean``: from the variance of their means beyond what chance gives.

    spread: the variance of one document within its group, summed over documents.
    """
    n = F.col("n")
    got = groups.agg(
        F.sum(n).alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum(n * (F.col("s") / n - mean) ** 2).alias("between"),
        F.sum(spread).alias("within"),
        F.sum(n * mean * (1 - mean)).alias("all"),
    ).first()
    if not got["n"] or got["k"] < 2:
        return 100.0
    within = got["within"] / got["n"]
    excess = got["between"] / got["n"] - within * got["k"] / got["n"]
    return float(min(1e6, max(1.0, got["all"] / got["n"] / excess))) if excess > 1e-12 else 1e6


def site_posteriors(scores: DataFrame) -> tuple[DataFrame, float, float, float]:
    """(host, path, n, s, host_n, host_s, host_mean) of all paths, the pseudo-counts below a host and below the whole, and the global mean."""
    paths = staged(
        scores.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p_text").alias("s"), F.sum(F.col("p_text") ** 2).alias("ss")), "paths"
    )
    hosts = staged(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(min(1 - 1e-6, max(1e-6, total["s"] / total["n"]))) if total["n"] else 0.5
    spread = F.col("ss") - F.col("s") ** 2 / F.col("n")
    per_host = _strength(hosts, F.lit(mean), spread)
    means = hosts.select(
        F.col("host").alias("_host"), F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + per_host * mean) / (F.col("n") + per_host)).alias("host_mean")
    )
    joined = staged(paths.join(means, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"), "path-means")
    return joined, _strength(joined, F.col("host_mean"), spread), per_host, mean


def grade(docs: DataFrame, model: TextModel, host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """(doc_id, host, path, p_text, p_host, p_path, p_good, keep) of all documents.

    host, path: columns of ``docs``; ``url_host`` and ``url_path`` make them of URLs.
    """
    scores = staged(text_scores(docs, model, host, path), "text-scores")
    paths, strength, per_host, mean = site_posteriors(scores)
    paths = paths.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "n", "s", "host_n", "host_s")
    joined = scores.join(paths, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    joined = joined.withColumn("p_host", inside((F.col("host_s") - F.col("p_text") + per_host * mean) / (F.col("host_n") - 1 + per_host)))
    site = (F.col("s") - F.col("p_text") + strength * F.col("p_host")) / (F.col("n") - 1 + strength)
    joined = joined.withColumn("p_path", inside(site))
    odds = lambda c: c / (1 - c)
    final = odds(F.col("p_text")) / (mean / (1 - mean)) * odds(F.col("p_path"))
    joined = joined.withColumn("p_good", final / (1 + final))
    return joined.select("doc_id", "host", "path", "p_text", "p_host", "p_path", "p_good", (F.col("p_good") >= threshold).alias("keep"))
