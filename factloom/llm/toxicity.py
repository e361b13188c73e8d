"""Toxicity by a chain of classifiers.

The chain predicts categories one after another: toxic junk (a toxic text of low quality), toxic prose (a toxic text
of good quality) and toxic. All three are defined by the labels alone. Each is a logistic
model of the text's features and of the probabilities of the categories before it; in training these
are out-of-fold predictions, so a later model sees what it will see on new texts; the telling terms among the
features are chosen anew without each fold. The last
probability decides; its threshold has the best F1 on out-of-fold predictions.

Training reads at most ``max_train`` labelled documents; with no positive or no negative label all
probabilities are 0 or 1 of the class that is there (0 without labels). Where labels tell no quality, the first two
categories have no positive rows and the probability 0.

Defined results: a null text is an empty one; repeated rows stay and score alike; an empty table
gives no rows; other columns are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm import textmodel as tm
from factloom.llm.common import released

CATEGORIES = ("toxic_junk", "toxic_prose", "toxic")


@dataclass
class Chain:
    features: tm.Features
    models: list
    threshold: float
    constant: float | None = None

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """A column of probabilities for each category."""
        if self.constant is not None:
            return np.full((len(texts), len(CATEGORIES)), self.constant)
        x, out = self.features.matrix(texts), []
        for model in self.models:
            p = model if isinstance(model, float) else model.predict(np.c_[x, np.array(out).T] if out else x)
            out.append(np.full(len(texts), p) if isinstance(p, float) else p)
        return np.array(out).T.reshape(len(texts), len(CATEGORIES))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 6000, terms: int = 128, k: int = 5) -> Chain:
    """Fit the chain on at most ``max_train`` rows of ``labels`` (doc_id, quality, toxic)."""
    texts, toxic, weights, rows = tm.labelled_sample(docs, labels, "toxic", max_train)
    if not len(toxic) or toxic.min() == toxic.max():
        return Chain(tm.Features({}), [], 0.5, float(toxic.max(initial=0)))
    features = tm.Features(tm.choose_terms(texts, toxic, terms))
    x, folded = features.matrix(texts), tm.fold_matrices(texts, toxic, terms, k)
    quality = [r["quality"] if "quality" in r else None for r in rows]
    junk = toxic * np.array([float(q is not None and q <= 0) for q in quality])
    prose = toxic * np.array([float(q is not None and q > 0) for q in quality])
    models, before = [], []
    for y in (junk, prose, toxic):
        if y.min() == y.max():
            models.append(float(y.max()))
            before.append(np.full(len(y), y.max()))
            continue
        with_before = lambda m: np.c_[m, np.array(before).T] if before else m
        models.append(tm.fit(with_before(x), y, weights))
        before.append(tm.out_of_fold(list(map(with_before, folded)), y, weights))
    return Chain(features, models, tm.threshold(before[-1], toxic, weights))


def score(docs: DataFrame, chain: Chain, key: str = "doc_id") -> DataFrame:
    """(key, a probability ``p_`` for each of ``CATEGORIES``, toxic) of all whole texts."""
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                p = chain.predict([t or b"" for t in some.column(1).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), *map(pa.array, p.T.copy()), pa.array(p[:, -1] >= chain.threshold)], [key, *names, "toxic"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(released(run), f"{key} {kind}, {', '.join(f'{n} double' for n in names)}, toxic boolean")


def keep_clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs``, all columns, that the chain does not call toxic."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some = b.slice(i, 256)
                p = chain.predict([t or b"" for t in some.column(at).cast(pa.binary()).to_pylist()])
                yield some.filter(pa.array(p[:, -1] < chain.threshold))

    return docs.mapInArrow(released(run), docs.schema)
