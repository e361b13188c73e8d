"""Features and linear models that the document classifiers share.

Models are fitted in the driver on a bounded sample of labelled rows (the bound is a parameter of
the operators) and applied to all rows in the executors.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lower-cases ASCII letters and turns ASCII punctuation and controls into spaces; other bytes stay.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b for b in range(256))
#: Byte classes whose shares of a text are features.
_CLASSES = [b" \t\r\n\v\f", b"\n", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"|", b"#$%&*", b".,;:", bytes(range(128, 256))]
_SHARES = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES):
    _SHARES[list(_c), _i] = 1


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def terms_of(words: set[bytes]) -> set[bytes]:
    """Words and their first four and five bytes, which inflected forms share."""
    return words.union(*({w[:k] + b"*" for w in words} for k in (4, 5)))


@dataclass
class Features:
    """Byte-class shares, word statistics and the presence of chosen terms (words and word beginnings)."""

    terms: dict[bytes, int]

    @property
    def size(self) -> int:
        return len(_CLASSES) + 4 + len(self.terms)

    def row(self, text: bytes) -> np.ndarray:
        out = np.zeros(self.size)
        n = len(_CLASSES)
        if text:
            counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            out[:n] = np.sqrt(counts @ _SHARES / len(text))
            words = words_of(text)
            own = set(words)
            out[n] = np.log1p(len(words))
            out[n + 1] = len(own) / (len(words) + 1)
            out[n + 2] = len(text) / (len(words) + 1) / 10
            hits = terms_of(own) & self.terms.keys() if self.terms else ()
            out[n + 3] = np.log1p(len(hits))
            for w in hits:
                out[n + 4 + self.terms[w]] = 1
        return out

    def matrix(self, texts: list[bytes]) -> np.ndarray:
        return np.array([self.row(t) for t in texts]).reshape(len(texts), self.size)


def _best_terms(yes: Counter, no: Counter, n1: int, n0: int, most: int) -> list[bytes]:
    """The terms that tell two classes of ``n1`` and ``n0`` documents apart best by a two-proportion score, ties by term.

    Of terms with one beginning and equal counts, which the same documents hold, one stays.
    """
    n1, n0, scored = max(1, n1), max(1, n0), []
    for w in yes.keys() | no.keys():
        a, b = yes[w], no[w]
        if a + b < LEAST:
            continue
        p = (a + b + 1) / (n1 + n0 + 2)
        scored.append((-abs(a / n1 - b / n0) / (p * (1 - p) * (1 / n1 + 1 / n0)) ** 0.5, w, (w[:4], a, b)))
    chosen: dict[tuple, bytes] = {}
    for _, w, same in sorted(scored):
        chosen.setdefault(same, w)
        if len(chosen) >= most:
            break
    return list(chosen.values())


#: Documents that a term must be in to be chosen.
LEAST = 4


def _frequent(texts: list[bytes]) -> set[bytes]:
    """The terms that are in enough texts; the others, which are most, are not counted by class."""
    total: Counter = Counter()
    for t in texts:
        total.update(terms_of(set(words_of(t))))
    return {w for w, n in total.items() if n >= LEAST}


def _counts(texts: list[bytes], y: np.ndarray, frequent: set[bytes]) -> tuple[Counter, Counter]:
    yes, no = Counter(), Counter()
    for t, v in zip(texts, y.tolist(), strict=True):
        (yes if v else no).update(terms_of(set(words_of(t))) & frequent)
    return yes, no


def choose_terms(texts: list[bytes], y: np.ndarray, most: int) -> dict[bytes, int]:
    """The terms that tell the two classes apart best."""
    best = _best_terms(*_counts(texts, y, _frequent(texts)), int(y.sum()), int(len(y) - y.sum()), most)
    return {w: i for i, w in enumerate(best)}


def fold_matrices(texts: list[bytes], y: np.ndarray, most: int, k: int) -> list[np.ndarray]:
    """The features of all texts for each of ``k`` folds, with terms chosen without the texts of that fold."""
    fold = folds(len(texts), k)
    frequent = _frequent(texts)
    own = [_counts([t for t, g in zip(texts, fold.tolist(), strict=True) if g == f], y[fold == f], frequent) for f in range(k)]
    yes, no = sum((c[0] for c in own), Counter()), sum((c[1] for c in own), Counter())
    chosen = []
    for f in range(k):
        n1 = int(y[fold != f].sum())
        chosen.append(_best_terms(yes - own[f][0], no - own[f][1], n1, int((fold != f).sum()) - n1, most))
    union = Features({w: i for i, w in enumerate(dict.fromkeys(w for c in chosen for w in c))})
    x, first = union.matrix(texts), union.size - len(union.terms)
    out = []
    for terms in chosen:
        columns = x[:, [first + union.terms[w] for w in terms]]
        out.append(np.c_[x[:, : first - 1], np.log1p(columns.sum(axis=1)), columns])
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights)


def fit(x: np.ndarray, y: np.ndarray, sample_weights: np.ndarray, penalty: float = 2.0, rounds: int = 12) -> Linear:
    """Logistic regression with a ridge penalty, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.05
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(z @ w)
        s = sample_weights * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z * s[:, None]).T @ z + np.diag(ridge), z.T @ (sample_weights * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return Linear(mean, scale, w)


def folds(n: int, k: int) -> np.ndarray:
    """The fold of each of ``n`` rows, which come in a seeded order."""
    return np.arange(n) % k


def out_of_fold(matrices: list[np.ndarray], y: np.ndarray, sample_weights: np.ndarray) -> np.ndarray:
    """Each row's probability by a model that was fitted without its fold, on that fold's matrix of features."""
    out, fold = np.full(len(y), y.mean() if len(y) else 0.0), folds(len(y), len(matrices))
    for f, x in enumerate(matrices):
        train = fold != f
        if train.any() and not train.all() and y[train].min() < y[train].max():
            out[~train] = fit(x[train], y[train], sample_weights[train]).predict(x[~train])
    return out


def threshold(p: np.ndarray, y: np.ndarray, sample_weights: np.ndarray) -> float:
    """The threshold of the best F1 on out-of-fold probabilities, in the middle of its gap."""
    order = np.argsort(-p, kind="stable")
    q, v, w = p[order], y[order], sample_weights[order]
    hit, all_ = np.cumsum(v * w), np.cumsum(w)
    score = 2 * hit / (all_ + (y * sample_weights).sum() + 1e-9)
    last = np.concatenate([q[1:] != q[:-1], [True]])
    i = int(np.argmax(np.where(last, score, -1)))
    return float((q[i] + (q[i + 1] if i + 1 < len(q) else 0.0)) / 2)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int, most_bytes: int = 1 << 16) -> tuple[list[bytes], np.ndarray, np.ndarray, list]:
    """(texts, labels, weights, label rows) of at most ``most`` labelled documents of at most ``most_bytes``, in a seeded order.

    Up to half are positive rows, the least by a hash of their id; weights restore the shares of the classes.
    A document with several labels takes the greatest, one with several texts the least.
    """
    value = [c for c in labels.columns if c != "doc_id"]
    rows = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in value])
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    totals = {bool(r["y"]): r["n"] for r in rows.groupBy((F.col(column) > 0).alias("y")).count().withColumnRenamed("count", "n").collect()}
    parts = [rows.filter(F.col(column) > 0).orderBy(*order).limit(most // 2), rows.filter(F.col(column) <= 0).orderBy(*order).limit(most // 2)]
    picked = parts[0].unionByName(parts[1])
    # at most ``most`` ids go out and as many texts of bounded size come back
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= most_bytes)
    texts = texts.join(F.broadcast(picked.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    got = sorted(texts.join(picked, "doc_id").collect(), key=lambda r: ((r["doc_id"] * 2654435761) % 4294967296, r["doc_id"]))
    y = np.array([float(r[column] > 0) for r in got])
    n = {v: max(1, int((y == v).sum())) for v in (0.0, 1.0)}
    weights = np.array([totals.get(bool(v), 1) / n[v] for v in y.tolist()])
    weights *= len(y) / max(weights.sum(), 1e-9) if len(y) else 1
    return [r["text"].encode() for r in got], y, weights, got
