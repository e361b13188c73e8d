"""Whitening of integer vectors by singular values of a bidiagonal matrix.

1. Distinct vectors are counted and summed exactly: the fit list with n rows and sums S.
2. Blockwise QR: every task reduces its centred rows x - S / n to one upper triangle, block by block; triangles are
   stacked and reduced again, a few at a time, until one is left. Only triangles of d x d numbers ever move.
3. The last triangle is made bidiagonal by Householder reflections; the dqds algorithm gives the singular values of the
   bidiagonal matrix to high relative accuracy, so none is formed from squared, cancelling sums.
4. Each direction comes from a twisted factorisation of B'B - s^2 at the place where its twist is least, is put at right
   angles to its neighbours of near singular values, and is carried back through the reflections.

Defined results: rows whose vector is null or holds null or non-finite entries are left out; shorter vectors count as if zeros
followed; repeated rows give repeated rows, but count once in the fit; entries beyond 64 bits become the nearest such integer.
An empty table gives no rows. A component without variance, as all are where the fit list has one vector, has ``whitened``
null and ``explained`` 0 and is left out of ``identity_error`` (null if there is none). ``deviation`` is null where it passes 64
bits; ``deviation_digits`` has all its digits. Columns beside the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import dropped, released, staged

#: Rows of a block of the QR reduction, and triangles that one task stacks.
ROWS, FAN_IN = 1 << 10, 32
#: Singular values nearer than this part of the larger have their directions put at right angles.
NEAR = 1e-3
EPS = np.finfo(float).eps


def quantized(vector: Column) -> Column:
    """Every entry c as floor(256 * c) in 64 bits; null where the vector is null or holds a null or non-finite entry."""
    most = float(1 << 63)

    def entry(c: Column) -> Column:
        scaled = F.floor(F.lit(256.0) * c.cast("double"))
        over, under = F.lit((1 << 63) - 1), F.lit(-(1 << 63))
        return F.when(c.cast("double") * 256.0 >= most, over).when(c.cast("double") * 256.0 < -most, under).otherwise(scaled)

    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(sound, F.transform(vector, entry))


# bidiagonal matrices


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(d, e, reflections): U' r V is upper bidiagonal with diagonal d and superdiagonal e; V is the product of the reflections."""
    a = np.array(r, float)
    n = a.shape[1]
    right = []
    for k in range(n):
        x = a[k:, k].copy()
        _reflect(x)
        if x.any():
            a[k:, k:] -= 2 * np.outer(x, x @ a[k:, k:])
        if k < n - 2:
            x = a[k, k + 1 :].copy()
            _reflect(x)
            if x.any():
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ x, x)
            right.append((k + 1, x))
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflect(x: np.ndarray) -> None:
    """Turn x into the unit normal of the reflection that sends it to a multiple of the first axis; zero if it lies there."""
    big = np.abs(x).max(initial=0.0)
    if len(x) < 2 or not np.abs(x[1:]).max() > 0:
        x[:] = 0
        return
    x /= big
    x[0] += np.copysign(np.sqrt(x @ x), x[0])
    x /= np.sqrt(x @ x)


def dqds(d: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The singular values of an upper bidiagonal matrix, falling: differential quotient-difference steps with shifts.

    A step with shift s turns qd arrays of B'B into those of B'B - s with positive operations only, which keeps every value's
    leading digits. A shift that turns out too large shows as a negative number, and the step is done again with a smaller one.
    """
    big = max(np.abs(d).max(initial=0.0), np.abs(e).max(initial=0.0))
    if not big > 0:
        return np.zeros(len(d))
    q, low = ((d / big) ** 2).tolist(), ((e / big) ** 2).tolist()
    found = []
    blocks = [(q, low, 0.0)]
    while blocks:
        q, e2, shift = blocks.pop()
        tries = 0
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + shift)
                break
            # where an off-diagonal entry vanishes beside what it couples, the matrix falls apart
            cut = next((i for i in range(n - 2, -1, -1) if e2[i] <= (0.1 * EPS) ** 2 * (q[i] + q[i + 1] + shift) or e2[i] < 1e-300), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e2[:cut], shift))
                q, e2 = q[cut + 1 :], e2[cut + 1 :]
                tries = 0
                continue
            if n > 1 and q[0] < q[-1]:
                # the reversed matrix has the same singular values, and the small one at its end
                q, e2 = _flipped(q, e2)
            s = _shift(q, e2) if tries < 30 else 0.0
            step = _dqds_step(q, e2, s)
            while step is None:
                s = s / 4 if s > 1e-300 else 0.0
                step = _dqds_step(q, e2, s)
            q, e2 = step
            shift += s
            tries += 1
            if tries > 60 * n:
                raise ArithmeticError("singular values do not converge")
    return big * np.sqrt(np.sort(np.maximum(found, 0.0))[::-1])


def _flipped(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """qd arrays of the matrix read from its other end."""
    return q[::-1], e[::-1]


def _shift(q: list[float], e: list[float]) -> float:
    """A bound below on the least eigenvalue that comes near it: of the last two rows, less what the third may take."""
    a, b, c = q[-2] + (e[-2] if len(q) > 2 else 0.0), q[-2] * e[-1], q[-1] + e[-1]
    half = (a - c) / 2
    root = (half * half + b) ** 0.5
    least = c - b / (abs(half) + root) if half >= 0 and abs(half) + root > 0 else c - abs(half) - root if half < 0 else c
    return max(0.0, 0.98 * least)


def _dqds_step(q: list[float], e: list[float], s: float) -> tuple[list[float], list[float]] | None:
    """One step; None if the shift passed the least eigenvalue."""
    d, out_q, out_e = q[0] - s, [], []
    for i in range(len(e)):
        if d < 0:
            return None
        x = d + e[i]
        if x <= 0:
            return None
        t = q[i + 1] / x
        out_q.append(x)
        out_e.append(e[i] * t)
        d = d * t - s
    if d < 0:
        return None
    return [*out_q, d], out_e


def twisted(d: np.ndarray, e: np.ndarray, value: float, avoid: list[np.ndarray]) -> np.ndarray:
    """The unit right singular vector of an upper bidiagonal matrix for the singular value ``value``.

    B'B - value^2 is factorised from the top (stationary qd) and from the bottom (progressive qd); where both meet with
    the least twist, the solution of the twisted system is the vector. ``avoid`` are vectors of near values.
    """
    n = len(d)
    lam = value * value
    if n == 1:
        return np.ones(1)
    tiny = max(EPS * lam * 1e-3, 1e-300)
    a = d * d
    a[1:] += e * e  # diagonal of B'B, only for the last refinement
    b = d[:-1] * e
    # L D L' of B'B is (d^2, e / d); s holds what the shift leaves of the stationary transform, p of the progressive one
    s, plus, lower = np.empty(n), np.empty(n), np.empty(n - 1)
    s[0] = -lam
    for i in range(n - 1):
        plus[i] = s[i] + d[i] * d[i]
        if abs(plus[i]) < tiny:
            plus[i] = -tiny
        lower[i] = b[i] / plus[i]
        s[i + 1] = lower[i] * e[i] / d[i] * s[i] - lam if d[i] else e[i] * e[i] - lam - lower[i] * b[i]
    plus[-1] = s[-1] + d[-1] * d[-1]
    p, upper = np.empty(n), np.empty(n - 1)
    p[-1] = d[-1] * d[-1] - lam
    for i in range(n - 2, -1, -1):
        minus = e[i] * e[i] + p[i + 1]
        if abs(minus) < tiny:
            minus = -tiny
        upper[i] = b[i] / minus
        p[i] = p[i + 1] * d[i] * d[i] / minus - lam
    gamma = s + p + lam
    kept = None
    for r in np.argsort(np.abs(gamma), kind="stable")[: 1 if not avoid else n]:
        z = np.zeros(n)
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -lower[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -upper[i] * z[i]
        z /= np.sqrt(z @ z)
        for _ in range(2):
            for v in avoid:
                z -= (v @ z) * v
        size = np.sqrt(z @ z)
        kept = z / size if size > 0 else kept
        if size > 0.1:
            break
    if avoid:  # steps of inverse iteration at right angles to the neighbours
        for _ in range(3):
            z = _solve(a, b, lam, kept)
            for _ in range(2):
                for v in avoid:
                    z -= (v @ z) * v
            kept = z / np.sqrt(z @ z)
    return kept


def _solve(a: np.ndarray, b: np.ndarray, lam: float, y: np.ndarray) -> np.ndarray:
    """x with (T - lam) x = y for a tridiagonal T of diagonal a and off-diagonal b, with row exchanges."""
    n = len(a)
    small = EPS * max(float(np.abs(a).max()), float(np.abs(b).max(initial=0)), 1e-290)
    main, up, up2, x = a - lam, np.append(b, 0.0), np.zeros(n), y.copy()
    for i in range(n - 1):
        low = b[i]
        if abs(main[i]) >= abs(low):
            f = low / (main[i] if abs(main[i]) > small else small)
            main[i + 1] -= f * up[i]
            x[i + 1] -= f * x[i]
        else:
            f = main[i] / low
            main[i], main[i + 1], up[i], up2[i] = low, up[i] - f * main[i + 1], main[i + 1], up[i + 1]
            up[i + 1] = -f * up[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
    for i in range(n - 1, -1, -1):
        t = x[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (up2[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = t / (main[i] if abs(main[i]) > small else small)
    return x / max(np.abs(x).max(), 1e-290)


def directions(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the k largest singular values of a triangle and, as rows, their right singular vectors."""
    d, e, right = bidiagonal(r)
    n = len(d)
    values = dqds(d, e)
    k = min(k, n)
    big = values[0] if n else 0.0
    e = np.where(np.abs(e) <= EPS * big, 0.0, e)
    # blocks between vanishing entries have directions of their own
    bounds = [0, *(np.flatnonzero(e == 0) + 1).tolist(), n]
    owned = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        owned += [(v, lo, hi) for v in dqds(d[lo:hi], e[lo : hi - 1])]
    owned.sort(key=lambda x: -x[0])
    out: list[np.ndarray] = []
    for i, (v, lo, hi) in enumerate(owned[:k]):
        near = [out[j][lo:hi] for j in range(i) if owned[j][1] == lo and owned[j][0] - v <= NEAR * owned[j][0]]
        z = np.zeros(n)
        if v > EPS * big:
            z[lo:hi] = twisted(d[lo:hi], e[lo : hi - 1], v, near)
        out.append(z)
    vectors = np.array(out).reshape(k, n)
    for at, x in reversed(right):
        vectors[:, at:] -= 2 * np.outer(vectors[:, at:] @ x, x)
    return np.array([v for v, *_ in owned[:k]]), vectors


# passes over the rows


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as integers, zeros after shorter ones."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: as 64-bit integers where they fit, else as Python's."""
    most = max(int(np.abs(x.astype(float)).max(initial=0)), 1) * n + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, rounded once."""
    y = _offsets(x, n, sums)
    return (y / n).astype(float)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums of (n * x - S)^2 of each row."""
    y = _offsets(x, n, sums)
    most = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) if y.size else 0
    if most * most * max(y.shape[1], 1) >= 1 << 63:
        y = y.astype(object)
    return [int(v) for v in (y * y).sum(axis=1)]


def _triangle(blocks: Iterator[np.ndarray], width: int) -> np.ndarray:
    r = np.zeros((0, width))
    for b in blocks:
        r = np.linalg.qr(np.concatenate([r, b]), mode="r")
    return np.concatenate([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def triangle(vectors: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR decomposition of all centred rows of ``vectors`` (x), reduced block by block and then triangle by triangle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (centred(_matrix(b.column(0).slice(at, ROWS), width), n, sums) for b in batches for at in range(0, b.num_rows, ROWS))
        r = _triangle(parts, width)
        if r.any():
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (np.frombuffer(x.as_buffer(), float).reshape(width, width) for b in batches for x in b.column(0))
        r = _triangle(parts, width)
        if r.any():
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    held = staged(vectors.select("x").mapInArrow(released(rows), "r binary"), "triangles")
    count = held.count()
    while count > 1:
        fewer = held.repartition(-(-count // FAN_IN)).mapInArrow(released(stack), "r binary")
        after = staged(fewer, "triangles")
        dropped(held)
        held, count = after, after.count()
    last = held.first()
    dropped(held)
    return np.frombuffer(bytes(last["r"]), float).reshape(width, width) if last else np.zeros((width, width))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(x) of every different vector once, of ``rows`` (x); zeros at the end do not make vectors different."""
    filled = F.size("x") - F.coalesce(F.array_position(F.transform(F.reverse("x"), lambda v: v != 0), True), F.size("x") + 1).cast("int") + 1
    return rows.select(F.slice("x", 1, filled).alias("x")).distinct()


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, deviation_digits) of each sound row and component.

    Components are numbered from 1 by falling variance; there are no more than dimensions.
    """
    spark = rows.sparkSession
    sound = rows.select(F.col(key), quantized(F.col(vector)).alias("x")).filter("x is not null")
    fit = staged(distinct_vectors(sound), "vectors")
    width = sound.agg(F.max(F.size("x"))).first()[0] or 0
    n = fit.count()
    entries = fit.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
    found = {r["dim"]: int(r["s"]) for r in entries}
    sums = [found.get(i, 0) for i in range(width)]
    r = triangle(fit, width, n, sums) if width and n else np.zeros((width, width))
    values, vectors = directions(r, components) if width else (np.zeros(0), np.zeros((0, 0)))
    variance = values * values / max(n, 1)
    trace = float((r * r).sum()) / max(n, 1)
    live = values > EPS * max(values[:1].sum(), 0.0) * max(width, 1)
    scale = np.where(live, np.sqrt(np.where(live, variance, 1.0)), 1.0)
    axes = vectors / scale[:, None] if len(values) else vectors
    error = _identity_error(fit, width, n, sums, axes[live]) if live.any() else None
    dropped(fit)
    k = len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            x = _matrix(b.column(1), width)
            exact = deviations(x, n, sums)
            w = centred(x, n, sums) @ axes.T
            own = np.repeat(np.arange(len(x)), k)
            at = pa.array(own)
            fits = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            mask = ~np.tile(live, len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(own), n)),
                    fits.take(at),
                    pa.array(w.reshape(-1), mask=mask),
                    pa.array(np.tile(np.where(live, variance / (trace or 1.0), 0.0), len(x))),
                    pa.array(np.full(len(own), 0.0 if error is None else error), mask=np.full(len(own), error is None)),
                    pa.array([str(v) for v in exact]).take(at),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"],
            )

    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
    if not k:
        return spark.createDataFrame([], schema)
    return sound.mapInArrow(released(project), schema)


def _identity_error(fit: DataFrame, width: int, n: int, sums: list[int], axes: np.ndarray) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity, measured on the rows."""
    k = len(axes)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = centred(_matrix(b.column(0), width), n, sums) @ axes.T
            first += w.sum(axis=0)
            second += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k)), pa.array(np.concatenate([first, second.reshape(-1)]))], ["at", "v"])

    got = {r["at"]: r["v"] for r in fit.mapInArrow(released(moments), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([got[i] for i in range(k)]) / n
    second = np.array([got[k + i] for i in range(k * k)]).reshape(k, k) / n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
