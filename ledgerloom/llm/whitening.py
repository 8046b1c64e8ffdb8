"""Whitening of embeddings by a bidiagonal qd solver.

Vectors become integers x = floor(1024 c) + 100000, so that counts, sums and squared
deviations are exact. Tasks reduce their centred rows block by block to one triangle R by
QR; triangles of ``FAN`` tasks at a time are stacked and reduced again until few are left,
so no task or driver ever holds rows: what travels is d x d numbers a task. R, d x d
whatever the number of rows, is brought to bidiagonal form by Householder reflections;
dqds finds its singular values to high relative accuracy, a twisted factorisation of the
bidiagonal's normal matrix the direction of each, and the reflections turn it back.
Projection of the rows, and the check that their covariance is the identity, are Spark
passes again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Partial results that one task merges.
FAN = 32
#: Entries from here on have no long x.
LIMIT = 2.0**62 / SCALE
EPS = np.finfo(np.float64).eps
#: Eigenvalues closer than this share of themselves count as one cluster.
CLUSTER = 1e-6


# ------------------------------------------------------------------ singular values and vectors


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Householder vector of x (first entry 1) and its factor."""
    top = np.abs(x).max() if len(x) else 0.0
    if top == 0.0:
        return np.zeros_like(x), 0.0
    y = x / top
    norm = np.sqrt(y @ y)
    head = y[0] + np.copysign(norm, y[0])
    v = y / head
    v[0] = 1.0
    return v, 2.0 / (v @ v)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right transform V of U' r V, upper bidiagonal, for a square r."""
    a, d = np.array(r, np.float64), r.shape[0]
    right = np.eye(d)
    for k in range(d):
        v, f = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(f * v, v @ a[k:, k:])
        if k < d - 2:
            v, f = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, f * v)
            right[:, k + 1 :] -= np.outer(right[:, k + 1 :] @ v, f * v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential quotient-difference transform with a shift: new q and e, and the d of each step."""
    d, seen, qs, es = q[0] - shift, [], [], []
    seen.append(d)
    for k in range(len(e)):
        top = d + e[k]
        ratio = q[k + 1] / top if top else 0.0
        qs.append(top)
        es.append(e[k] * ratio)
        d = d * ratio - shift
        seen.append(d)
    qs.append(d)
    return qs, es, seen


def singular_values_squared(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of a bidiagonal's singular values, falling, by dqds.

    The shift is a lower bound of the least eigenvalue, from the trace of the inverse that
    an unshifted transform gives; a bolder one, near the least of its d, is tried first and
    given up where a d turns negative.
    """
    work = [([x * x for x in diagonal.tolist()], [x * x for x in above.tolist()], 0.0)]
    found: list[float] = []
    while work:
        q, e, total = work.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(total + q[0])
                break
            cut_at = next((k for k in range(n - 2, -1, -1) if e[k] <= (EPS / 4) ** 2 * (q[k] + q[k + 1]) or e[k] <= (EPS / 4) * total), None)
            if cut_at is not None:
                work.append((q[: cut_at + 1], e[:cut_at], total))
                q, e = q[cut_at + 1 :], e[cut_at + 1 :]
                continue
            if q[0] < 1.5 * q[-1]:  # graded the other way round
                q, e = q[::-1], e[::-1]  # reversed rows and columns, transposed: upper bidiagonal again
            q0, e0, d = _dqds(q, e, 0.0)
            least = min(d)
            if least <= 0.0:
                q, e = q0, e0
                continue
            safe = 1.0 / sum(1.0 / x for x in d)
            for shift in (least * (1 - 1e-3), 0.5 * (least + safe), safe * (1 - 4 * n * EPS)):
                q1, e1, d1 = _dqds(q, e, shift)
                if min(d1) >= 0.0:
                    q, e, total = q1, e1, total + shift
                    break
            else:
                q, e = q0, e0
    return np.sort(np.array(found))[::-1]


def _twisted(dg: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers from the top and from the bottom of L D L' - value, and gamma of each twist."""
    n, tiny = len(dg), np.finfo(np.float64).tiny ** 0.5
    down, up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    s, p = np.zeros(n), np.zeros(n)
    s[0] = -value
    for k in range(n - 1):
        top = s[k] + dg[k]
        top = top if abs(top) > tiny else tiny
        down[k] = dg[k] * low[k] / top
        s[k + 1] = down[k] * low[k] * s[k] - value
    p[n - 1] = dg[n - 1] - value
    for k in range(n - 2, -1, -1):
        bottom = dg[k] * low[k] ** 2 + p[k + 1]
        bottom = bottom if abs(bottom) > tiny else tiny
        t = dg[k] / bottom
        up[k] = low[k] * t
        p[k] = p[k + 1] * t - value
    return down, up, s + p + value


def right_vectors(diagonal: np.ndarray, above: np.ndarray, squares: np.ndarray, most: int) -> np.ndarray:
    """Unit right singular vectors, as columns, of the ``most`` largest squared values, which are positive.

    Vectors of a cluster take different twists and are made orthogonal to each other.
    """
    n = len(diagonal)
    floor = EPS * np.sqrt(squares[0])
    a = np.where(np.abs(diagonal) > floor * EPS, diagonal, floor * EPS)
    dg, low = a * a, above / a[:-1]
    out = np.zeros((n, most))
    for j in range(most):
        value = squares[j]
        peers = [i for i in range(j) if squares[i] - value <= CLUSTER * squares[i]]
        down, up, gamma = _twisted(dg, low, value)
        for k in np.argsort(np.abs(gamma), kind="stable"):
            z = np.zeros(n)
            z[k] = 1.0
            for i in range(k - 1, -1, -1):
                z[i] = -down[i] * z[i + 1]
            for i in range(k, n - 1):
                z[i + 1] = -up[i] * z[i]
            z /= np.linalg.norm(z)
            for _ in range(2):
                for i in peers:
                    z -= out[:, i] * (out[:, i] @ z)
            rest = np.linalg.norm(z)
            if rest > 0.1:
                break
        out[:, j] = z / max(rest, np.finfo(np.float64).tiny)
    return out


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of a square r, falling, and its first right singular vectors as columns.

    Values under d * eps of the largest (or zero) have no direction. The entry of largest
    size of each vector is positive.
    """
    top = np.abs(r).max() if r.size else 0.0
    if top == 0.0:
        return np.zeros(r.shape[0]), np.zeros((r.shape[0], 0))
    diagonal, above, right = bidiagonalise(r / top)
    squares = singular_values_squared(diagonal, above)
    most = min(most, int((squares > (len(squares) * EPS) ** 2 * squares[0]).sum()))
    v = right @ right_vectors(diagonal, above, squares, most)
    v *= np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return squares * top * top, v


# ------------------------------------------------------------------ passes over the vectors


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key``, ``c`` (array<double>): rows whose vector isn't null, isn't empty, holds only finite entries that have a long x."""
    c = F.col(vector).cast("array<double>")
    bad = F.exists("c", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) >= F.lit(LIMIT)), F.lit(True)))
    return df.select(F.col(key).alias("_key"), c.alias("c")).where(F.col("c").isNotNull() & (F.size("c") > 0)).where(~bad)


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) * SCALE).astype(np.int64) + SHIFT


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as 64-bit integers, or as Python's where these could overflow."""
    if n * max(int(np.abs(x).max(initial=0)), SHIFT) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(dev: np.ndarray) -> list[int | None]:
    """Sum of squares of each row; beyond what a long holds: None."""
    top = int(max(abs(int(dev.max(initial=0))), abs(int(dev.min(initial=0)))))
    if top * top * max(dev.shape[1], 1) < 2**63:
        d = dev.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = (dev.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def _reduce(parts: DataFrame, merge) -> bytes:
    """The one payload of ``parts`` (``p`` long, ``payload`` binary, a row a task), merged ``FAN`` at a time."""

    def group(_, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("p")
        return pd.DataFrame({"p": [int(d["p"].iloc[0]) // FAN], "payload": [merge(list(d["payload"]))]})

    while parts.count() > FAN:
        parts = cut(parts.groupBy(F.floor(F.col("p") / FAN).alias("g")).applyInPandas(group, "p long, payload binary"))
    return merge([r["payload"] for r in parts.orderBy("p").collect()])  # at most FAN rows of a d x d array


def _triangle(stack: np.ndarray) -> np.ndarray:
    return np.linalg.qr(stack, mode="r") if len(stack) > stack.shape[1] else stack


def _partials(vectors: DataFrame, step, close) -> DataFrame:
    """A payload a task: ``step(state, batch's c)`` over its batches, then ``close``; tasks without rows give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = None
        for b in batches:
            if b.num_rows:
                state = step(state, b.column("c"))
        if state is not None:
            yield pa.RecordBatch.from_pydict({"p": pa.array([TaskContext.get().partitionId()], pa.int64()), "payload": pa.array([close(state)], pa.binary())})

    return cut(vectors.select("c").mapInArrow(run, "p long, payload binary"))


def fit(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> dict | None:
    """Count, exact sums, eigenvalues (falling) and directions (columns) of the usable vectors; none: None.

    All usable vectors must have one length; otherwise those of the most frequent length,
    ties the larger, are used, here and in ``whiten``.
    """
    good = usable(df, key, vector)
    sizes = good.groupBy(F.size("c").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return None
    d, n = sizes["d"], sizes["n"]
    good = good.where(F.size("c") == d)

    def add(state, column):
        x = _matrix(column, d)
        total = (x.astype(object) if np.abs(x).max() >= 2**40 else x).sum(axis=0)  # so that no sum of a batch overflows
        return [a + int(b) for a, b in zip(state or [0] * d, total, strict=True)]

    def close_sums(state):
        return ",".join(map(str, state)).encode()

    def merge_sums(payloads):
        return close_sums([sum(c) for c in zip(*[[int(v) for v in bytes(p).split(b",")] for p in payloads], strict=True)])

    sums = [int(v) for v in _reduce(_partials(good, add, close_sums), merge_sums).split(b",")]

    def fold(state, column):
        rows = _deviations(_matrix(column, d), n, sums).astype(np.float64) / n
        return _triangle(rows if state is None else np.vstack([state, rows]))

    def merge_triangles(payloads):
        return _triangle(np.vstack([np.frombuffer(p, np.float64).reshape(-1, d) for p in payloads])).tobytes()

    r = np.frombuffer(_reduce(_partials(good, fold, lambda s: np.ascontiguousarray(s).tobytes()), merge_triangles), np.float64).reshape(-1, d)
    r = np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r
    squares, v = directions(r, most)
    return {"d": d, "n": n, "sums": sums, "eigenvalues": squares / n, "vectors": v, "trace": float((r * r).sum()) / n}


def _project(column: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Exact deviations and whitened coordinates of a batch."""
    dev = _deviations(_matrix(column, model["d"]), model["n"], model["sums"])
    k = model["vectors"].shape[1]
    return dev, (dev.astype(np.float64) / model["n"]) @ model["vectors"] / np.sqrt(model["eigenvalues"][:k])


def identity_error(df: DataFrame, model: dict, key: str = "vec_id", vector: str = "embedding") -> float:
    """Largest entry of the covariance of the whitened rows minus the identity, from centred products of all rows."""
    k = model["vectors"].shape[1]

    def merge_two(a, b):
        n = a[0] + b[0]
        gap = b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def step(state, column):
        w = _project(column, model)[1]
        mean = w.mean(axis=0)
        own = (float(len(w)), mean, (w - mean).T @ (w - mean))
        return own if state is None else merge_two(state, own)

    def close(s):
        return np.concatenate([[s[0]], s[1], s[2].ravel()]).tobytes()

    def parse(p):
        a = np.frombuffer(p, np.float64)
        return a[0], a[1 : k + 1], a[k + 1 :].reshape(k, k)

    def merge(payloads):
        out = parse(payloads[0])
        for p in payloads[1:]:
            out = merge_two(out, parse(p))
        return close(out)

    good = usable(df, key, vector).where(F.size("c") == model["d"])
    n, _, products = parse(_reduce(_partials(good, step, close), merge))
    return float(np.abs(products / n - np.eye(k)).max())


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: ``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows with a null or empty vector, or with null, non-finite or (from 2^52) unrepresentable
    entries are dropped, as are vectors of another length than most have; other columns play
    no part. Null and repeated keys return like any others. Components without variance are
    left out: equal vectors, or a single one, give no rows, as does an empty table. A
    deviation that a long can't hold is null.
    """
    model = fit(df, key, vector, most)
    schema = f"{key} {df.schema[key].dataType.simpleString()}, component int, deviation long, whitened double"
    k = 0 if model is None else model["vectors"].shape[1]
    if not k:
        return df.sparkSession.createDataFrame([], f"{key} {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(df, model, key, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                dev, w = _project(b.column("c"), model)
                at = np.repeat(np.arange(b.num_rows), k)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_key").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(_squares(dev), pa.int64()).take(pa.array(at)), pa.array(w.ravel())], [key, "component", "deviation", "whitened"]
                )

    share = F.element_at(F.array(*[F.lit(float(e / model["trace"])) for e in model["eigenvalues"][:k]]), F.col("component"))
    out = usable(df, key, vector).where(F.size("c") == model["d"]).mapInArrow(run, schema)
    return out.select(key, "component", F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
