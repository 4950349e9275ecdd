"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Entries become whole numbers, so that sums over all rows are exact. They are written once as narrow binary rows. Each step
of the bidiagonalisation is one pass over these: a task multiplies its rows X by the direction v and the result u = Xv by
X' again, and only the sums over tasks, as long as a vector, come to the driver. What a step has to take off a left vector
(the one before, and all earlier ones for full reorthogonalisation) is known as a combination of right directions, so left
vectors, as long as the table, are never stored: u is X times a direction, and X'u of earlier ones is kept. As many steps
are taken as the vectors have dimensions; a direction that breaks down is replaced by one orthogonal to all before, so equal
and vanishing deviations are found too. The singular values of the small bidiagonal matrix give deviations and components.

Edge cases: rows whose vector is null or holds null or non-finite entries are dropped, as are those whose length is not the
most frequent one (the longer of equals); repeated rows count each; directions without variance have no component (one row,
or equal rows, give none), so the result can have fewer than asked; an empty table gives no rows; other columns are not
looked at, ``row`` carries what is asked. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: A step's new direction counts as zero below this share of the largest one.
ZERO = 1e-12


def whole_numbers(vectors: DataFrame, vector_col: str = "embedding", row: Column | None = None) -> DataFrame:
    """(row, x array<long>) of the rows whose vector is there and finite."""
    v = F.col(vector_col)
    finite = lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False))  # noqa: E731  NaN is above infinity
    rows = vectors.where(v.isNotNull() & F.coalesce(F.forall(v, finite), F.lit(False)))
    return rows.select((F.struct("*") if row is None else row).alias("row"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("long")).alias("x"))


@dataclass
class Whitening:
    """What the rows have taught: their number, sums by dimension, and by component direction and variance."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None = None


def _matrix(column: pa.Array, kind: str, d: int) -> np.ndarray:
    """The binary rows of a batch as a matrix of whole numbers."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], kind)[ends[0] // np.dtype(kind).itemsize:][:len(column) * d].reshape(-1, d)


def _sums(rows: DataFrame, kind: str, d: int, of: Callable[[np.ndarray], np.ndarray], dtype: str = "double") -> np.ndarray:
    """The sum over all rows of what ``of`` gives for a matrix of them: added up in each task, then over tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0), kind, d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "value"])

    got = rows.mapInArrow(run, f"at int, value {dtype}").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    return got.column("value").to_numpy()[np.argsort(got.column("at").to_numpy())]


def _centred(n: int, sums: np.ndarray):
    """A function of whole-number rows: the distances from the mean, as exact as doubles are."""
    base = sums // n
    rest = (sums - base * n) / n
    return lambda x: (x - base) - rest


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along an orthonormal basis; twice, which is enough."""
    for _ in range(2):
        for b in basis:
            v = v - (b @ v) * b
    return v


def bidiagonalise(step: Callable[[np.ndarray], np.ndarray], d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(right vectors as columns, diagonal, superdiagonal) of XV = UB.

    ``step(h)`` gives X'Xh and the squared length of Xh, one pass over the rows.
    """
    random = np.random.default_rng(0)
    right: list[np.ndarray] = []
    left: list[np.ndarray] = []  # g of each left vector u = Xg
    back: list[np.ndarray] = []  # X'u of each left vector
    alphas, betas, v, largest = [], [], None, 0.0
    for k in range(d):
        beta = 0.0
        if back:
            w = _orthogonal(back[-1] - alphas[-1] * right[-1], right)
            beta, v = float(np.sqrt(w @ w)), w
        if v is None or beta <= ZERO * largest:  # the first direction, or a new start
            beta, v = 0.0, _orthogonal(random.standard_normal(d), right)
        right.append(v / np.sqrt(v @ v))
        h = right[-1] - beta * left[-1] if left else right[-1]
        got = step(h)
        z, square = got[:d], got[d]
        for _ in range(2):  # what is left of earlier u in Xh: u'Xh is (X'u)'h
            off = [x @ h for x in back]
            for c, g, x in zip(off, left, back, strict=True):
                h, z = h - c * g, z - c * x
            square -= float(np.dot(off, off))
        alpha = float(np.sqrt(max(square, 0.0)))
        largest = max(largest, alpha, beta)
        if alpha <= ZERO * largest:
            alpha, h, z = 0.0, np.zeros(d), np.zeros(d)
        alphas.append(alpha), betas.append(beta)
        left.append(h / alpha if alpha else h), back.append(z / alpha if alpha else z)
    return np.stack(right, 1), np.array(alphas), np.array(betas[1:])


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows of ``whole_numbers``; None without rows."""
    kinds = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", lambda c: F.abs(c)))).alias("largest"))
    most = kinds.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None or not most["d"]:
        return None
    d, n, kind = most["d"], most["n"], "<i4" if most["largest"] < 1 << 31 else "<i8"

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in values], pa.binary())], ["x"])

    rows = materialize(x.where(F.size("x") == d).select("x").mapInArrow(narrow, "x binary"), "whole-numbers")
    sums = _sums(rows, kind, d, lambda m: m.astype(np.int64).sum(0), "long").astype(np.int64)
    centre = _centred(n, sums)
    trace = float(_sums(rows, kind, d, lambda m: np.array([np.square(centre(m)).sum()]))[0]) / n

    def step(h: np.ndarray) -> np.ndarray:
        def of(m: np.ndarray) -> np.ndarray:
            c = centre(m)
            u = c @ h
            return np.append(u @ c, u @ u)

        return _sums(rows, kind, d, of)

    right, diagonal, above = bidiagonalise(step, d) if trace else (np.eye(d), np.zeros(d), np.zeros(d - 1))
    _, deviations, turned = np.linalg.svd(np.diag(diagonal) + np.diag(above, 1))
    keep = min(components, int((deviations > 1e-9 * deviations[0]).sum()) if trace else 0)
    directions = right @ turned[:keep].T
    directions *= np.where(directions[np.abs(directions).argmax(0), np.arange(keep)] < 0, -1.0, 1.0)
    model = Whitening(n, sums, directions, deviations[:keep] ** 2 / n, trace)
    if keep:
        def products(m: np.ndarray) -> np.ndarray:
            w = centre(m) @ (directions / np.sqrt(model.variances))
            return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

        got = _sums(rows, kind, d, products) / n
        square, mean = got[:keep * keep].reshape(keep, keep), got[keep * keep:]
        model.identity_error = float(np.abs(square - np.outer(mean, mean) - np.eye(keep)).max())
    return model


WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - S)^2; null beyond a long."""
    if len(x) and max(int(np.abs(x).max()) * n, int(np.abs(sums).max())) < 1 << 62:
        off = x * n - sums
        if int(np.abs(off).max()) ** 2 * x.shape[1] < 1 << 63:
            return (off * off).sum(1).tolist()
    sums = sums.tolist()
    each = (sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x.tolist())
    return [e if e < 1 << 63 else None for e in each]


def whiten(x: DataFrame, model: Whitening | None) -> DataFrame:
    """(row, component, n, deviation, whitened, explained, identity_error): a row for each row of ``x`` and component."""
    schema = f"row {x.schema['row'].dataType.simpleString()}, {WHITENED}"
    if model is None:
        return x.sparkSession.createDataFrame([], schema)
    d, k, centre = len(model.sums), len(model.variances), _centred(model.n, model.sums)
    scaled = model.directions / np.sqrt(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            m = len(values)
            which = pa.array(np.repeat(np.arange(m), k))
            deviation = pa.array(_deviations(values, model.n, model.sums), pa.int64()).take(which)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(which), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviation,
                 pa.array((centre(values) @ scaled).ravel()), pa.array(np.tile(model.variances / model.trace, m)), pa.array(np.full(m * k, model.identity_error, float))],
                ["row", *(c.split()[0] for c in WHITENED.split(", "))])

    return x.where(F.size("x") == d).mapInArrow(run, schema) if k else x.sparkSession.createDataFrame([], schema)
