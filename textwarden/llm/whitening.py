"""Whitening of embeddings: exact distributed moments, a dense symmetric eigenproblem, projection.

Vectors become whole numbers.  Tasks sum them and their products, centred at a whole number
near each mean; the sums stay whole and below 2**53, so they do not depend on how rows are
dealt, and the covariance follows from them without cancellation.  Products are merged row
by row of the matrix, so no task holds more than its own rows of one matrix at a time.  The
driver sees one matrix of dimension times dimension, whatever the number of vectors: it is
reduced to tridiagonal form by Householder reflections, its leading eigenvalues are bracketed
by Sturm counts, and their vectors come from inverse iteration, those of close eigenvalues
made orthogonal to each other.  A projection of a few columns is sent to all tasks.

Defined results: a vector that is null, or holds a null or an entry that is not finite, is
left out.  A shorter vector is filled up with zeros; an empty one counts as all zeros.  64
times an entry is held within 2**52.  Equal vectors count once in the fit and each gives its
rows.  Rows without an id keep a null id.  A component whose eigenvalue is zero next to the
trace (fewer distinct vectors than dimensions) has no scale and is left out, so a table of
equal vectors gives no rows, as an empty one does.  A deviation outside 64 bits is held at
their limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.tables import written

SHIFT = 1_000_000
#: Entries are held within this, where doubles still tell whole numbers apart.
MOST = 1 << 52
#: Rows multiplied at once in a task.
ROWS = 4096
#: Eigenvalues below this part of the trace, times the dimension, count as zero.
ZERO = 1e-13


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``(key, x)`` of every usable row: floor(scale * entry) + SHIFT, ragged as the vectors are."""
    v = F.col(vector).cast("array<double>")
    usable = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = lambda c: F.greatest(F.least(F.lit(float(scale)) * c, F.lit(float(MOST))), F.lit(float(-MOST)))
    whole = F.transform(v, lambda c: F.floor(held(c)) + F.lit(SHIFT))
    return rows.filter(v.isNotNull() & usable).select(F.col(key).alias("key"), whole.alias("x"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    out = np.full((len(sizes), width), SHIFT, np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield part, _matrix(part.column("x"), width)


def _sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The number of rows of a task and its sum in each dimension, as text of any length."""
    n, total = 0, np.zeros(width, object)
    for _, x in _blocks(batches, width):
        n += len(x)
        # Halves of 26 bits: their sums over a block stay whole in 64 bits.
        low, high = x & ((1 << 26) - 1), x >> 26
        total = total + low.sum(0).astype(object) + high.sum(0).astype(object) * (1 << 26)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in total]])], ["n", "total"])


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        for count, sums in zip(batch.column("n").to_pylist(), batch.column("total").to_pylist()):
            n += count
            part = np.array([int(t) for t in sums], object)
            total = part if total is None else total + part
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(t) for t in total]])], ["n", "total"])


def _products(batches: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sums of products of a task's centred rows, a row for each dimension."""
    width = len(centre)
    out = np.zeros((width, width))
    seen = False
    for _, x in _blocks(batches, width):
        y = (x - centre).astype(np.float64)
        out += y.T @ y
        seen = True
    if seen:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width)), pa.array(list(out), pa.list_(pa.float64()))], ["i", "line"]
        )


def _second(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """As ``_products``, of whitened rows; the line after the last holds their sums."""
    size = model.axes.shape[1]
    out = np.zeros((size + 1, size))
    seen = False
    for _, x in _blocks(batches, len(model.total)):
        w = whitened(x, model)[1]
        out[:size] += w.T @ w
        out[size] += w.sum(0)
        seen = True
    if seen:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size + 1)), pa.array(list(out), pa.list_(pa.float64()))], ["i", "line"]
        )


def _add_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of equal number added up, one batch after the other."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, line in zip(batch.column("i").to_pylist(), batch.column("line")):
            line = line.values.to_numpy()
            held[i] = held[i] + line if i in held else line
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["i", "line"]
        )


_LINE = "i long, line array<double>"


def _added(lines: DataFrame) -> np.ndarray:
    """The matrix whose lines are spread over tasks; they are added before the driver takes them."""
    rows = lines.repartition("i").mapInArrow(_add_lines, _LINE).toArrow()
    order = np.argsort(rows.column("i").to_numpy())
    return np.array([rows.column("line")[int(i)].values.to_numpy() for i in order])


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(diagonal, beside, q)`` with ``q.T @ a @ q`` tridiagonal, by Householder reflections."""
    a = a.copy()
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        v = x.copy()
        v[0] += norm if x[0] >= 0 else -norm
        v /= np.linalg.norm(v)
        # On both sides at once: a - 2 v w' - 2 w v'.
        p = a[k + 1 :, k + 1 :] @ v
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -norm if v[0] >= 0 else norm
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def sturm_count(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of some numbers: the negative pivots of T - at."""
    tiny = np.finfo(float).tiny * 1e20 + np.finfo(float).eps * np.abs(beside).max(initial=0) * 1e-3
    squares = np.append(0.0, beside**2)
    pivot = np.ones_like(at)
    below = np.zeros(len(at), np.int64)
    for d, s in zip(diagonal, squares):
        pivot = d - at - s / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues of a tridiagonal matrix, falling, by bisection."""
    n = len(diagonal)
    reach = np.abs(np.append(beside, 0)) + np.abs(np.append(0, beside))
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    rank = n - 1 - np.arange(k)  # eigenvalues below the wanted one
    for _ in range(200):
        middle = (low + high) / 2
        less = sturm_count(diagonal, beside, middle) <= rank
        low, high = np.where(less, middle, low), np.where(less, high, middle)
        if np.all(high - low <= 2 * np.finfo(float).eps * np.maximum(np.abs(low), np.abs(high))):
            break
    return (low + high) / 2


def _solver(diagonal: np.ndarray, beside: np.ndarray, shift: float, tiny: float):
    """Solves (T - shift) x = b, by elimination with row exchanges."""
    n = len(diagonal)
    u = np.zeros((n, 3))  # the upper triangle: diagonal and two beside it
    factor, swapped = np.zeros(n), np.zeros(n, bool)
    row = np.array([diagonal[0] - shift, beside[0] if n > 1 else 0.0, 0.0])
    for i in range(n - 1):
        below = np.array([beside[i], diagonal[i + 1] - shift, beside[i + 1] if i + 2 < n else 0.0])
        if abs(below[0]) > abs(row[0]):
            row, below, swapped[i] = below, row, True
        if abs(row[0]) < tiny:
            row[0] = tiny
        u[i] = row
        factor[i] = below[0] / row[0]
        row = np.array([below[1] - factor[i] * row[1], below[2] - factor[i] * row[2], 0.0])
    u[n - 1] = row
    if abs(u[n - 1, 0]) < tiny:
        u[n - 1, 0] = tiny

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for i in range(n - 1):
            if swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor[i] * x[i]
        for i in range(n - 1, -1, -1):
            for k in (1, 2):
                if i + k < n:
                    x[i] -= u[i, k] * x[i + k]
            x[i] /= u[i, 0]
        return x

    return solve


def leading_vectors(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors for falling eigenvalues, by inverse iteration.

    Vectors of a cluster, whose values follow each other within a thousandth of the norm,
    are made orthogonal to the earlier ones of the cluster in every step.
    """
    n = len(diagonal)
    norm = max(float(np.abs(diagonal).max()), float(np.abs(beside).max(initial=0)), np.finfo(float).tiny)
    eps = np.finfo(float).eps
    out = np.zeros((n, len(values)))
    begin = 0
    shift = np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            begin = j
        # Shifts that agree would give one system for two vectors.
        shift = min(value, shift - 10 * eps * norm) if j > begin else value
        solve = _solver(diagonal, beside, shift, eps * norm)
        x = np.cos(np.arange(n) * (1.0 + j)) + 1.5
        for _ in range(6):
            x /= np.abs(x).max()
            x = solve(x)
            for _ in range(2):
                x -= out[:, begin:j] @ (out[:, begin:j].T @ x)
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading_pairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    k = min(k, len(a))
    diagonal, beside, q = tridiagonal(a)
    values = leading_values(diagonal, beside, k)
    vectors = q @ leading_vectors(diagonal, beside, values)
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    return values, vectors * sign


class Model(NamedTuple):
    """What whitens a vector: rows fitted, their sums, the axes over the roots of their values."""

    n: int
    total: list[int]
    axes: np.ndarray
    explained: np.ndarray


def whitened(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """``(n * x - total, whitened)`` of whole vectors; the first as Python numbers where 64 bits are too few."""
    most = max([abs(t) for t in model.total], default=0) + model.n * int(np.abs(x).max(initial=0))
    kind = np.int64 if most < 2**63 else object
    apart = model.n * x.astype(kind) - np.array(model.total, kind)
    return apart, (apart / model.n).astype(np.float64) @ model.axes


def covariance(fit: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """``(n, sums, covariance)`` of whole vectors; the covariance with divisor n."""
    sums = fit.mapInArrow(lambda it: _sums(it, width), "n long, total array<string>")
    sums = sums.repartition(8).mapInArrow(_add_sums, "n long, total array<string>").toArrow().to_pylist()
    n = sum(r["n"] for r in sums)
    total = [sum(int(r["total"][i]) for r in sums) for i in range(width)]
    if not n:
        return 0, total, np.zeros((width, width))
    near = [round(Fraction(t, n)) for t in total]
    centre = np.array(near, np.int64)
    summed = _added(fit.select("x").mapInArrow(lambda it: _products(it, centre), _LINE))
    rest = np.array([float(Fraction(t - n * c, n)) for t, c in zip(total, near)])
    return n, total, summed / n - np.outer(rest, rest)


def fit_model(fit: DataFrame, width: int, k: int) -> Model:
    """Fitted on distinct whole vectors."""
    n, total, v = covariance(fit, width)
    trace = float(np.trace(v))
    if not n or trace <= 0:
        return Model(n, total, np.zeros((width, 0)), np.zeros(0))
    values, vectors = leading_pairs(v, k)
    kept = values > ZERO * trace * width
    values, vectors = values[kept], vectors[:, kept]
    return Model(n, total, vectors / np.sqrt(values), values / trace)


def identity_error(fit: DataFrame, model: Model) -> float:
    """How far the covariance of the whitened vectors is from the identity, measured over all of them."""
    size = model.axes.shape[1]
    if not size:
        return 0.0
    added = _added(fit.select("x").mapInArrow(lambda it: _second(it, model), _LINE))
    mean = added[size] / model.n
    return float(np.abs(added[:size] / model.n - np.outer(mean, mean) - np.eye(size)).max())


def _project(batches: Iterator[pa.RecordBatch], model: Model, error: float) -> Iterator[pa.RecordBatch]:
    size = model.axes.shape[1]
    for batch, x in _blocks(batches, len(model.total)):
        apart, w = whitened(x, model)
        most = int(np.abs(apart).max(initial=0))
        if most * most * max(1, len(model.total)) < 2**63:
            deviation = (apart * apart).sum(1)
        else:
            deviation = [min(sum(int(a) * int(a) for a in row), 2**63 - 1) for row in apart]
        each = np.repeat(np.arange(len(x)), size)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), model.n)),
                pa.array(np.asarray(deviation, np.int64)[each]),
                pa.array(w.ravel()),
                pa.array(np.tile(model.explained, len(x))),
                pa.array(np.full(len(each), error)),
            ],
            ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whiten(rows: DataFrame, k: int = 16, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` of every usable row."""
    vectors = whole_vectors(rows, key, vector, scale)
    width = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    # Filled up before they are compared: [1] and [1, 0] are one vector.
    full = F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("x")))
    fit = written(vectors.select(full.alias("x")).distinct())
    model = fit_model(fit, width, k)
    error = identity_error(fit, model)
    kind = vectors.schema["key"].dataType.simpleString()
    return vectors.mapInArrow(
        lambda it: _project(it, model, error),
        f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double",
    ).withColumnRenamed("key", key)
