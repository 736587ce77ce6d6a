"""Whitening of vectors by pivoted Cholesky and one-sided Jacobi.

A vector's entries c become integers x = floor(scale * c) + shift. Their covariance V (divisor n, centred) is factored,
V = P L L' P', by Cholesky with diagonal pivots. One-sided Jacobi rotates pairs of columns of L until all are orthogonal,
L J = U S: the squared column norms are V's eigenvalues and the normalised columns, rows put back by the pivots, its
eigenvectors. Neither V nor L'L is iterated on, so small eigenvalues keep their relative precision.

Four passes read the vectors: the sums (exact integers), the centred scatter, the covariance of the whitened values, and the
rows. What a task adds up is one matrix; matrices are summed in a tree of groups of ``_FAN`` in a fixed order, so no
task or driver receives more than ``_FAN`` of them, whatever the number of tasks.

Defined cases: a null vector and one with a null, NaN or infinite entry are left out; the rest must have one
length, else the operator fails, as it does where an entry leaves the range of exact integers (2^52); a vector without
entries counts in ``n`` and has no components; components beyond the rank of V (equal vectors, fewer vectors than dimensions) do not
exist and have no rows; ids may repeat or be null; an empty table gives an empty result; columns besides id and vector
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import materialise

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
_FAN = 32
_SWEEPS = 60
_EXACT = float(1 << 52)
_TINY = 1e-14  # of the largest diagonal entry: what is less is rounding


def usable(column: str) -> F.Column:
    """True for vectors whose entries are all finite numbers."""
    x = F.col(column)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return x.isNotNull() & F.coalesce(finite, F.lit(False))


def integers(column: pa.Array, scale: int, shift: int) -> np.ndarray:
    """The integer vectors of a batch as the rows of a matrix."""
    sizes = set(column.value_lengths().to_pylist())
    if len(sizes) > 1:
        raise ValueError(f"vectors have different lengths: {sorted(sizes)[:5]}")
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    flat = np.floor(flat * scale) + shift
    if len(flat) and np.abs(flat).max() >= _EXACT:
        raise ValueError("an entry is out of the range of exact integers")
    return flat.astype(np.int64).reshape(len(column), sizes.pop() if sizes else 0)


def _batches(batches: Iterator[pa.RecordBatch], column: int, scale: int, shift: int) -> Iterator[np.ndarray]:
    """Integer matrices of at most about four million entries."""
    for b in batches:
        if not b.num_rows:
            continue
        wide = max(1, len(b.column(column).flatten()) // b.num_rows)
        step = max(1, 4_000_000 // wide)
        for k in range(0, b.num_rows, step):
            yield integers(b.column(column).slice(k, step), scale, shift)


def summed(parts: DataFrame, add: Callable[[list[list[np.ndarray]]], list[np.ndarray]]) -> list[np.ndarray] | None:
    """All ``part`` (int), ``value`` (arrays as binary) rows of the tasks added up in a tree, in the order of their parts."""
    def merge(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["part", "value"]).to_pylist(), key=lambda r: r["part"])
        return pa.table({"part": pa.array([rows[0]["part"] // _FAN], pa.int32()),
                         "value": [_packed(add([_unpacked(r["value"]) for r in rows]))]})

    parts = materialise(parts, "partial-sums")
    while parts.count() > _FAN:
        groups = parts.groupBy(F.floor(F.col("part") / _FAN).cast("int"))
        parts = materialise(groups.applyInArrow(merge, "part int, value binary"), "partial-sums")
    rows = sorted(parts.collect(), key=lambda r: r.part)
    return add([_unpacked(bytes(r.value)) for r in rows]) if rows else None


def _packed(arrays: list[np.ndarray]) -> bytes:
    sink = pa.BufferOutputStream()
    for x in arrays:
        pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(x)), sink)
    return sink.getvalue().to_pybytes()


def _unpacked(value: bytes) -> list[np.ndarray]:
    source, out = pa.BufferReader(value), []
    while source.tell() < len(value):
        out.append(pa.ipc.read_tensor(source).to_numpy())
    return out


def _per_task(vectors: DataFrame, one: Callable[[Iterator[np.ndarray]], list[np.ndarray] | None], scale: int, shift: int) -> DataFrame:
    """``one`` over the integer matrices of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = one(_batches(batches, 0, scale, shift))
        if value is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "value": [_packed(value)]})

    return vectors.select("vector").mapInArrow(run, "part int, value binary")


def _one_length(arrays: list[np.ndarray]) -> list[np.ndarray]:
    if len({x.shape for x in arrays}) > 1:
        raise ValueError("vectors have different lengths")
    return arrays


def sums(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""
    low = (1 << 32) - 1

    def one(matrices):
        # Sums of the low and the high halves stay far from the limits of 64 bits.
        n, total = 0, None
        for x in matrices:
            now = np.stack([(x & low).sum(axis=0), (x >> 32).sum(axis=0)])
            n, total = n + len(x), now if total is None else sum(_one_length([total, now]))
        return None if total is None else [np.array([n]), total]

    def add(parts):
        total = sum(_one_length([p[1] for p in parts]))
        return [sum(p[0] for p in parts), np.stack([total[0] & low, total[1] + (total[0] >> 32)])]

    found = summed(_per_task(vectors, one, scale, shift), add)
    if found is None:
        return 0, []
    return int(found[0][0]), [int(a) + (int(b) << 32) for a, b in found[1].T]


def _centre(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S / n, where S = n * ``whole`` + ``rest``: the integer part is exact."""
    return (x - whole) - rest / n


def _divided(n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    whole = [s // n for s in total]
    return np.array(whole, np.int64), np.array([s - n * w for s, w in zip(total, whole)], np.float64)


def covariance(vectors: DataFrame, n: int, total: list[int], scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """The covariance with divisor ``n``, each value centred before it is multiplied."""
    whole, rest = _divided(n, total)

    def one(matrices):
        scatter = None
        for x in matrices:
            z = _centre(x, n, whole, rest)
            scatter = z.T @ z if scatter is None else scatter + z.T @ z
        return None if scatter is None else [scatter]

    return summed(_per_task(vectors, one, scale, shift), lambda parts: [sum(p[0] for p in parts)])[0] / n


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``L`` (lower trapezoidal, one column per rank) and the order of rows with v[order][:, order] = L L'."""
    d = len(v)
    v, order, factor = v.copy(), np.arange(d), np.zeros((d, d))
    most = float(v.diagonal().max(initial=0.0))
    for k in range(d):
        p = k + int(np.argmax(v.diagonal()[k:]))
        if v[p, p] <= max(_TINY * d * most, 0.0):
            return factor[:, :k], order
        v[[k, p]] = v[[p, k]]
        v[:, [k, p]] = v[:, [p, k]]
        order[[k, p]], factor[[k, p]] = order[[p, k]], factor[[p, k]]
        factor[k, k] = np.sqrt(v[k, k])
        factor[k + 1:, k] = v[k + 1:, k] / factor[k, k]
        v[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, order


def _rounds(r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each pair of ``r`` columns once, in rounds of disjoint pairs (the circle method)."""
    ring = list(range(r + r % 2))
    for _ in range(len(ring) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:len(ring) // 2], ring[::-1]) if max(a, b) < r]
        yield np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The columns of ``factor`` rotated until all are orthogonal, those of the largest norm first."""
    a = factor.copy()
    r = a.shape[1]
    for _ in range(_SWEEPS):
        worst = 0.0
        for i, j in _rounds(r):
            x, y = a[:, i], a[:, j]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(alpha * beta)
            cosine = np.divide(np.abs(gamma), size, out=np.zeros_like(gamma), where=size > 0)
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > 1e-16
            if not turn.any():
                continue
            i, j, x, y = i[turn], j[turn], x[:, turn], y[:, turn]
            zeta = (beta[turn] - alpha[turn]) / (2.0 * gamma[turn])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1.0 / np.hypot(1.0, t)
            a[:, i], a[:, j] = c * (x - t * y), c * (t * x + y)
        if worst < 1e-15 * max(8, len(a)):
            break
    return a[:, np.argsort(-(a * a).sum(0), kind="stable")]


def eigenpairs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, and unit eigenvectors as columns, of a covariance; as many as its rank."""
    factor, order = pivoted_cholesky(v)
    turned = one_sided_jacobi(factor)
    values = (turned * turned).sum(0)
    vectors = np.zeros_like(turned)
    vectors[order] = turned / np.sqrt(values)
    return values, vectors


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: the exact mean ``total`` / ``n``, all ``values`` and ``vectors`` of the covariance, its trace."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int = SCALE
    shift: int = SHIFT

    @property
    def rank(self) -> int:
        return len(self.values)

    def matrix(self, k: int) -> np.ndarray:
        return self.vectors[:, :k] / np.sqrt(self.values[:k])

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        return _centre(x, self.n, *_divided(self.n, self.total)) @ self.matrix(k)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The exact sum of (n x - S)^2 of each row."""
        bound = float(self.n) * np.abs(x - _divided(self.n, self.total)[0]).max(initial=0) + self.n
        if bound ** 2 * x.shape[1] < 2.0 ** 62:
            away = x * np.int64(self.n) - np.array(self.total, np.int64)
            return (away * away).sum(axis=1)
        exact = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.total)) for row in x.tolist()]
        return np.array(exact, np.int64)  # fails where a value doesn't fit a long

    def identity_error(self, vectors: DataFrame, k: int) -> float:
        """The largest absolute entry of the whitened values' covariance minus the identity."""
        def one(matrices):
            n, mean, scatter = 0, np.zeros(k), np.zeros((k, k))
            for x in matrices:
                y = self.whitened(x, k)
                n, mean, scatter = _joined((n, mean, scatter), (len(y), y.mean(0), (y - y.mean(0)).T @ (y - y.mean(0))))
            return [np.array([n]), mean, scatter] if n else None

        def add(parts):
            now = (0, np.zeros(k), np.zeros((k, k)))
            for n, mean, scatter in parts:
                now = _joined(now, (int(n[0]), mean, scatter))
            return [np.array([now[0]]), now[1], now[2]]

        found = summed(_per_task(vectors, one, self.scale, self.shift), add)
        return float(np.abs(found[2] / int(found[0][0]) - np.eye(k)).max(initial=0.0))


def _joined(a: tuple, b: tuple) -> tuple:
    """Number, mean and centred scatter of two sets of rows together."""
    n, far = a[0] + b[0], b[1] - a[1]
    return n, a[1] + far * (b[0] / n), a[2] + b[2] + np.outer(far, far) * (a[0] * b[0] / n)


def fit(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The whitening of all rows of ``vectors`` (column ``vector``, usable ones only); None without rows."""
    n, total = sums(vectors, scale, shift)
    if not n:
        return None
    v = covariance(vectors, n, total, scale, shift) if total else np.zeros((0, 0))
    values, found = eigenpairs(v)
    return Whitening(n, total, values, found, float(np.trace(v)), scale, shift)


def whiten(rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding",
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` of all usable rows."""
    kind = rows.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    held = rows.filter(usable(vector)).select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    model = fit(held.select("vector"), scale, shift)
    k = min(components, model.rank) if model else 0
    if not k:
        return held.sparkSession.createDataFrame([], schema)
    error = model.identity_error(held, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, 200_000 // k)
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                x = integers(part.column(1), scale, shift)
                rows = len(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                     pa.array(np.full(rows * k, model.n)), pa.array(np.repeat(model.deviation(x), k)), pa.array(model.whitened(x, k).ravel()),
                     pa.array(np.tile(model.values[:k] / model.trace, rows)), pa.array(np.full(rows * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return held.mapInArrow(run, schema)
