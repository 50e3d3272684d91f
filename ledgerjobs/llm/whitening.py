"""Embedding whitening: leading eigenvectors of the covariance by contour integration (FEAST)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .vectors import exact_product, matrix, whole_sums, whole_vectors


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of symmetric ``v`` exceed ``shift``: the positive pivots of L D L^T of ``v - shift I`` (Sylvester's law of inertia).

    Pivots are 1 x 1 or 2 x 2 blocks (Bunch and Kaufman); a 2 x 2 one has one positive and one negative eigenvalue.
    """
    a = v - shift * np.eye(len(v))
    alpha, positive = (1 + np.sqrt(17)) / 8, 0
    while len(a):
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1 if len(column) else 0
        size = 1
        if r and abs(a[0, 0]) < alpha * column[r - 1]:
            beside = np.abs(a[r])
            beside[r] = 0
            reach = beside.max()
            if abs(a[0, 0]) * reach < alpha * column[r - 1] ** 2:
                if abs(a[r, r]) >= alpha * reach:
                    swap, size = (0, r), 1
                else:
                    swap, size = (1, r), 2
                order = np.arange(len(a))
                order[list(swap)] = order[list(swap[::-1])]
                a = a[np.ix_(order, order)]
        pivot, left = a[:size, :size], a[size:, :size]
        if size == 2:
            positive += 1
            a = a[2:, 2:] - left @ np.linalg.solve(pivot, left.T)
        else:
            positive += bool(pivot[0, 0] > 0)
            a = a[1:, 1:] - (left @ left.T / pivot[0, 0] if pivot[0, 0] else 0)
    return positive


def intervals(v: np.ndarray, k: int, apart: float = 1e-3) -> list[tuple[float, float, int]]:
    """Intervals (low, high, how many eigenvalues) that together hold the ``k`` largest eigenvalues, from above.

    Bisection by inertia finds the eigenvalues to a fraction of ``apart`` of the largest one; a
    border is set where two neighbours are farther apart than that, so that no interval cuts
    through a cluster. The last one may hold more than the k-th.
    """
    top = float(np.abs(v).sum(axis=1).max()) * 1.01  # beyond all eigenvalues (Gershgorin)
    bottom = -top * 1e-3

    def border(j: int, low: float, high: float, to: float) -> float:
        """The j-th largest eigenvalue."""
        while high - low > to:
            middle = (low + high) / 2
            low, high = (middle, high) if above(v, middle) >= j else (low, middle)
        return (low + high) / 2

    first = border(1, bottom, top, top * 1e-4)
    found, out, start, high = [first], [], 0, top
    while True:
        j = len(found)
        following = border(j + 1, bottom, found[-1] + apart * first / 8, apart * first / 8) if j < len(v) else 2 * bottom
        if found[-1] - following > apart * first:
            low = (found[-1] + following) / 2
            out.append((low, high, above(v, low) - start))
            start, high = start + out[-1][2], low
            if start >= k:
                return out
        found.append(following)


def contour(v: np.ndarray, low: float, high: float, count: int, nodes: int = 8, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high) and their unit eigenvectors.

    The projector onto their space is the integral of (z I - V)^-1 over a circle around the
    interval, taken at Gauss-Legendre nodes of the upper half; solves at the complex shifts
    apply it to a block of vectors, and Rayleigh-Ritz takes eigenpairs out of what comes. It is
    repeated until the residuals are at rounding. The start is a fixed block, so reruns agree.
    """
    d, middle, radius = len(v), (low + high) / 2, (high - low) / 2
    at, weights = np.polynomial.legendre.leggauss(nodes)
    turns = np.exp(1j * np.pi / 2 * (at + 1))
    width = min(d, count + max(4, count // 2))
    y = np.random.default_rng(11).standard_normal((d, width))
    best, scale = np.inf, max(float(np.abs(v).sum(axis=1).max()), np.finfo(float).tiny)
    for _ in range(rounds):
        y = np.linalg.qr(y)[0]
        q = sum(w / 2 * (radius * t * np.linalg.solve((middle + radius * t) * np.eye(d) - v, y)).real for t, w in zip(turns, weights, strict=True))
        q = np.linalg.qr(q)[0]
        values, inner = np.linalg.eigh(q.T @ v @ q)
        y = q @ inner
        inside = (values > low) & (values < high)
        off = float(np.abs(v @ y[:, inside] - y[:, inside] * values[inside]).max(initial=0)) / scale
        if inside.sum() == count and off >= best / 2:  # no better than before: rounding is reached
            return values[inside], y[:, inside]
        best = off if inside.sum() == count else np.inf
    raise ArithmeticError(f"{int(inside.sum())} of {count} eigenvalues between {low} and {high}, residual {off}")


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a covariance, falling, and unit eigenvectors as columns; fewer where no more are above rounding.

    Each interval's eigenvalues are as many as inertia counts there, else an ArithmeticError tells that one is missed.
    """
    if not len(v) or not np.abs(v).max():
        return np.zeros(0), np.zeros((len(v), 0))
    unit = float(np.abs(v).max())
    v = v / unit
    parts = [contour(v, low, high, count) for low, high, count in intervals(v, min(k, len(v)))]
    basis = np.linalg.qr(np.concatenate([y for _, y in parts], axis=1))[0]
    values, inner = np.linalg.eigh(basis.T @ v @ basis)
    order = np.argsort(-values)[:k]
    order = order[values[order] > len(v) * np.finfo(float).eps * np.trace(v)]
    return values[order] * unit, (basis @ inner)[:, order]


@dataclass
class Whitening:
    """A fit: number of vectors, their sums, the whole numbers nearest to the means, eigenpairs, and the trace."""

    n: int
    sums: list[int]
    centre: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections of ``x - S / n`` over the roots of the eigenvalues, one column per component."""
        rest = np.array([float(Fraction(s, self.n) - int(c)) for s, c in zip(self.sums, self.centre, strict=True)])
        return (centred(x, self.centre).astype(np.float64) - rest) @ (self.components / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n x - S) ^ 2, exact: n^2 |y|^2 - 2 n r y + |r|^2, where y is x less the whole centre and r the sums' rest."""
        y = centred(x, self.centre)
        rest = [s - self.n * int(c) for s, c in zip(self.sums, self.centre, strict=True)]
        narrow = y.dtype != object and max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) ** 2 * y.shape[1] < 2**62
        squares = (y * y).sum(axis=1) if narrow else (y.astype(object) ** 2).sum(axis=1)
        if y.dtype != object:
            crossed = exact_product(y, np.array(rest, dtype=np.int64)[:, None])[:, 0] if all(abs(r) < 2**62 for r in rest) else y.astype(object) @ np.array(rest, dtype=object)
        else:
            crossed = y @ np.array(rest, dtype=object)
        whole = sum(r * r for r in rest)
        return [self.n * (self.n * int(s) - 2 * int(c)) + whole for s, c in zip(squares, crossed, strict=True)]


def centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """``x - centre`` in whole numbers; as Python integers where int64 might not hold it."""
    if max(abs(int(a.max(initial=0))) + abs(int(a.min(initial=0))) for a in (x, centre)) < 2**61:
        return x - centre
    return x.astype(object) - centre.astype(object)


def fit(distinct: DataFrame, dims: int, k: int) -> Whitening:
    """From distinct vectors (column x, array<long>), a written table; it is read twice.

    Sums, and sums of products of entries less the whole numbers nearest to the means, are
    exact; n V = their sum less what the means' fractions add. The driver gets ``dims`` squared
    numbers, whatever the number of vectors.
    """

    def sums(batches: Iterator[np.ndarray]) -> Iterable[tuple[int, int]]:
        total = np.zeros(dims + 1, dtype=object)
        for x in batches:
            total[:dims] += exact_product(np.ones((1, len(x)), dtype=np.int64), x)[0].astype(object)
            total[dims] += len(x)
        return enumerate(total)

    found = whole_sums(distinct, sums)
    n, first = found.get(dims, 0), [found.get(i, 0) for i in range(dims)]
    if not n:
        return Whitening(0, first, np.zeros(dims, dtype=np.int64), np.zeros(0), np.zeros((dims, 0)), 0.0)
    centre = np.array([(2 * s + n) // (2 * n) for s in first], dtype=np.int64)
    high, low = np.triu_indices(dims)

    def products(batches: Iterator[np.ndarray]) -> Iterable[tuple[int, int]]:
        total = np.zeros((dims, dims), dtype=object)
        for x in batches:
            y = centred(x, centre)
            total += exact_product(y.T, y).astype(object) if y.dtype != object else y.T @ y
        return zip((high * dims + low).tolist(), total[high, low], strict=True)

    found = whole_sums(distinct, products)
    rest = [s - n * int(c) for s, c in zip(first, centre, strict=True)]
    v = np.zeros((dims, dims))
    for i, j in zip(high.tolist(), low.tolist(), strict=True):
        v[i, j] = v[j, i] = float(Fraction(n * found.get(i * dims + j, 0) - rest[i] * rest[j], n * n))
    values, components = leading(v, k)
    return Whitening(n, first, centre, values, components, float(np.trace(v)))


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit vectors' covariance, as measured on them all, less the identity."""
    k = len(model.values)
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                z = shared.value.whitened(matrix(batch))
                sums, products = sums + z.sum(axis=0), products + z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k + k), pa.int32()), pa.array(np.concatenate([sums, products.ravel()]))], names=["cell", "value"])

    rows = distinct.select("x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(k * k + k)
    for r in rows:
        flat[r["cell"]] = r["value"]
    mean = flat[:k] / model.n  # of vectors that are centred already
    return float(np.abs(flat[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, k: int = 4) -> DataFrame:
    """Per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries become floor(``scale`` * entry). Mean and covariance are those of the distinct
    vectors; components are its ``k`` leading eigenvectors by ``leading``, numbered from 1.
    Spark forms exact sums and projects all rows; the driver works on one square matrix of the
    vectors' length, never on vectors.

    Left out are rows whose vector is null or empty, holds null or non-finite entries, or has
    another length than most. Rows of null or repeated ids, and repeated rows, each have their
    own. There are fewer components where fewer eigenvalues are above rounding, so none, and no
    rows, where all vectors are equal. Entries stop at the limits of long; a deviation beyond
    them is null. An empty table gives an empty result, and other columns are not looked at.
    """
    space = Workspace(vectors.sparkSession)
    slim = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    staged = space.stage(whole_vectors(slim, "v", scale), "vectors")
    distinct = space.stage(staged.select("x").distinct(), "distinct")
    one = distinct.first()
    model = fit(distinct, len(one["x"]) if one else 1, k)
    error = identity_error(distinct, model) if len(model.values) else 0.0
    shared = staged.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = len(shared.value.values)
        for batch in batches:
            if batch.num_rows and parts:
                x = matrix(batch)
                far = [v if v < 2**63 else None for v in shared.value.deviation(x)]
                z = pa.FixedSizeListArray.from_arrays(pa.array(shared.value.whitened(x).ravel()), parts).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(far, pa.int64()), z], names=["row", "deviation", "z"])

    kind = staged.schema["row"].dataType.simpleString()
    rows = staged.mapInArrow(project, f"row {kind}, deviation long, z array<double>").select("row.vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(e / model.trace)) for e in model.values] or [F.lit(0.0)]), F.col("at") + 1)
    out = rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
    space.drop(out)
    return out
