"""Whitening of embeddings: covariance on Spark, a small symmetric eigenproblem, projection on Spark.

Three passes over the vectors, each a sum that every task folds before it sends anything: exact sums per
dimension, then products of centred vectors, then products of whitened vectors as a check. What reaches the
driver has the size of the covariance (dimension squared), whatever the number of rows. There the matrix
is made tridiagonal by Householder reflections, its leading eigenvalues are found by bisection on Sturm
counts, and their vectors by inverse iteration, orthogonalised within clusters of close eigenvalues. The
projection (components by dimension) travels with the function that projects.

Vectors are put on a lattice first: x = floor(64 c) + 1000000. So sums and deviations are exact, and nothing
is multiplied before it is centred.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import staged

STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Eigenvalues below this part of the largest are rounding noise: there is no such component.
LEAST_PART = 1e-12
#: Eigenvalues closer than this part of the matrix's norm are a cluster.
CLUSTER_GAP = 1e-3
INVERSE_STEPS = 4
_EPS = float(np.finfo(np.float64).eps)


# ---- the eigenproblem -------------------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and Householder vectors of a symmetric matrix (None: nothing to reflect)."""
    a = np.array(matrix, np.float64)
    size = len(a)
    off, mirrors = np.zeros(max(size - 1, 0)), []
    for k in range(size - 1):
        column = a[k + 1 :, k].copy()
        if k == size - 2 or not column[1:].any():
            off[k] = column[0]
            mirrors.append(None)
            continue
        off[k] = -np.copysign(np.linalg.norm(column), column[0])
        column[0] -= off[k]
        mirror = column / np.linalg.norm(column)
        rest = a[k + 1 :, k + 1 :]
        image = rest @ mirror
        image -= (mirror @ image) * mirror
        rest -= 2 * (np.outer(mirror, image) + np.outer(image, mirror))
        mirrors.append(mirror)
    return a.diagonal().copy(), off, mirrors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """For each shift how many eigenvalues of the tridiagonal matrix lie below it."""
    floor = np.finfo(np.float64).tiny / _EPS
    pivot = diagonal[0] - shifts
    below = (pivot < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < floor, -floor, pivot)
        pivot = diagonal[i] - shifts - off[i - 1] ** 2 / pivot
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, each to rounding: all are bisected at once."""
    size = len(diagonal)
    radius = np.concatenate([np.abs(off), [0]]) + np.concatenate([[0], np.abs(off)])
    reach = max(float(np.abs(diagonal).max() + radius.max()), np.finfo(np.float64).tiny)
    rank = size - 1 - np.arange(count)  # so many eigenvalues lie below
    low = np.full(count, float((diagonal - radius).min()) - 4 * _EPS * reach)
    high = np.full(count, float((diagonal + radius).max()) + 4 * _EPS * reach)
    while True:
        middle = (low + high) / 2
        if not ((middle > low) & (middle < high) & (high - low > _EPS * np.abs(middle))).any():
            return middle
        above = sturm_counts(diagonal, off, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) x = b by elimination with row exchanges; zero pivots become tiny ones."""
    size = len(diagonal)
    tiny = _EPS * max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0)), 1e-300)
    main, first, second = diagonal - shift, np.append(off, 0.0), np.zeros(size)
    factors, swapped = np.zeros(size), np.zeros(size, bool)
    for i in range(size - 1):
        under, right, beyond = off[i], main[i + 1], first[i + 1]
        if abs(under) > abs(main[i]):
            swapped[i] = True
            factors[i] = main[i] / under
            main[i + 1] = first[i] - factors[i] * right
            first[i + 1] = -factors[i] * beyond
            main[i], first[i], second[i] = under, right, beyond
        else:
            if main[i] == 0:
                main[i] = tiny
            factors[i] = under / main[i]
            main[i + 1] = right - factors[i] * first[i]
    main[np.abs(main) < tiny] = tiny

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for i in range(size - 1):
            if swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factors[i] * x[i]
        for i in range(size - 1, -1, -1):
            if i + 1 < size:
                x[i] -= first[i] * x[i + 1]
            if i + 2 < size:
                x[i] -= second[i] * x[i + 2]
            x[i] /= main[i]
        return x

    return solve


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as columns, for eigenvalues in falling order."""
    random = np.random.default_rng(11)
    norm = max(float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0)), 1e-300)
    vectors = np.zeros((len(diagonal), len(values)))
    start = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER_GAP * norm:
            start = j
        # equal eigenvalues are told apart a little, or every start would lead to one vector
        solve = _solver(diagonal, off, value - (j - start) * 2 * _EPS * norm)
        x = random.standard_normal(len(diagonal))
        for _ in range(INVERSE_STEPS):
            x = solve(x / np.abs(x).max())
            x /= np.abs(x).max()
            for _ in range(2):
                near = vectors[:, start:j]
                x -= near @ (near.T @ x)
        vectors[:, j] = x / np.linalg.norm(x)
    return vectors


def leading_components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``count`` largest eigenvalues of a covariance, falling, and their unit vectors as columns.

    Components whose eigenvalue is rounding noise are left out. The entry of largest size is positive.
    """
    scale = float(np.abs(matrix).max(initial=0))
    if scale == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, min(count, len(matrix)))
    values = values[values > LEAST_PART * max(values[0], 0)]
    vectors = inverse_iteration(diagonal, off, values)
    for k in range(len(mirrors) - 1, -1, -1):
        if mirrors[k] is not None:
            part = vectors[k + 1 :]
            part -= 2 * np.outer(mirrors[k], mirrors[k] @ part)
    largest = vectors[np.abs(vectors).argmax(0), np.arange(len(values))]
    return values * scale, vectors * np.sign(largest)


# ---- the passes over the vectors --------------------------------------------------------------------


@dataclass(frozen=True)
class Centre:
    """Exact sums of the vectors: n x - S is computed from small whole numbers."""

    n: int
    near: np.ndarray  # whole numbers next to the means
    rest: np.ndarray  # n near - S

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, as longs where they fit, else as Python's whole numbers."""
        apart = x - self.near
        if float(np.abs(apart).max(initial=0)) * self.n < 2.0**61:
            return apart * self.n + self.rest
        return apart.astype(object) * self.n + self.rest.astype(object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, each entry rounded once or twice."""
        return self.deviations(x).astype(np.float64) / self.n


def lattice(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): rows with a vector of finite entries, as whole numbers floor(64 c) + 1000000."""
    entry = F.col("embedding")
    bad = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    x = F.transform(entry, lambda c: F.floor(c.cast("double") * STEPS).cast("long") + F.lit(OFFSET))
    return vectors.where(entry.isNotNull() & ~bad & (F.size(entry) > 0)).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _summed(rows: DataFrame, size: int, per_batch: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all rows of the matrix that ``per_batch`` makes of a batch; tasks fold their batches."""
    arrow = {"long": pa.int64(), "double": pa.float64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = per_batch(_matrix(batch.column("x"), size))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape, np.int32)
            flat = [pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel(), arrow)]
            yield pa.RecordBatch.from_arrays(flat, names=["i", "j", "v"])

    parts = rows.select("x").mapInArrow(run, f"i int, j int, v {kind}")
    exact = F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v")
    cells = parts.groupBy("i", "j").agg(F.sum(exact).alias("v")).collect()
    if not cells:
        return np.zeros((0, 0))
    out = np.zeros((max(c.i for c in cells) + 1, max(c.j for c in cells) + 1), object if kind == "long" else float)
    for c in cells:
        out[c.i, c.j] = int(c.v) if kind == "long" else c.v
    return out


def _centre(rows: DataFrame, size: int) -> Centre:
    def halves(x: np.ndarray) -> np.ndarray:  # so that no sum of longs overflows
        return np.stack([np.full(size, len(x)), (x >> 31).sum(0), (x & 0x7FFFFFFF).sum(0)])

    counts, high, low = _summed(rows, size, halves, "long")
    n, sums = int(counts[0]), [int(h) * 2**31 + int(s) for h, s in zip(high, low, strict=True)]
    near = [(2 * s + n) // (2 * n) for s in sums]
    rest = [n * q - s for q, s in zip(near, sums, strict=True)]
    return Centre(n, np.array(near, np.int64), np.array(rest, np.int64))


def _deviation(apart: np.ndarray) -> list[int | None]:
    """Exact sums of squares; null where one does not fit a long."""
    rough = (apart.astype(np.float64) ** 2).sum(1)
    if apart.dtype != object and rough.max(initial=0) < 2.0**62:
        return (apart * apart).sum(1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in apart]
    return [v if v < 2**63 else None for v in exact]


_COLUMNS = (
    "component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: its place on it in standard deviations, and how good the fit is.

    ``vectors`` has vec_id and embedding; other columns are not read. Vectors that are null, empty or hold
    null or non-finite entries are left out, and so are those of another length than most have (of equally
    frequent lengths the longest counts). All others are fitted, repeated rows as often as they come, null
    ids included, and each has its rows. There are fewer components than asked for where the vectors span
    fewer dimensions: a single vector, or equal ones, have none, so no rows. An empty table gives an empty
    table. A deviation beyond 64 bits is null. An entry whose lattice number does not fit 64 bits is an error.
    """
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, {_COLUMNS}"
    spark = vectors.sparkSession
    rows = staged(lattice(vectors), "whitening-lattice")
    lengths = rows.groupBy(F.size("x").alias("size")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    size = common["size"]
    rows = rows.where(F.size("x") == size)
    centre = _centre(rows, size)

    def products(x: np.ndarray) -> np.ndarray:
        c = centre.centred(x)
        return c.T @ c

    covariance = _summed(rows, size, products, "double") / centre.n
    covariance = (covariance + covariance.T) / 2
    values, axes = leading_components(covariance, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    projection = axes / np.sqrt(values)
    explained = values / np.trace(covariance)
    count = len(values)

    def whitened_products(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ projection
        return np.vstack([w.T @ w, w.sum(0)])

    check = _summed(rows, size, whitened_products, "double") / centre.n
    # the means are rounding errors of what was centred before
    error = float(np.abs(check[:-1] - np.outer(check[-1], check[-1]) - np.eye(count)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = _matrix(batch.column("x"), size)
                b = len(x)
                each = np.repeat(np.arange(b), count)
                apart = centre.deviations(x)
                places = (apart.astype(np.float64) / centre.n) @ projection
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), b)),
                        pa.array(np.full(b * count, centre.n, np.int64)),
                        pa.array(_deviation(apart), pa.int64()).take(pa.array(each)),
                        pa.array(places.ravel()),
                        pa.array(np.tile(explained, b)),
                        pa.array(np.full(b * count, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, schema)
