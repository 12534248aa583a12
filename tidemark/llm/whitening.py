"""Whitening components of embedding vectors by shifted CholeskyQR over distributed Gram passes.

1. One pass counts the vectors and sums each dimension, in exact integers.
2. Gram passes: each task adds up the products of its centred rows Y, multiplied by the inverse of the triangular factor found so far
   (a triangular solve); cells are summed by a shuffle, so the driver gets one matrix of d x d numbers whatever the input. The first
   Gram matrix is shifted before its Cholesky factor is taken, which keeps it positive however ill-conditioned the rows are; later
   passes orthogonalise again until the rows are orthonormal to rounding. The factors compose to R with Y = Q R.
3. The last Gram matrix M = Q'Q (the identity but for rounding, and for directions in which the rows do not vary at all) goes into R as
   its square root, so R'R = Y'Y also where the rows do not span every dimension. The SVD of R gives the components V and the
   singular values s; eigenvalues of the covariance are s^2 / n.
4. A last pass measures the covariance of the whitened rows.

Vectors that are null or hold null or non-finite entries are dropped. Repeated rows and ids count as often as they stand there. The
rest must have one length, at most MAX_DIM, or the operator raises ValueError, as it does for entries so large that their fixed-point
value does not fit 53 bits. An empty table, one without variation (a single vector, equal vectors) and zero-length vectors have no
component and give no rows. Components whose eigenvalue is lost in rounding (d * 2^-52 of the largest) are left out; of equal
eigenvalues any orthonormal basis serves. Other columns are not read. There are no texts here, so long or empty texts do not occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
MAX_DIM = 4096
#: Rows that one matrix product takes at a time.
ROWS = 8192
PASSES = 12
EPS = np.finfo(float).eps


def fixed_point(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) whose vector is whole and finite."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce(
        ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")), F.lit(False)))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(good)


def _matrices(batches: Iterator[pa.RecordBatch], dim: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The record batches in parts of bounded size, with their vectors as fixed-point integers."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            flat = part.column(column).flatten().to_numpy(zero_copy_only=False)
            if len(flat) != dim * part.num_rows:
                raise ValueError("vectors of different lengths")
            x = np.floor(SCALE * flat)
            if len(x) and np.abs(x).max() >= 2.0**53:
                raise ValueError("an entry is too large for its fixed-point form")
            yield part, x.astype(np.int64).reshape(part.num_rows, dim) + OFFSET


def _sums(dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for part, x in _matrices(batches, dim):  # halves of the integers, so that no sum of 2^31 rows overflows
            n += part.num_rows
            high += (x >> 31).sum(axis=0)
            low += (x & ((1 << 31) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim), pa.int32()), pa.array(np.append(n, low)), pa.array(np.append(0, high))],
                                         names=["i", "low", "high"])

    return run


def _gram(dim: int, width: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """Cells (i <= j) of the sum of products of the rows that rows_of makes of fixed-point vectors; row -1 holds the rows' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, line = np.zeros((width, width)), np.zeros(width)
        for _, x in _matrices(batches, dim):
            y = rows_of(x)
            total += y.T @ y
            line += y.sum(axis=0)
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, np.full(width, -1)), pa.int32()), pa.array(np.append(j, np.arange(width)), pa.int32()),
             pa.array(np.append(total[i, j], line))], names=["i", "j", "value"])

    return run


def _sum_cells(rows: DataFrame, width: int, run: Callable) -> tuple[np.ndarray, np.ndarray]:
    cells = rows.select("embedding").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    matrix, line = np.zeros((width, width)), np.zeros(width)
    for i, j, value in cells.collect():  # bounded by width^2
        if i < 0:
            line[j] = value
        else:
            matrix[i, j] = matrix[j, i] = value
    return matrix, line


@dataclass
class Whitening:
    """n vectors with per-dimension sums; columns of `components` are unit eigenvectors by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int
    orthogonality: float
    identity_error: float = 0.0

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        return _centred(self.n, self.sums)


def _centred(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole) - rest  # the integer part leaves exactly, before anything is rounded


def orthogonalise(n: int, dim: int, gram: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(R, M, passes, distance of M from the identity): Y = Q R, M = Q'Q. gram(T) is the Gram matrix of Y T."""
    composed = np.eye(dim)
    matrix = gram(np.eye(dim))
    energy = float(np.trace(matrix))
    if not energy > 0:
        return np.zeros((dim, dim)), np.eye(dim), 1, 0.0
    distance = np.inf
    for done in range(1, PASSES):
        # 11 (n d + d (d + 1)) u |Y|^2 is the shift that keeps the factorisation from breaking down; later ones only where it would.
        shift = 11 * (n * dim + dim * (dim + 1)) * EPS / 2 * float(np.linalg.norm(matrix, 2)) if done == 1 else 0.0
        shift = min(shift, 1e-3 * float(np.linalg.norm(matrix, 2)))
        factor = None
        while factor is None:
            try:
                factor = np.linalg.cholesky(matrix + shift * np.eye(dim)).T
            except np.linalg.LinAlgError:
                shift = max(10 * shift, EPS * float(np.linalg.norm(matrix, 2)))
        composed = factor @ composed
        inverse = np.linalg.solve(composed, np.eye(dim))
        matrix = gram(inverse)
        last, distance = distance, float(np.abs(matrix - np.eye(dim)).max())
        if distance < 64 * dim * EPS or (done >= 3 and distance > 0.5 * last):
            break
    return composed, matrix, done + 1, distance


def fit(vectors: DataFrame) -> Whitening | None:
    """The whitening of all whole vectors; None where there is none."""
    rows = fixed_point(vectors)
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if not shape.n or not shape.most:
        return None
    if shape.least != shape.most:
        raise ValueError(f"vectors of different lengths, {shape.least} to {shape.most}")
    if shape.most > MAX_DIM:
        raise ValueError(f"vectors of {shape.most} entries; at most {MAX_DIM}")
    dim = shape.most
    sums, n = [0] * dim, 0
    kept = rows.select("embedding").mapInArrow(_sums(dim), "i int, low long, high long")
    for i, low, high in kept.groupBy("i").agg(F.sum(F.col("low").cast("decimal(38,0)")), F.sum(F.col("high").cast("decimal(38,0)"))).collect():
        if i < 0:
            n = int(low)
        else:
            sums[i] = int(low) + (int(high) << 31)
    centred = _centred(n, sums)

    def gram(right: np.ndarray) -> np.ndarray:
        return _sum_cells(rows, dim, _gram(dim, dim, lambda x: centred(x) @ right))[0]

    composed, matrix, passes, distance = orthogonalise(n, dim, gram)
    values, basis = np.linalg.eigh(matrix)
    root = (basis * np.sqrt(np.maximum(values, 0))) @ basis.T
    _, s, right = np.linalg.svd(root @ composed)
    eigenvalues = s**2 / n
    count = int((eigenvalues > dim * EPS * eigenvalues[0]).sum()) if eigenvalues[0] > 0 else 0
    found = Whitening(n, sums, right.T[:, :count], eigenvalues[:count], float(eigenvalues.sum()), passes, distance)
    return found if count else None


def _projector(model: Whitening, most: int) -> Callable[[np.ndarray], np.ndarray]:
    centred, right = model.centred(), model.components[:, :most] / np.sqrt(model.eigenvalues[:most])
    return lambda x: centred(x) @ right


def measure(vectors: DataFrame, model: Whitening, most: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from one more pass over all rows."""
    width = min(most, len(model.eigenvalues))
    products, line = _sum_cells(fixed_point(vectors), width, _gram(len(model.sums), width, _projector(model, width)))
    mean = line / model.n
    return float(np.abs(products / model.n - np.outer(mean, mean) - np.eye(width)).max())


def _squares(n: int, sums: list[int]) -> Callable[[np.ndarray], list[int]]:
    """Exact sum over dimensions of (n x - S)^2 of each row."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], dtype=object)

    def run(x: np.ndarray) -> list[int]:
        far = x - whole  # n x - S = n (x - whole) - rest
        reach = int(np.abs(far).max(initial=0)) + 1
        if len(sums) * (n * reach) ** 2 < 2**62:
            y = n * far - rest.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        y = n * far.astype(object) - rest
        return (y * y).sum(axis=1).tolist()

    return run


def _apply(model: Whitening, most: int, kind: pa.DataType) -> Callable:
    width, dim = min(most, len(model.eigenvalues)), len(model.sums)
    project, squares = _projector(model, width), _squares(model.n, model.sums)
    explained = model.eigenvalues[:width] / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, dim, column=1):
            rows = np.repeat(np.arange(part.num_rows), width)
            deviation = pa.array([str(v) for v in squares(x)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, width + 1), part.num_rows), pa.int32()),
                 pa.array(np.full(len(rows), model.n)), deviation.take(pa.array(rows)), pa.array(project(x).ravel()),
                 pa.array(np.tile(explained, part.num_rows)), pa.array(np.full(len(rows), model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def apply(vectors: DataFrame, model: Whitening, most: int = COMPONENTS) -> DataFrame:
    """A row per whole vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    deviation is the exact integer as decimal(38,0).
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = fixed_point(vectors).mapInArrow(_apply(model, most, None), f"vec_id {kind}, component int, n long, deviation string, whitened double, "
                                           "explained double, identity_error double")
    return rows.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Whitened rows by the components of the vectors themselves, at most `most` of them."""
    model = fit(vectors)
    if model is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, "
                                                    "explained double, identity_error double")
    model.identity_error = measure(vectors, model, most)
    return apply(vectors, model, most)
