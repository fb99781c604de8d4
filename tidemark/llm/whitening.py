"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations (operator 12).

Entries are put on a whole-number grid first, so that their sums are exact and no order of tasks changes them. Spark
adds up counts and sums, then the scatter of the centred vectors: every task gives one matrix, and the matrices are
added in as many tasks as the square root of the shuffle partitions before one task adds what they give. The scatter, a
matrix of the dimension's size whatever the number of vectors, is factored on the driver: Cholesky with the largest
remaining pivot first, then rotations of pairs of columns of the triangular factor itself until all are orthogonal.
Their squared norms are the eigenvalues, the normalised columns the components; the scatter's condition is never
squared again. The covariance of the whitened vectors is then measured over all of them.

Defined results: vectors that are null, empty or hold null or non-finite entries are left out, and so are those of
another length than the most frequent (of ties the longest); null and repeated ids and repeated rows count one by one;
directions without variance have no component, so equal vectors, one vector and an empty table give no rows; extra
columns of any name are ignored. Where n times an entry passes 2**62 the means are those of doubles, and a deviation
that no long can hold is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches

#: Entries that a task handles at a time.
ENTRIES = 1 << 20


@dataclass
class Whitening:
    """``components`` has a unit column each, by falling ``values`` (their variances); ``total`` is the trace."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    exact: bool
    components: np.ndarray
    values: np.ndarray
    total: float
    identity_error: float = 0.0


def on_grid(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000, column: str = "embedding") -> DataFrame:
    """(vec_id, x): ``floor(scale * entry) + offset`` as longs, of the vectors that can be used."""
    whole = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = vectors.select("vec_id", F.col(column).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", whole))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long") + offset).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches with their vectors as a matrix of longs."""
    step = max(1, ENTRIES // size)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _added(rows: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], np.ndarray], kind: str) -> np.ndarray:
    """The sum of what ``fold`` makes of each task's rows, by way of some tasks that add first."""
    dtype = np.float64 if kind == "double" else np.int64

    def given(sum_: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([sum_.ravel()], pa.list_(pa.from_numpy_dtype(dtype)))], ["part"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield given(fold(batches))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sum_ = None
        for batch in batches:
            for part in batch.column("part"):
                more = part.values.to_numpy(zero_copy_only=False)
                sum_ = more.astype(dtype) if sum_ is None else sum_ + more
        if sum_ is not None:
            yield given(sum_)

    schema, few = f"part array<{kind}>", max(1, isqrt(partitions(rows.sparkSession)))
    parts = rows.mapInArrow(each, schema).repartition(few).mapInArrow(together, schema)
    found = parts.repartition(1).mapInArrow(together, schema).collect()  # one row
    return np.array(found[0].part, dtype)


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``order`` and a lower triangular ``factor`` with ``a[order][:, order] = factor @ factor.T``. The largest
    remaining pivot comes first; the factor ends where of every diagonal entry only its own rounding is left."""
    a, size = np.array(a, float), len(a)
    order, left, factor = np.arange(size), np.diag(a).copy(), np.zeros(a.shape)
    least = size * np.finfo(float).eps * left
    for k in range(size):
        more = left[k:] > least[k:]
        if not more.any():
            return order, factor[:, :k]
        p = k + int(np.argmax(np.where(more, left[k:], -1)))
        swap = [p, k]
        for x in (a, a.T, order, left, least, factor):
            x[[k, p]] = x[swap]
        factor[k, k] = np.sqrt(left[k])
        factor[k + 1 :, k] = (a[k + 1 :, k] - factor[k + 1 :, :k] @ factor[k, :k]) / factor[k, k]
        left[k + 1 :] -= factor[k + 1 :, k] ** 2
    return order, factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` times rotations that make its columns orthogonal. In each round every column is in one pair, and all
    pairs of a round turn together; a sweep pairs all columns."""
    g = np.concatenate([factor, np.zeros((len(factor), factor.shape[1] % 2))], axis=1)
    seat = np.arange(g.shape[1])
    enough = max(len(g), 10) * np.finfo(float).eps
    for _ in range(sweeps):
        largest = 0.0
        for _ in range(len(seat) - 1):
            i, j = seat[: len(seat) // 2], seat[len(seat) // 2 :][::-1]
            x, y = g[:, i], g[:, j]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            angle = np.abs(c) / np.sqrt(np.where(a * b > 0, a * b, 1))
            largest = max(largest, float(angle.max(initial=0)))
            turn = angle > enough
            zeta = np.where(turn, b - a, 0) / np.where(turn, 2 * c, 1)
            t = np.where(turn, np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0)
            cos = 1 / np.sqrt(1 + t * t)
            g[:, i], g[:, j] = cos * x - cos * t * y, cos * t * x + cos * y
            seat = np.concatenate([seat[:1], np.roll(seat[1:], 1)])
        if largest <= enough:
            break
    return g[:, : factor.shape[1]]


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a scatter matrix, falling, and their unit vectors as columns; those of rounding size are left out."""
    order, factor = pivoted_cholesky(scatter)
    turned = one_sided_jacobi(factor)
    square = (turned * turned).sum(0)
    by = np.argsort(-square, kind="stable")
    by = by[square[by] > len(scatter) * np.finfo(float).eps * square.max(initial=0)]
    vectors = np.zeros(turned.shape)
    vectors[order] = turned[:, by] / np.sqrt(square[by])
    return square[by], vectors


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    return (model.n * x - model.sums) / model.n if model.exact else x - model.mean


def fit(rows: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of all of ``rows`` (x), from ``on_grid``; None where no direction has variance."""
    size = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if size is None:
        return None
    n, size = size.n, size.size
    rows = small_batches(rows.filter(F.size("x") == size).select("x"))

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        return sum((x.sum(0) for _, x in _blocks(batches, size)), np.zeros(size, np.int64))

    def doubles(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        return sum((x.astype(float).sum(0) for _, x in _blocks(batches, size)), np.zeros(size))

    ends = rows.agg(F.max(F.array_max("x")).alias("high"), F.min(F.array_min("x")).alias("low")).first()
    exact = n * max(abs(ends.high), abs(ends.low)) < 1 << 62
    whole = _added(rows, sums, "long") if exact else np.zeros(size, np.int64)
    mean = whole / n if exact else _added(rows, doubles, "double") / n
    model = Whitening(n, whole, mean, exact, np.zeros((size, 0)), np.zeros(0), 0.0)

    def scatter(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((size, size))
        for _, x in _blocks(batches, size):
            c = _centred(x, model)
            total += c.T @ c
        return total

    v = _added(rows, scatter, "double").reshape(size, size) / n
    values, vectors = principal(v)
    if not len(values):
        return None
    model.values, model.components, model.total = values[:components], vectors[:, :components], float(np.trace(v))

    def again(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        k = len(model.values)
        total = np.zeros((k, k))
        for _, x in _blocks(batches, size):
            z = _projected(x, model)
            total += z.T @ z
        return total

    k = len(model.values)
    left = _added(rows, again, "double").reshape(k, k) / n - np.eye(k)
    model.identity_error = float(np.abs(left).max())
    return model


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    return _centred(x, model) @ model.components / np.sqrt(model.values)


def whitened(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """(vec_id, deviation, whitened) of ``rows`` (vec_id, x): the entries of ``whitened`` belong to the components in
    their order; ``deviation`` is the sum over dimensions of ``(n * x - sums) ** 2``. No rows without a model."""
    kind = "vec_id long, deviation long, whitened array<double>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    if model is None:
        return rows.filter("false").selectExpr("vec_id", "vec_id AS deviation", "cast(x AS array<double>) AS whitened")
    size = len(model.mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, size):
            far = model.n * x - model.sums
            about = (far.astype(float) ** 2).sum(1) if model.exact else np.full(len(x), np.inf)
            deviation = pa.array((far * far).sum(1), pa.int64(), mask=about > 9.2e18)
            z = _projected(x, model)
            offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), deviation, lists], ["vec_id", "deviation", "whitened"])

    return small_batches(rows.filter(F.size("x") == size)).mapInArrow(run, kind)


def by_component(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each of ``whitened``'s rows and components: vec_id, component from 1, n, deviation, whitened,
    explained (the component's share of all variance) and identity_error."""
    shares = model.values / model.total if model else []
    one: Column = F.array(*[F.lit(float(s)) for s in shares]).cast("array<double>")
    found = whitened(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return found.select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(one, F.col("k")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
