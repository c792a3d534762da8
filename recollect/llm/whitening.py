"""Whitening of embeddings on the leading components of their covariance.

The covariance is a sum of tasks' partial sums over the distinct quantised vectors; its components come from
spectral divide and conquer on polar decompositions (``qdwh``), on the driver, which sees a matrix of the
dimension's size and no vectors. The projection goes to all tasks and whitens every row where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import qdwh
from recollect.llm.common import sliced, written

COMPONENTS = 16
SCALE = 64
SHIFT = 1_000_000
#: Entries up to this size have squares whose sum over a vector is exact in a long.
SMALL = 1 << 24
LOW_BITS = 20


class Model(NamedTuple):
    """What tasks need of a dimension's fit: sizes, exact sums, and components scaled to unit variance."""

    n: int
    sums: list[int]
    base: np.ndarray  # the mean, rounded
    rest: np.ndarray  # what rounding took from the mean
    values: np.ndarray
    scaled: np.ndarray
    trace: float


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and x (floor(64 * entry) + 1000000) of the rows whose vector has entries, all of them finite."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    good = (F.size("embedding") > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), x.alias("x"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _summer(dim: int) -> Callable:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, "i8")
        for batch in batches:
            n += batch.num_rows
            total += _matrix(batch, dim).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype="i4")), pa.array(np.full(dim, n, "i8")), pa.array(total)], ["i", "n", "total"])

    return sums


def _squarer(dim: int, base: np.ndarray, rest: np.ndarray, turn: np.ndarray | None) -> Callable:
    """Partial sums of products of centred vectors, or of what ``turn`` makes of them; a row for each row of the matrix."""

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = dim if turn is None else turn.shape[1]
        total = np.zeros((size, size))
        for batch in batches:
            y = (_matrix(batch, dim) - base).astype("f8") - rest
            if turn is not None:
                y = y @ turn
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype="i4")), pa.array(list(total), pa.list_(pa.float64()))], ["i", "products"])

    return squares


def _products(fitted: DataFrame, run: Callable) -> np.ndarray:
    """The sum of all tasks' matrices, added up by cell before a row of each comes to the driver."""
    cells = fitted.select("x").mapInArrow(sliced(run), "i int, products array<double>").select("i", F.posexplode("products").alias("j", "p"))
    cells = cells.groupBy("i", "j").agg(F.sum("p").alias("p"))
    rows = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "p"))).alias("row")).orderBy("i").collect()  # as many as dimensions
    return np.array([[cell.p for cell in r.row] for r in rows])


def fit(fitted: DataFrame, dim: int, wanted: int = COMPONENTS) -> Model:
    """The model of distinct vectors x (all of ``dim`` entries): components by falling variance, those without any left out."""
    sums = fitted.select("x").mapInArrow(sliced(_summer(dim)), "i int, n long, total long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    found = sums.orderBy("i").collect()  # as many as dimensions
    n, total = found[0].n, [r.total for r in found]
    base = [(2 * s + n) // (2 * n) for s in total]
    rest = np.array([(s - n * b) / n for s, b in zip(total, base)])
    base = np.array(base, "i8")
    covariance = _products(fitted, _squarer(dim, base, rest, None)) / n
    values, vectors = qdwh.components(covariance, wanted)
    trace = float(np.trace(covariance))
    kept = values > qdwh.EPS * dim * trace
    return Model(n, total, base, rest, values[kept], vectors[:, kept] / np.sqrt(values[kept]), trace)


def identity_error(fitted: DataFrame, dim: int, model: Model) -> float:
    """The largest entry of the whitened distinct vectors' covariance less the identity."""
    found = _products(fitted, _squarer(dim, model.base, model.rest, model.scaled)) / model.n
    return float(np.abs(found - np.eye(len(found))).max())


def deviations(x: np.ndarray, model: Model) -> list[int]:
    """Sums over the dimensions of (n * x - S) ** 2, exact: from the entries less the rounded mean, and what that leaves of S."""
    n = model.n
    z = x - model.base
    s = [total - n * b for total, b in zip(model.sums, model.base.tolist())]
    own = sum(c * c for c in s)
    high = np.array([c >> LOW_BITS for c in s], "i8")
    low = np.array([c & (1 << LOW_BITS) - 1 for c in s], "i8")
    square, upper, lower = ((z * z).sum(1), z @ high, z @ low)
    out = [n * n * a - 2 * n * ((b << LOW_BITS) + c) + own for a, b, c in zip(square.tolist(), upper.tolist(), lower.tolist())]
    for i in np.flatnonzero(np.abs(z).max(1) > SMALL):  # long entries: one at a time
        out[i] = sum((n * c - total) ** 2 for c, total in zip(x[i].tolist(), model.sums))
    return out


WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _whitener(dim: int, model: Model, error: float) -> Callable:
    k = len(model.values)
    explained = model.values / model.trace

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dim)
            rows = len(x)
            y = ((x - model.base).astype("f8") - model.rest) @ model.scaled
            of = pa.array(np.repeat(np.arange(rows), k))
            deviation = pa.array([Decimal(v) for v in deviations(x, model)], pa.decimal128(38, 0)) if rows else pa.array([], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(of), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), rows)), pa.array(np.full(rows * k, model.n, "i8")),
                    deviation.take(of), pa.array(y.reshape(-1)), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return whiten


def whiten(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """A row for each row of ``vectors`` (vec_id, embedding) and each of the ``wanted`` leading components.

    Returns vec_id, component (from 1, by falling variance), n (distinct vectors), deviation (the sum of
    (n * x - S) ** 2, exact, as a decimal), whitened, explained and identity_error. Rows whose vector is null, empty, or holds null or
    non-finite entries take no part. The fit counts each distinct vector once; every row is whitened,
    also where a vec_id is null or repeated. Vectors of each dimension have a fit of their own, and components without
    variance (all, if vectors are one) no rows. An entry that is finite but too large for a long of 64ths is an error. An empty
    table gives none; other columns are left alone.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors.select("vec_id", "embedding"))
    fitted = written(rows.select("dim", "x").distinct(), "distinct-vectors")
    out = spark.createDataFrame([], WHITENED)
    for (dim,) in fitted.select("dim").distinct().orderBy("dim").collect():  # a row a dimension
        own = fitted.where(F.col("dim") == dim)
        model = fit(own, dim, wanted)
        if len(model.values):
            error = identity_error(own, dim, model)
            out = out.unionByName(rows.where(F.col("dim") == dim).select("vec_id", "x").mapInArrow(sliced(_whitener(dim, model, error)), WHITENED))
    return out
