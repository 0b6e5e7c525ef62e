"""Whitening of embeddings: projections on the main components, each scaled to variance one.

A component c of a vector becomes the integer x = floor(SCALE * c) + SHIFT. The *fit list* has each distinct x vector
once; all statistics are over it: n vectors with sums S per dimension, which are exact.

The covariance is taken of centred vectors x - S / n. The numerator n x - S is an exact integer, so the centred number
is known as an unevaluated sum of two doubles. Outer products are added up by error-free transformations: each number is
cut into SLICES slices of SLICE_BITS bits on a common grid, so that the matrix product of two slices over BLOCK vectors
is exact in doubles; the exact products are added to a (high, low) pair by two-sum. Tasks send their pairs, row by row of
the matrix, and the pairs of all tasks are merged by two-sum again, as a stream in bounded memory.

The eigenvectors of the d x d matrix come from LAPACK's syevd (``numpy.linalg.eigh``): reduction to tridiagonal form,
then divide and conquer. A component whose eigenvalue is zero up to rounding can't be scaled: its whitened is null.

Rows with a null vector or any null or non-finite entry are dropped. Vectors shorter than the longest one count as if
padded with zeros. Entries count as at most +-2^40 / SCALE. Without rows left, or without dimensions, there are no rows.
deviation is null where it doesn't fit in a long. Repeated rows and ids and null ids are kept. Other columns take no part,
whatever their names. The driver holds the d x d matrix, and a task two of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage_table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LIMIT = float(1 << 40)
#: A product of two slices has 2 * SLICE_BITS bits, and the sum of BLOCK of them 10 more: 52.
SLICE_BITS, SLICES, BLOCK = 21, 4, 1024
#: An eigenvalue counts as zero below this share of the largest one.
ZERO = 1e-13


def usable(vector: Column) -> Column:
    """No null or non-finite entry."""
    return vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def as_integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c.cast("double") * SCALE))).cast("long") + SHIFT)


def matrix(column) -> np.ndarray:
    """The rows of an Arrow list column whose lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# ---- double-double: unevaluated sums high + low

def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, more: np.ndarray, less: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) + (more, less), with high the rounded sum."""
    s, e = two_sum(high, more)
    e = e + (low + less)
    high = s + e
    return high, e - (high - s)


class Moments:
    """Sums of vectors' outer products in double-double."""

    def __init__(self, d: int):
        self.high, self.low = np.zeros((d, d)), np.zeros((d, d))

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        """Takes in vectors, the rows of high + low."""
        for k in range(0, len(high), BLOCK):
            cut = slices(high[k : k + BLOCK], low[k : k + BLOCK])
            for i in range(SLICES):
                for j in range(SLICES - i):  # further pairs lie below the last bit of low
                    self.high, self.low = add(self.high, self.low, cut[i].T @ cut[j])


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """SLICES arrays that add up to high + low but for what is below the last grid; each is SLICE_BITS bits on a grid of its own."""
    top = np.abs(high).max(initial=0)
    grid = 2.0 ** (np.ceil(np.log2(top)) - SLICE_BITS + 1) if top > 0 else 1.0
    out = []
    for _ in range(SLICES):
        part = np.rint(high / grid) * grid
        high, low = two_sum(high - part, low)
        out.append(part)
        grid *= 2.0**-SLICE_BITS
    return out


# ---- over all rows

def sums(rows: DataFrame, column: str, d: int) -> list[int]:
    """The exact sum of each dimension of an array<long> column."""

    def run(batches):
        import pyarrow as pa

        total = [0] * d
        for batch in batches:
            if batch.num_rows:
                total = [a + b for a, b in zip(total, matrix(batch.column(0)).sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(x) for x in total])], ["k", "total"])

    parts = rows.select(column).mapInArrow(run, "k int, total string").groupBy("k").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [0] * d
    for r in parts.collect():  # a row for each dimension
        out[r["k"]] = int(r["total"] or 0)
    return out


def covariance(rows: DataFrame, column: str, d: int, n: int, centred: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The covariance, divisor n, of the vectors that ``centred`` makes, as (high, low), of a batch of the array column."""

    def run(batches):
        import pyarrow as pa

        own = Moments(d)
        for batch in batches:
            if batch.num_rows:
                own.add(*centred(matrix(batch.column(0))))
        yield as_batch(own.high, own.low)

    def as_batch(high, low):
        import pyarrow as pa

        rows = pa.array(range(d), pa.int32())
        return pa.RecordBatch.from_arrays([rows, *(pa.ListArray.from_arrays(pa.array(np.arange(0, d * d + 1, d, dtype=np.int32)), pa.array(x.ravel())) for x in (high, low))], ["row", "high", "low"])

    def merge(batches):
        import pyarrow as pa

        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows:
                for row, high, low in zip(batch.column(0).to_pylist(), matrix(batch.column(1)), matrix(batch.column(2)), strict=True):
                    own[row] = add(*own[row], high, low) if row in own else (high.copy(), low.copy())
        for row, (high, low) in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([high.tolist()]), pa.array([low.tolist()])], ["row", "high", "low"])

    schema = "row int, high array<double>, low array<double>"
    parts = rows.select(column).mapInArrow(run, schema)
    merged = parts.repartition("row").mapInArrow(merge, schema).collect()  # d rows of d numbers
    high = np.array([r["high"] for r in sorted(merged, key=lambda r: r["row"])])
    low = np.array([r["low"] for r in sorted(merged, key=lambda r: r["row"])])
    return high / n + low / n


def numerators(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S, exactly: longs where they fit, else Python's integers."""
    most = max([int(np.abs(x).max(initial=0)), 1])
    if n * most < 1 << 62 and all(abs(s) < 1 << 62 for s in total):
        return x * np.int64(n) - np.array(total, np.int64)
    return x.astype(object) * n - np.array(total, object)


def quotients(num: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """num / n as (high, low): the whole part, which is below 2^53, and the rest."""
    whole = num // n
    return two_sum(whole.astype(np.float64), (num - whole * n).astype(np.float64) / n)


def squares(num: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exactly; null where it doesn't fit in a long."""
    if num.dtype != object and num.shape[1] * float(np.abs(num).max(initial=0)) ** 2 < 2.0**62:
        return (num * num).sum(axis=1).tolist()
    out = [sum(v * v for v in row) for row in num.tolist()]
    return [v if v < 1 << 63 else None for v in out]


class Whitening:
    """The means as n and S, and the components: unit vectors by falling eigenvalue."""

    def __init__(self, n: int, total: list[int], v: np.ndarray, components: int):
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        trace = float(np.trace(v))
        self.n, self.total, self.values, self.vectors = n, total, values[order], vectors[:, order]
        self.usable = self.values > ZERO * max(float(values.max()), 0.0)
        self.explained = [max(float(e), 0.0) / trace if trace > 0 else None for e in self.values]

    def project(self, num: np.ndarray) -> np.ndarray:
        """The whitened vectors of rows given by their numerators; unusable components are 0."""
        high, low = quotients(num, self.n)
        scale = np.where(self.usable, 1 / np.sqrt(np.where(self.usable, self.values, 1)), 0)
        return (high @ self.vectors + low @ self.vectors) * scale


def fit(spark: SparkSession, x: DataFrame, d: int, components: int = COMPONENTS) -> tuple[Whitening, float | None]:
    """(whitening, identity error) of the distinct vectors of x (x array<long>, of d entries each).

    The identity error is the largest absolute entry of the covariance of the fit list's whitened vectors, centred by
    their mean, minus the identity, over components that can be scaled.
    """
    fit_list = stage_table(spark, x.select("x").distinct(), "whitening-fit-list")
    n = fit_list.count()
    total = sums(fit_list, "x", d)

    def centred(batch):
        return quotients(numerators(batch, n, total), n)

    model = Whitening(n, total, covariance(fit_list, "x", d, n, centred), components)
    used = np.flatnonzero(model.usable)
    if not len(used):
        return model, None

    def means(batches):
        import pyarrow as pa

        high, low = np.zeros(len(used)), np.zeros(len(used))
        for batch in batches:
            if batch.num_rows:
                high, low = add(high, low, model.project(numerators(matrix(batch.column(0)), n, total))[:, used].sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(used)), pa.int32()), pa.array(high), pa.array(low)], ["k", "high", "low"])

    mean = np.zeros(len(used))
    for r in fit_list.select("x").mapInArrow(means, "k int, high double, low double").groupBy("k").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        mean[r["k"]] = (r["high"] + r["low"]) / n

    def whitened(batch):
        return two_sum(model.project(numerators(batch, n, total))[:, used], -mean)

    identity = covariance(fit_list, "x", len(used), n, whitened)
    return model, float(np.abs(identity - np.eye(len(used))).max())


def whiten(spark: SparkSession, rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component from 1, n, deviation, whitened, explained, identity_error) for each usable row and component.

    deviation is the sum over dimensions of (n x - S)^2, exactly.
    """
    kept = rows.select(F.col(row_id).alias("vec_id"), F.col(vector).alias("vector")).where(usable(F.col("vector")))
    d = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    id_type = kept.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], schema)
    padded = F.concat("vector", F.array_repeat(F.lit(0).cast(kept.schema["vector"].dataType.elementType), F.lit(d) - F.size("vector")))
    x = kept.select("vec_id", as_integers(padded).alias("x"))
    model, error = fit(spark, x, d, components)
    shared = spark.sparkContext.broadcast(model)  # d x components numbers

    def run(batches):
        import pyarrow as pa

        model = shared.value
        k = len(model.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            num = numerators(matrix(batch.column(1)), model.n, model.total)
            m, white = len(num), model.project(num)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(squares(num), pa.int64()).take(pa.array(each)),
                 pa.array(white.ravel(), mask=np.tile(~model.usable, m)), pa.array(model.explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(run, schema)
