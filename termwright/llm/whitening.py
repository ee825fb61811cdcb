"""Whitening of vectors: Welford updates in the partitions, a parallel merge of their moments, and a
symmetric QR eigen-solve of the d x d covariance.

A task holds one count, mean and scatter matrix (d x d doubles) and streams its rows through rank-one
updates. Moments are merged by sixteens until one is left, so neither the driver nor a task ever
meets more than sixteen of them; the driver gets one d x d matrix, whose size doesn't depend on the rows.
Each partition counts from its first vector: differences are taken before anything is multiplied, so an
offset of any size (a mean of 1,000,000 with a deviation of 8, say) costs no digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import Scratch

FAN_IN = 16
#: Components whose variance is below this part of the greatest one can't be told from rounding; they have no direction.
SMALLEST = 1e-12

_STATE = "part long, n long, pilot array<double>, mean array<double>, scatter array<double>"
_STATE_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64())] + [(c, pa.list_(pa.float64())) for c in ("pilot", "mean", "scatter")])


@dataclass
class Moments:
    """Of n vectors: the mean, relative to a pilot vector, and the scatter (sum of outer products of the centred ones)."""

    n: int
    pilot: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, vectors: Iterator[np.ndarray]) -> Moments | None:
        """Welford: one rank-one update per vector; None if there are no vectors."""
        n, pilot = 0, None
        for v in vectors:
            if pilot is None:
                pilot, mean = v.copy(), np.zeros(len(v))
                scatter, update = np.zeros((len(v), len(v))), np.empty((len(v), len(v)))
            n += 1
            y = v - pilot
            before = y - mean
            mean += before / n
            np.multiply(before[:, None], y - mean, out=update)
            scatter += update
        return None if pilot is None else cls(n, pilot, mean, (scatter + scatter.T) / 2)

    def merged(self, other: Moments) -> Moments:
        """The moments of both sets of vectors."""
        n = self.n + other.n
        apart = (other.pilot - self.pilot) + (other.mean - self.mean)
        return Moments(n, self.pilot, self.mean + apart * (other.n / n), self.scatter + other.scatter + np.outer(apart, apart) * (self.n / n * other.n))

    @property
    def covariance(self) -> np.ndarray:
        """With divisor n."""
        return self.scatter / self.n


def _batch(part: int, m: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": [part], "n": [m.n], "pilot": [m.pilot], "mean": [m.mean], "scatter": [m.scatter.ravel()]}, schema=_STATE_ARROW)


def _moments_of(column: pa.ListArray) -> np.ndarray:
    """The vectors of a batch as a matrix; all have one length and no nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _states(row: pa.RecordBatch | pa.Table) -> Iterator[Moments]:
    for n, pilot, mean, scatter in zip(*(row.column(c).to_pylist() for c in ("n", "pilot", "mean", "scatter")), strict=True):
        yield Moments(n, np.array(pilot), np.array(mean), np.array(scatter).reshape(len(mean), -1))


def moments(vectors: DataFrame, column: str) -> Moments | None:
    """Count, mean and scatter of an array column, all vectors of one length and without nulls (see ``usable``).
    None if there are no rows."""

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = Moments.of(v for b in batches if b.num_rows for v in _moments_of(b.column(0)))
        if found is not None:
            yield _batch(TaskContext.get().partitionId(), found)

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        whole = None
        for m in _states(table):
            whole = m if whole is None else whole.merged(m)
        return pa.Table.from_batches([_batch(key[0].as_py(), whole)])

    with Scratch(vectors.sparkSession) as scratch:
        states = scratch.written(vectors.select(F.col(f"`{column}`").alias("v")).mapInArrow(update, _STATE), "moments")
        last = states.agg(F.max("part")).first()[0]
        if last is None:
            return None
        while last > 0:
            states = states.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part").applyInArrow(merge, _STATE)
            last //= FAN_IN
        row = states.first()
    return Moments(row["n"], np.array(row["pilot"]), np.array(row["mean"]), np.array(row["scatter"]).reshape(len(row["mean"]), -1))


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: diagonal, off-diagonal and the rows of Q' with a = Q T Q'."""
    a, size = a.copy(), len(a)
    q = np.eye(size)
    for k in range(size - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v[0] += math.copysign(length, v[0])
        v /= np.linalg.norm(v)
        block = a[k + 1 :, k + 1 :]
        p = 2 * (block @ v)
        w = p - v * (v @ p)
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k] = a[k, k + 1] = -math.copysign(length, a[k + 1, k])
        a[k + 2 :, k] = a[k, k + 2 :] = 0
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and the unit eigenvectors as rows: Householder reduction to tridiagonal
    form, then QR steps with implicit Wilkinson shifts, off-diagonal entries being dropped once they are rounding."""
    d, e, q = _tridiagonal(np.asarray(matrix, dtype=np.float64))
    e = np.append(e, 0.0)
    eps = np.finfo(float).eps
    high = len(d) - 1
    for _ in range(60 * len(d)):
        small = np.abs(e[:high]) <= eps * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))
        e[:high][small] = 0
        while high > 0 and e[high - 1] == 0:
            high -= 1
        if high <= 0:
            break
        low = high - 1
        while low > 0 and e[low - 1] != 0:
            low -= 1
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + math.copysign(math.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            one, two, off = d[k], d[k + 1], e[k]
            d[k] = c * c * one + 2 * c * s * off + s * s * two
            d[k + 1] = s * s * one - 2 * c * s * off + c * c * two
            e[k] = (c * c - s * s) * off + c * s * (two - one)
            if k < high - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    else:
        raise ArithmeticError("the QR steps didn't converge: are all entries finite?")
    order = np.argsort(-d, kind="stable")
    return d[order], q[order]


@dataclass
class Whitening:
    """What maps a vector to whitened components: pilot and mean, and a row per component, scaled."""

    n: int
    pilot: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    scaled: np.ndarray

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.pilot) - self.mean) @ self.scaled.T


def usable(column: Column, length: int) -> Column:
    """Vectors of ``length`` entries, all of them finite numbers."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (F.size(column) == length) & ~bad


def length_of(vectors: DataFrame, column: str) -> int:
    """The commonest length of the vectors that hold no null and no other than finite numbers (ties: the greater);
    0 if there are none."""
    sizes = vectors.where(usable(F.col(f"`{column}`"), F.size(f"`{column}`"))).groupBy(F.size(f"`{column}`").alias("k")).count()
    found = sizes.orderBy(F.desc("count"), F.desc("k")).first()
    return found["k"] if found else 0


def fit(vectors: DataFrame, column: str, most: int = 32) -> Whitening | None:
    """The whitening by the first ``most`` principal components. Components without variance (constant or
    linearly dependent dimensions, fewer vectors than dimensions) are left out. None if there are no vectors."""
    m = moments(vectors, column)
    if m is None:
        return None
    values, rows = symmetric_qr(m.covariance)
    found = [k for k in range(min(most, len(values))) if values[k] > SMALLEST * max(values[0], 0) and values[k] > 0]
    total = np.trace(m.covariance)
    return Whitening(m.n, m.pilot, m.mean, values[found], values[found] / total if total else values[found], rows[found] / np.sqrt(values[found])[:, None])


def whitened(vectors: DataFrame, column: str, model: Whitening) -> DataFrame:
    """``vectors`` with the array column ``whitened`` beside the others, which come back in one struct column ``row``."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = model.of(_moments_of(b.column("v")))
                lists = pa.ListArray.from_arrays(np.arange(0, z.size + 1, max(z.shape[1], 1))[: len(z) + 1].astype(np.int32) if z.size else np.zeros(len(z) + 1, np.int32), z.ravel())
                yield pa.RecordBatch.from_arrays([b.column("row"), lists], names=["row", "whitened"])

    row = F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row")
    given = vectors.select(F.col(f"`{column}`").alias("v"), row)
    schema = given.select("row").schema.add("whitened", ArrayType(DoubleType()))
    return given.mapInArrow(project, schema)


def identity_error(vectors: DataFrame, column: str, model: Whitening) -> float:
    """The largest entry by which the covariance of the whitened vectors differs from the identity."""
    if not len(model.values):
        return 0.0
    again = moments(whitened(vectors.select(f"`{column}`"), column, model), "whitened")
    return float(np.abs(again.covariance - np.eye(len(model.values))).max())


def quantised(column: Column, scale: float = 64, offset: int = 1_000_000) -> Column:
    """floor(scale * c) + offset of each entry, as longs."""
    return F.transform(column, lambda c: F.floor(c.cast("double") * float(scale)).cast("long") + F.lit(offset))


def deviation(column: Column, n: int, sums: list[int]) -> Column:
    """Sum over the dimensions of (n * x - S) squared, in whole numbers; null where it is beyond a long."""
    total = F.array(*[F.lit(s).cast("long") for s in sums])
    part = F.zip_with(column, total, lambda x, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), x), s))
    return F.aggregate(part, F.lit(0).cast("long"), lambda a, p: F.try_add(a, F.try_multiply(p, p)))


def exact_sums(vectors: DataFrame, column: str, length: int) -> list[int]:
    """The sum of each dimension of an array of longs."""
    return list(vectors.agg(*[F.coalesce(F.sum(F.get(F.col(f"`{column}`"), F.lit(k)).cast("decimal(20,0)")), F.lit(0)).alias(f"s{k}") for k in range(length)]).first().asDict().values())


def whiten_embeddings(embeddings: DataFrame, id_column: str = "vec_id", column: str = "embedding", most: int = 32) -> DataFrame:
    """Per usable vector and component: the id, component (from 1), n, deviation, whitened, explained and
    identity_error.

    A vector that is null, holds null or no finite numbers, or is of another length than most, is left out (so
    is one with an entry beyond 2^46, whose quantised form has no exact double). Repeated rows and ids count
    each. Without vectors, or where none differs, there are no rows. Other columns may have any name."""
    given = embeddings.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    length = length_of(given, "v")
    kept = given.where(usable(F.col("v"), F.lit(length))).where(~F.exists("v", lambda c: F.abs(c) > float(1 << 46)))
    x = kept.select("id", quantised(F.col("v")).alias("x"))
    model = fit(x, "x", most)
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema).withColumn("id", F.col("id").cast(given.schema["id"].dataType)).withColumnRenamed("id", id_column)
    error, sums = identity_error(x, "x", model), [int(s) for s in exact_sums(x, "x", length)]
    found = whitened(x.withColumn("deviation", deviation(F.col("x"), model.n, sums)).select("id", "deviation", "x"), "x", model)
    explained = F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>")
    rows = found.select("row.id", "row.deviation", F.posexplode("whitened").alias("k", "w"))
    return rows.select(
        F.col("id").alias(id_column), (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("w").alias("whitened"), F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"),
    )
