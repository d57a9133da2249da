"""Whitening of embeddings by refined eigenvectors of their exact covariance.

Vectors become integers, ``floor(256 * c)``, and each distinct integer vector counts once.
Tasks add up products of vectors that are centred by the rounded mean; both are integers,
so the sums are exact in any order and reruns agree. What reaches the driver has the size
of the covariance, however many vectors there are. Its eigenvectors are found in float32
and refined by matrix products in extended precision (Ogita and Aishima); eigenvectors
whose eigenvalues lie too close together for that are separated by the eigenproblem of
their own subspace first.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.llm.common import fresh, materialize

SCALE = 256
#: Below this part of the largest eigenvalue, times the dimension, an eigenvalue counts as zero.
NOTHING = 2.0**-50


def refined_eigenvectors(matrix: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, falling, to double precision."""
    a = np.asarray(matrix, dtype=np.longdouble)
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / scale
    norm = np.sqrt((a * a).sum())
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    best, kept = np.inf, x
    for _ in range(rounds):
        defect = np.eye(len(a)) - x.T @ x
        rotated = x.T @ a @ x
        values = np.diag(rotated) / (1 - np.diag(defect))
        off = rotated - np.diag(values)
        error = np.sqrt((off * off).sum()) + norm * np.sqrt((defect * defect).sum())
        if error < best:
            best, kept = error, x
        if best < norm * 2.0**-58:
            break
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > 2 * error
        x = x + x @ np.where(far, (rotated + values[None, :] * defect) / np.where(far, gap, 1), defect / 2)
        for members in _clusters(values, 2 * error):
            x[:, members] = _separated(a, x[:, members])
    x = kept
    x = _orthonormal(x)
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Indices of eigenvalues that chains of small gaps join, two or more each."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def _separated(a: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A basis of the same subspace that is diagonal in it: its small matrix is shifted and scaled before it is solved."""
    small = basis.T @ a @ basis
    small = (small + small.T) / 2 - np.eye(len(small)) * np.trace(small) / len(small)
    size = np.abs(small).max()
    return basis @ np.linalg.eigh((small / size).astype(np.float64))[1].astype(np.longdouble) if size else basis


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """One step of Newton's iteration towards the nearest orthonormal matrix."""
    return x + x @ (np.eye(x.shape[1]) - x.T @ x) / 2


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums ``sums``; columns of ``vectors`` are components with falling ``values``."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float | None = None

    @property
    def projection(self) -> np.ndarray:
        """Columns that project a centred vector on components of unit variance; NaN where the variance is zero."""
        least = NOTHING * len(self.sums) * max(self.values[0], 0.0) if len(self.values) else 0.0
        return self.vectors / np.sqrt(np.where(self.values > least, self.values, np.nan))


def whole_vectors(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the integer vectors in ``name``, without the rows that have none: those with a
    null vector, an empty one, or a null or non-finite entry. Entries beyond 64 bits saturate."""
    entry = lambda c: c.cast("double")
    sound = F.forall(column, lambda c: F.coalesce(F.abs(entry(c)) < float("inf"), F.lit(False)))
    return df.where((F.size(column) > 0) & sound).withColumn(name, F.transform(column, lambda c: F.floor(entry(c) * SCALE)))


def fit(df: DataFrame, column: str = "embedding", components: int = 4) -> Whitening | None:
    """The whitening of the distinct integer vectors of a column; None if there is no vector.

    Vectors of the most frequent dimension (the larger one on a tie) count, others do not.
    Two passes over the distinct vectors, which are written to the shared folder once, give
    sums and products; a third measures the covariance of the whitened vectors.
    """
    distinct = materialize(whole_vectors(df.select(column), column, "x_").select("x_").distinct(), "vectors")
    sizes = distinct.groupBy(F.size("x_").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    if not sizes:
        return None
    d, n = sizes[0]
    vectors = distinct.where(F.size("x_") == d)
    sums = _added(vectors, lambda x: x.sum(0, dtype=np.float64)[None, :] if np.abs(x).max() < 2**30 else x.astype(np.longdouble).sum(0)[None, :], d)[0]
    centre = np.array([round(Fraction(s, n)) for s in sums], dtype=np.int64)
    products = _added(vectors, lambda x: _gram((x - centre).astype(np.float64)), d)
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    covariance = np.array([[_ratio(n * p - a * b, n * n) for p, b in zip(row, rest)] for row, a in zip(products, rest)], dtype=np.longdouble)
    values, found = refined_eigenvectors(covariance)
    k = min(components, d)
    model = Whitening(n, tuple(sums), float(np.trace(covariance)), values[:k], found[:, :k])
    return Whitening(n, model.sums, model.trace, model.values, model.vectors, _identity_error(vectors, model))


def _ratio(numerator: int, denominator: int) -> np.longdouble:
    """A quotient of integers of any size, rounded to extended precision."""
    whole, rest = divmod(numerator, denominator)
    return np.longdouble(whole) + np.longdouble(rest / denominator)


def _gram(z: np.ndarray) -> np.ndarray:
    return z.T @ z


def _added(vectors: DataFrame, part: callable, d: int) -> list[list[int]]:
    """A matrix of integers, ``part`` of the vectors added over all tasks.

    Parts are float64; blocks of rows are so short that every sum in one is exact (as long as
    entries have at most 26 bits). Halves of 32 bits are added as whole numbers by Spark.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = {}, {}
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for start in range(0, len(x), 1 << 13):
                m = part(x[start : start + (1 << 13)])
                top = np.floor(m / 2.0**32)
                for i, (h, rest) in enumerate(zip(top, (m - top * 2.0**32).astype(np.int64))):
                    high[i] = high[i] + h if i in high else h
                    low[i] = low[i] + rest if i in low else rest
        yield pa.RecordBatch.from_arrays([pa.array(list(high), pa.int32()), pa.array([h.astype(np.float64) for h in high.values()], pa.list_(pa.float64())), pa.array(list(low.values()), pa.list_(pa.int64()))], ["i", "high", "low"])

    rows = vectors.select("x_").mapInArrow(of, "i int, high array<double>, low array<bigint>")
    cells = rows.select("i", F.posexplode(F.arrays_zip("high", "low")).alias("j", "cell")).groupBy("i", "j").agg(F.sum("cell.high").alias("high"), F.sum("cell.low").alias("low"))
    found = cells.toArrow().to_pydict()
    out = [[0] * d for _ in range(max(found["i"], default=-1) + 1)]
    for i, j, high, low in zip(found["i"], found["j"], found["high"], found["low"]):
        out[i][j] = int(high) * 2**32 + low
    return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """x - S / n in float64: the whole part of the mean is taken away as integers."""
    whole = np.array([s // model.n for s in model.sums], dtype=np.int64)
    part = np.array([(s % model.n) / model.n for s in model.sums])
    return (x - whole).astype(np.float64) - part


def _identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity; None if no component has variance."""
    d, live = len(model.sums), ~np.isnan(model.projection[0])
    weights = model.projection[:, live]
    if not weights.size:
        return None

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((weights.shape[1] + 1, weights.shape[1]))
        for batch in batches:
            w = _centred(_matrix(batch.column(0), d), model) @ weights
            total += np.vstack([w.T @ w, w.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    rows = vectors.select("x_").mapInArrow(of, "i int, row array<double>")
    cells = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow().to_pydict()
    total = np.zeros((weights.shape[1] + 1, weights.shape[1]))
    total[cells["i"], cells["j"]] = cells["v"]
    mean = total[-1] / model.n
    return float(np.abs(total[:-1] / model.n - np.outer(mean, mean) - np.eye(len(mean))).max())


def whiten(df: DataFrame, model: Whitening | None, column: str = "embedding") -> DataFrame:
    """``df`` with a row for each component: component_ (from 1), deviation_ (decimal, the exact sum of
    squares of n * x - S) and whitened_. Rows without a vector of the model's dimension go, so
    that all go where there is no model.

    Repeated rows give equal rows; a component without variance has null values; a deviation
    of over 38 digits is null. Columns of ``df`` stay; where one bears a name of these three,
    the operator's has leading underscores (``fresh``).
    """
    names = [fresh(c, df) for c in ("component_", "deviation_", "whitened_")]
    x, found = fresh("x_", df), fresh("found_", df)
    d = len(model.sums) if model else -1
    rows = whole_vectors(df, column, x).where(F.size(x) == d)
    if model is None:
        return rows.drop(x).select("*", *(F.lit(None).cast(t).alias(c) for c, t in zip(names, ("int", "decimal(38,0)", "double")))).limit(0)
    weights, k = np.nan_to_num(model.projection), model.vectors.shape[1]
    dead = np.isnan(model.projection[0])
    whole = np.array([s // model.n for s in model.sums], dtype=np.int64)
    rest = np.array([s % model.n for s in model.sums], dtype=np.int64)
    own = sum(int(r) ** 2 for r in rest)
    at = rows.columns.index(x)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(at), d)
            w = _centred(m, model) @ weights
            z = m - whole
            if len(z) and np.abs(z).max() >= 2**24:
                squares, cross = (np.array([sum(a * b for a, b in zip(row, other)) for row, other in pairs], dtype=object) for pairs in ([(r.tolist(), r.tolist()) for r in z], [(r.tolist(), rest.tolist()) for r in z]))
            else:
                squares, cross = (z * z).sum(1).astype(object), (z.astype(np.float64) * rest).sum(1)
                cross = (z @ rest).astype(object) if np.abs(cross).max(initial=0) < 2**62 else np.array([sum(a * b for a, b in zip(r.tolist(), rest.tolist())) for r in z], dtype=object)
            deviation = [decimal.Decimal(v) if v < 10**38 else None for v in model.n**2 * squares - 2 * model.n * cross + own]
            entries = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))), pa.array(w.ravel(), mask=np.tile(dead, len(m)))], ["component", "whitened"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * k), entries)
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(deviation, pa.decimal128(38, 0)), lists], names=[*others, names[1], found])

    others = [c for c in rows.columns if c != x]
    own_fields = StructType.fromDDL(f"{names[1]} decimal(38,0), {found} array<struct<component:int,whitened:double>>").fields
    schema = StructType(rows.drop(x).schema.fields + own_fields)
    flat = rows.mapInArrow(of, schema).withColumn(found, F.explode(found))
    return flat.select(*others, F.col(found)["component"].alias(names[0]), names[1], F.col(found)["whitened"].alias(names[2]))
