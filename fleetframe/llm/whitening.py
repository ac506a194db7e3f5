"""Whitening of embeddings by their polarisation covariance.

Entries become whole numbers, so that every sum is exact. With y an entry less the whole part of its dimension's mean, tasks add up y_i squared for every
dimension and (y_i + y_j) squared for every pair of dimensions. Each gives an exact variance, of an entry or of the sum of two, and half of what the
variance of a sum exceeds those of its parts is their covariance: all cross-covariances come from variances alone. Only the finished matrix is
rounded to doubles; its eigenvectors whiten the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import ship

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries at or beyond this size have no whole number here that could be squared and summed exactly in 38 digits.
LARGEST = 2.0**40
#: Rows summed at a time: squares of sums below 2^25, or limbs of larger ones, add up within 63 bits.
ROWS = 1024
SMALL = 1 << 24
LIMB = 26


def _rows(batch: pa.RecordBatch, dim: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, whole numbers) of the vectors of a batch that take part, for one dimension or for all that occur."""
    column = batch.column("vector")
    starts = column.offsets.to_numpy()
    valid = np.ones(len(column), bool) if not column.null_count else ~column.is_null().to_numpy(zero_copy_only=False)
    values = column.values
    flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False) if values.null_count else values.to_numpy(zero_copy_only=False)
    sizes = np.where(valid, np.diff(starts), 0)
    for size in np.unique(sizes[sizes > 0]).tolist() if dim is None else [dim]:
        rows = np.flatnonzero(sizes == size)
        c = flat[starts[rows][:, None] + np.arange(size)]
        good = (np.abs(c) < LARGEST).all(1)  # false for non-finite entries too
        yield size, rows[good], np.floor(SCALE * c[good]).astype(np.int64) + SHIFT


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def _entry_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for size, rows, x in _rows(batch, None):
            n[size] = n.get(size, 0) + len(rows)
            high, low = x >> LIMB, x & ((1 << LIMB) - 1)
            sums = high.sum(0).astype(object) * (1 << LIMB) + low.sum(0).astype(object)
            total[size] = total[size] + sums if size in total else sums
    for size, sums in total.items():
        if n[size]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, n[size])), _decimals(sums.tolist())],
                names=["dim", "i", "n", "sum"],
            )


def _squares(s: np.ndarray) -> np.ndarray:
    """Exact sums of the squares of each column, as Python numbers."""
    if not s.size or np.abs(s).max() < 2 * SMALL:
        return (s * s).sum(0).astype(object)
    high, low = s >> LIMB, s & ((1 << LIMB) - 1)
    parts = [(a * b).sum(0).astype(object) for a, b in ((high, high), (high, low), (low, low))]
    return parts[0] * (1 << 2 * LIMB) + parts[1] * (1 << (LIMB + 1)) + parts[2]


def _pair_sums(dim: int, middle: np.ndarray):
    """Per task the sums of squares of y_i (rows i, i) and of y_i + y_j (rows i, j)."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(dim - i, object) for i in range(dim)]
        seen = 0
        for batch in batches:
            for _, _, x in _rows(batch, dim):
                seen += len(x)
                for at in range(0, len(x), ROWS):
                    y = np.asfortranarray(x[at : at + ROWS] - middle)
                    for i in range(dim):
                        s = y[:, i:].copy()
                        s[:, 1:] += y[:, i : i + 1]
                        total[i] = total[i] + _squares(s)
        for i in range(dim if seen else 0):
            js = pa.array(np.arange(i, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim - i, i, np.int32)), js, _decimals(total[i].tolist())], names=["i", "j", "squares"])

    return of_batches


@dataclass
class Whitening:
    """The fitted list: its size, dimension, whole sums, covariance matrix, and the unit eigenvectors (columns) by falling eigenvalue."""

    n: int
    dim: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    def kept(self, components: int) -> int:
        """Components that can be scaled to variance one: those whose eigenvalue is more than rounding."""
        least = self.values[0] * self.dim * np.finfo(float).eps if len(self.values) else 0.0
        return int((self.values[:components] > max(least, 0.0)).sum())

    def explained(self) -> np.ndarray:
        trace = float(np.trace(self.covariance)) if self.dim else 0.0
        return self.values / trace if trace > 0 else np.zeros(len(self.values))

    def whole_means(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        """x - S / n on the components, each over the root of its eigenvalue."""
        rest = np.array([s % self.n / self.n for s in self.sums])
        k = self.kept(components)
        return ((x - self.whole_means()).astype(np.float64) - rest) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact sums over dimensions of (n * x - S) squared, and whether each fits 63 bits."""
        y, left = x - self.whole_means(), np.array([s % self.n for s in self.sums], np.int64)
        about = ((y.astype(np.float64) * self.n - left) ** 2).sum(1)
        # Arithmetic modulo 2^64 is exact for every sum that fits.
        d = (y.astype(np.uint64) * np.uint64(self.n)) - left.astype(np.uint64)
        exact, fits = (d * d).sum(1, dtype=np.uint64).astype(np.int64), about < 2.0**63
        for r in np.flatnonzero(np.abs(about / 2.0**63 - 1) < 1e-9):
            true = sum((self.n * int(a) - int(b)) ** 2 for a, b in zip(y[r], left, strict=True))
            fits[r] = true < 1 << 63
            exact[r] = true if fits[r] else 0
        return exact, fits


def _plain(vectors: DataFrame) -> DataFrame:
    ship(vectors.sparkSession)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))


def _outer_sums(model: Whitening, components: int):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.kept(components)
        once, twice = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, _, x in _rows(batch, model.dim):
                w = model.whitened(x, components)
                once += w.sum(0)
                twice += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([once.tolist()], pa.list_(pa.float64())), pa.array([twice.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["once", "twice"])

    return of_batches


def _identity_error(rows: DataFrame, model: Whitening, components: int) -> float:
    """How far the covariance of the whitened rows is from the identity, measured on the rows; tasks' sums are added entry by entry in Spark."""
    k = model.kept(components)
    sums = rows.mapInArrow(_outer_sums(model, components), "once array<double>, twice array<double>")
    at = lambda name: sums.select(F.posexplode(name).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    once, twice = np.zeros(k), np.zeros(k * k)
    for name, into in (("once", once), ("twice", twice)):
        for r in at(name):
            into[r["at"]] = r["v"]
    mean = once / model.n
    return float(np.abs(twice.reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of all rows of vectors (vec_id, embedding) that take part: those whose vector is not null or empty, holds no null, non-finite or
    oversized entry (LARGEST), and has the commonest length (of equally common ones the longest). The driver gets one row per pair of
    dimensions, whatever the number of rows is."""
    rows = _plain(vectors)
    sums = rows.mapInArrow(_entry_sums, "dim int, i int, n long, sum decimal(38,0)").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("sum").cast("decimal(38,0)").alias("sum"))
    commonest = sums.filter("i = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if commonest is None:
        return Whitening(0, 0, [], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    dim, n = commonest["dim"], commonest["n"]
    whole = [int(r["sum"]) for r in sums.filter(F.col("dim") == dim).orderBy("i").collect()]
    middle, left = np.array([s // n for s in whole], np.int64), [s % n for s in whole]
    pairs = rows.mapInArrow(_pair_sums(dim, middle), "i int, j int, squares decimal(38,0)").groupBy("i", "j").agg(F.sum("squares").cast("decimal(38,0)").alias("squares"))
    squares = {(r["i"], r["j"]): int(r["squares"]) for r in pairs.collect()}
    # n * n times the variances of entries and of sums of two, as whole numbers.
    single = [n * squares[i, i] - left[i] ** 2 for i in range(dim)]
    covariance = np.zeros((dim, dim))
    for i in range(dim):
        covariance[i, i] = single[i] / (n * n)
        for j in range(i + 1, dim):
            both = n * squares[i, j] - (left[i] + left[j]) ** 2
            covariance[i, j] = covariance[j, i] = (both - single[i] - single[j]) / (2 * n * n)
    values, basis = np.linalg.eigh(covariance)
    model = Whitening(n, dim, whole, covariance, values[::-1].copy(), basis[:, ::-1].copy())
    model.identity_error = _identity_error(rows, model, components)
    return model


def _projected(model: Whitening, components: int):
    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, share = model.kept(components), model.explained()
        for batch in batches:
            for _, rows, x in _rows(batch, model.dim):
                w = model.whitened(x, components)
                deviation, fits = model.deviations(x)
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows)).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(rows) * k, model.n, np.int64)),
                        pa.array(deviation, mask=~fits).take(each),
                        pa.array(w.reshape(-1)),
                        pa.array(np.tile(share[:k], len(rows))),
                        pa.array(np.full(len(rows) * k, model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return of_batches


def project(vectors: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per component of every row of vectors that takes part."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = _plain(vectors)
    if not model.n:
        return vectors.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(_projected(model, components), schema)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Fit on all rows of vectors (vec_id, embedding) and project all of them; see `fit` for the rows that take part.

    A component whose eigenvalue is no more than rounding gives no rows, so a single row or equal rows give none. Repeated rows and ids all count and
    all come back; a null vec_id stays null. A deviation beyond 63 bits is null. Other columns are ignored; an empty table gives no rows.
    """
    return project(vectors, fit(vectors, components), components)
