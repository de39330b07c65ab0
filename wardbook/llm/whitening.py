"""Operator 13: embedding whitening with eigenvectors refined in mixed precision."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.vectors import matrix, whole_vectors
from wardbook.session import settle

LARGEST = float(1 << 40)  # components of this size or more are left out
CHUNK_ROWS = 1_024
EXACT_DOUBLE = 1 << 53
MOST_ROUNDS = 30


def _sums(rows: DataFrame, length: int, of_chunk) -> dict[int, int]:
    """Whole numbers by place, summed exactly over all rows; ``of_chunk`` gives those of at most CHUNK_ROWS vectors.

    A task sends a row per place at its end, so the shuffle has as many rows as
    places and tasks, and the driver gets one number per place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch, length)
            for at in range(0, len(x), CHUNK_ROWS):
                part = of_chunk(x[at : at + CHUNK_ROWS])
                total = part if total is None else total + part
        if total is not None:
            numbers = pa.array([str(t) for t in total.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), numbers], names=["place", "part"])

    partial = rows.select("x").mapInArrow(run, "place bigint, part string")
    summed = partial.groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    return {r["place"]: int(r["total"]) for r in summed.collect()}


def _column_sums(x: np.ndarray) -> np.ndarray:
    """Rows, then the sum of each dimension, as Python's whole numbers."""
    return np.array([len(x), *x.sum(0, dtype=object)], object)


def _products(centre: np.ndarray):
    """For each pair of dimensions i <= j the sum of products of components less the centre, exactly."""

    def run(x: np.ndarray) -> np.ndarray:
        y = x - centre
        upper = np.triu_indices(y.shape[1])
        if int(np.abs(y).max(initial=0)) ** 2 * len(y) < EXACT_DOUBLE:  # then doubles are exact too
            d = y.astype(np.float64)
            return (d.T @ d)[upper].astype(np.int64).astype(object)
        d = y.astype(object)
        return (d.T @ d)[upper]

    return run


def _long_double(number: int, divisor: int) -> np.longdouble:
    """number / divisor in extended precision."""
    q = (number << 80) // divisor
    return np.ldexp(np.longdouble(float(q >> 40)), -40) + np.ldexp(np.longdouble(float(q & ((1 << 40) - 1))), -80)


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of a symmetric matrix from approximate eigenvectors.

    Each round corrects all vectors at once by matrix products (Ogita and
    Aishima): R is what the vectors lack to orthogonality, S what the matrix is
    in their basis. Pairs whose eigenvalues are nearer than the error bound
    cannot be told apart by that; such clusters are first turned by the
    eigenvectors of the matrix restricted to them, shifted by the cluster's
    centre, which makes their small differences large. Equal eigenvalues stay
    one cluster: any orthonormal basis of their space is right.
    """
    unit = np.eye(len(a), dtype=a.dtype)
    size = np.linalg.norm(a.astype(np.float64), 2)
    rounding = 8 * len(a) * np.finfo(a.dtype).eps
    for _ in range(MOST_ROUNDS):
        # Kept exactly symmetric, so that corrections of near eigenvalues are rotations.
        r, s = (_symmetric(m) for m in (unit - x.T @ x, x.T @ (a @ x)))
        value = np.diag(s) / (1 - np.diag(r))
        rest = s - np.diag(value)
        if np.abs(r).max() <= rounding and np.abs(rest).max() <= rounding * size:
            break
        bound = 2 * (np.linalg.norm(rest.astype(np.float64), 2) + size * np.linalg.norm(r.astype(np.float64), 2))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > bound
        x = x + x @ np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
        _turn_clusters(a, x, value, bound, rounding * size)
    order = np.argsort(-value, kind="stable")
    return value[order], x[:, order]


def _symmetric(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2


def _turn_clusters(a: np.ndarray, x: np.ndarray, value: np.ndarray, bound: float, rounding: float) -> None:
    """Turn the vectors of each cluster in place by the eigenvectors of the matrix restricted to them."""
    order = np.argsort(value, kind="stable")
    ends = np.flatnonzero(np.r_[np.diff(value[order]) > bound, True]) + 1
    for start, end in zip(np.r_[0, ends[:-1]], ends):
        members = order[start:end]
        own = x[:, members]
        shifted = a - np.diag(np.full(len(a), value[members].mean(), a.dtype))
        inner = _symmetric(own.T @ (shifted @ own))
        if np.abs(inner - np.diag(np.diag(inner))).max() > rounding:
            _, basis = np.linalg.eigh((inner / np.abs(inner).max()).astype(np.float64))
            x[:, members] = own @ basis.astype(a.dtype)


@dataclass
class Whitening:
    """Counts and eigenvectors of the fit list; each task gets one copy, of the vectors' length squared at most."""

    n: int
    sums: list[int]
    centre: np.ndarray  # whole numbers next to the means
    offset: np.ndarray  # means less the centre
    trace: float
    values: np.ndarray  # falling
    vectors: np.ndarray  # a column per component

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; nan for a component without variance."""
        y = (x - self.centre).astype(np.float64) - self.offset
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (y @ self.vectors) / np.sqrt(np.maximum(self.values, 0)), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly; None beyond a long."""
        reach = max([self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0), 1])
        kind = np.int64 if reach**2 * max(len(self.sums), 1) < 1 << 63 else object
        d = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [t if t < 1 << 63 else None for t in (d * d).sum(1).tolist()]


def fit_whitening(fit: DataFrame, length: int, components: int) -> Whitening:
    """Covariance of the rows of ``fit`` in exact whole numbers, its eigenvectors from float32 up to extended precision.

    Two passes: the means, then products of centred components. The driver
    holds length squared numbers, so lengths up to some thousands are meant.
    """
    sums = _sums(fit, length, _column_sums)
    n, sums = sums.get(0, 0), [sums.get(i + 1, 0) for i in range(length)]
    if not n or not length:
        return Whitening(n, sums, np.zeros(length, np.int64), np.zeros(length), 0.0, np.zeros(0), np.zeros((length, 0)))
    centre = [(2 * s + n) // (2 * n) for s in sums]
    left = [s - n * c for s, c in zip(sums, centre)]  # sums of centred components, half of n at most
    products = _sums(fit, length, _products(np.array(centre, np.int64)))
    upper = list(zip(*(i.tolist() for i in np.triu_indices(length))))
    # n^2 times the covariance, whole numbers
    scaled = {(i, j): n * products[place] - left[i] * left[j] for place, (i, j) in enumerate(upper)}
    trace = sum(scaled[i, i] for i in range(length))
    chosen = min(components, length)
    values, vectors = np.zeros(chosen), np.eye(length)[:, :chosen]
    if trace:
        a = np.zeros((length, length), np.longdouble)
        for (i, j), number in scaled.items():
            a[i, j] = a[j, i] = _long_double(number, trace)
        _, start = np.linalg.eigh(a.astype(np.float32))
        share, x = refine(a, start.astype(np.longdouble))
        x = x * np.where(np.take_along_axis(x, np.abs(x).argmax(0)[None], 0) < 0, -1, 1)
        # Below what rounding leaves of zero there is no variance.
        share = np.where(share > np.finfo(np.float64).eps * length, share, 0)
        values = (share * (np.longdouble(1) * _long_double(trace, n * n)))[:chosen].astype(np.float64)
        vectors = x[:, :chosen].astype(np.float64)
    offset = np.array([s / n for s in left], np.float64)
    return Whitening(n, sums, np.array(centre, np.int64), offset, trace / (n * n), values, vectors)


def _projected(rows: DataFrame, model: Whitening, length: int) -> DataFrame:
    """(key, deviation, w) with w the whitened coordinates, null where there is no variance."""
    key = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, length)
            w = model.project(x)
            flat = pa.array(w.ravel(), mask=np.isnan(w).ravel())
            lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], flat)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(model.deviation(x), pa.int64()), lists], names=["key", "deviation", "w"])

    return rows.select("key", "x").mapInArrow(run, f"key {key}, deviation bigint, w array<double>")


def whiten(df: DataFrame, components: int = 4, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Whitening]:
    """(key, component, n, deviation, whitened, explained, identity_error) per kept vector and component, and the model.

    Components become whole numbers floor(scale * c); the covariance is that of
    the distinct whole vectors, each once, with divisor n. ``identity_error`` is
    measured by a pass over the same vectors. Components are numbered from 1 by
    falling eigenvalue; each has its largest entry positive.

    Vectors that are null, hold null or non-finite components, components of
    ``LARGEST`` or more, or differ in length from most are left out (see
    ``whole_vectors``). Repeated rows and null keys keep their rows. A vector shorter than
    ``components`` has as many components as dimensions. A component without
    variance has whitened null and explained 0 (null if nothing varies at all)
    and does not count for ``identity_error``, which is null if none varies. A
    ``deviation`` beyond a long is null. No vectors give no rows. Other columns
    are left out.
    """
    rows, length = whole_vectors(df, key, vector, scale, LARGEST)
    rows = settle(rows, "whole-vectors")
    # Copies meet before the shuffle, so a vector that very many rows share is one row per task.
    fit = settle(rows.select("x").distinct(), "fit-list")
    model = fit_whitening(fit, length, components)
    varying = [i for i, v in enumerate(model.values) if v > 0]
    pairs = [(i, j) for i in varying for j in varying if i <= j]
    error = None
    if pairs:
        spread = _projected(fit.select(F.lit(0).alias("key"), "x"), model, length)
        found = spread.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = [float(v) / model.trace if model.trace else None for v in model.values]
    out = _projected(rows, model, length).select("key", "deviation", F.posexplode("w").alias("at", "whitened"))
    shares = F.array(*[F.lit(e).cast("double") for e in explained]) if explained else F.array().cast("array<double>")
    return out.select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    ), model
