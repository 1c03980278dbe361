"""Subspaces, whitening and prototypes: Gram matrices are summed in Spark, small factorizations run on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(vectors: DataFrame, by: str | None = None) -> dict:
    """{group: (n, sum, Gram matrix)} of the column ``vec``; a task sends one matrix a group, whatever its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, list] = {}
        for b in batches:
            g = np.array(b.column(0).to_pylist(), object)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            for k in dict.fromkeys(g.tolist()):
                v = x[g == k]
                s = have.setdefault(k, [0, np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)])
                s[0], s[1], s[2] = s[0] + len(v), s[1] + v.sum(0), s[2] + v.T @ v
        for k, (n, s, m) in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([n]), pa.array([s.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["g", "n", "s", "m"])

    rows = vectors.filter("vec is not null").select(F.col(by).cast("string").alias("g") if by else F.lit("").alias("g"), "vec")
    out: dict = {}
    for r in rows.mapInArrow(run, "g string, n long, s binary, m binary").toLocalIterator():
        s = np.frombuffer(r.s)
        m = np.frombuffer(r.m).reshape(len(s), -1)
        n0, s0, m0 = out.get(r.g, (0, 0.0, 0.0))
        out[r.g] = (n0 + r.n, s0 + s, m0 + m)
    return out


def basis(n: int, total: np.ndarray, gram: np.ndarray, rank: int, centered: bool) -> tuple[np.ndarray, np.ndarray]:
    """(mean or zeros, the leading right singular vectors as rows, each with a positive largest entry)."""
    mean = total / n if centered else np.zeros_like(total)
    m = gram - n * np.outer(mean, mean)
    _, v = np.linalg.eigh(m)
    b = v[:, ::-1][:, :rank].T
    return mean, b * np.sign(b[np.arange(len(b)), np.abs(b).argmax(1)])[:, None]


def residuals(vectors: DataFrame, bases: dict, by: str | None = None, fallback: str | None = None) -> DataFrame:
    """(id, residual, explained): the norm left after projection on the group's basis, and the projected share of energy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            res, part = np.empty(len(x)), np.empty(len(x))
            g = np.array(b.column(1).to_pylist(), object)
            for k in dict.fromkeys(g.tolist()):
                mean, base = bases.get(k, bases.get(fallback))
                v = x[g == k] - mean
                p = v @ base.T
                e, t = (p * p).sum(1), (v * v).sum(1)
                res[g == k], part[g == k] = np.sqrt(np.maximum(t - e, 0)), e / np.maximum(t, 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(res), pa.array(part)], names=["id", "residual", "explained"])

    return vectors.filter("vec is not null").select("id", F.col(by).cast("string").alias("g") if by else F.lit("").alias("g"), "vec").mapInArrow(run, "id long, residual double, explained double")


def projector_distance(a: np.ndarray, b: np.ndarray) -> float:
    """The normalised Frobenius distance of the projectors on two bases of one rank."""
    r = len(a)
    return float(np.sqrt(max(0.0, 2 * r - 2 * ((a @ b.T) ** 2).sum()) / (2 * r)))


@dataclass
class Whitener:
    mean: np.ndarray
    reduce: np.ndarray  # rows of a basis
    factor: np.ndarray  # lower triangular

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.factor, ((x - self.mean) @ self.reduce.T).T).T


def _cholesky(c: np.ndarray) -> np.ndarray:
    jitter = 0.0
    for _ in range(8):
        try:
            return np.linalg.cholesky(c + jitter * np.eye(len(c)))
        except np.linalg.LinAlgError:
            jitter = max(jitter * 10, 1e-10 * float(np.trace(c)) / len(c))
    raise np.linalg.LinAlgError("the covariance can't be factored")


def pca_whitener(n: int, total: np.ndarray, gram: np.ndarray, rho: float = 0.99, shrinkage: float = 0.07, floor: float = 1e-6) -> Whitener:
    """Keeps ``rho`` of the variance, shrinks the covariance towards its mean variance, floors it, and factors it."""
    mean = total / n
    values, v = np.linalg.eigh(gram / n - np.outer(mean, mean))
    values, v = np.maximum(values[::-1], 0), v[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), rho) + 1)
    k = min(k, len(values))
    kept = values[:k]
    target = kept.mean()
    return Whitener(mean, v[:, :k].T, _cholesky(np.diag(np.maximum((1 - shrinkage) * kept + shrinkage * target, floor * max(target, 1e-300)))))


def ledoit_wolf(n: int, total: np.ndarray, gram: np.ndarray, fourth: float) -> tuple[Whitener, float]:
    """The whitener of the Ledoit-Wolf covariance, and its shrinkage; ``fourth`` is the sum of the centred rows' squared norms squared."""
    mean = total / n
    s = gram / n - np.outer(mean, mean)
    p = len(s)
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(delta, (fourth / n - (s**2).sum()) / n / p)
    share = 0.0 if delta == 0 else max(0.0, beta) / delta
    return Whitener(mean, np.eye(p), _cholesky((1 - share) * s + share * mu * np.eye(p))), share


def spectrum(values: np.ndarray) -> dict[str, float]:
    """Quantiles, condition number and effective rank (the exponential of the entropy) of eigenvalues."""
    v = np.sort(np.maximum(values, 0))
    p = v / max(v.sum(), 1e-300)
    p = p[p > 0]
    return {"min": float(v[0]), "median": float(np.median(v)), "max": float(v[-1]), "condition": float(v[-1] / max(v[0], 1e-12)), "effective_rank": float(np.exp(-(p * np.log(p)).sum()))}


def spherical_kmeans(vectors: DataFrame, k: int, seed: int = 42, most: int = 50) -> DataFrame:
    """(id, cluster) by k-means on cosine distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.filter("vec is not null").select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=most, distanceMeasure="cosine", predictionCol="cluster").fit(rows).transform(rows).select("id", "cluster")
