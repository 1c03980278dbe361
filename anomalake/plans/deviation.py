"""Conditional normal-variation scoring: distances to a bank, and what is left of a deviation outside learned subspaces."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomalake.functions.vectors import normalized, subtract
from anomalake.operators import calibration, knn, selection, subspace

# The five scores.
METHODS = ("D0", "D1_Global", "D2_NVSGlobal", "D1_Proto", "D3_NVSProto")


@dataclass
class Deviation:
    """A fitted model: the bank with prototype labels, and orthonormal bases by prototype (None is the global one)."""

    bank: DataFrame  # id, vec, prototype
    features: dict  # prototype -> (mean, basis) of the vectors
    deltas: dict  # prototype -> (zeros, basis) of the transforms' differences

    def score(self, queries: DataFrame, k: int = 1) -> DataFrame:
        """(id, method, score) of queries (id, vec): the prototype is the nearest bank row's, or the vote of k of them."""
        q = queries.select("id", normalized(F.col("vec")).alias("vec"))
        near = knn.nearest(q, self.bank, max(1, k), "cosine")
        first = near.filter("rank = 1")
        if k > 1:
            proto = knn.vote(near, self.bank.select("id", F.col("prototype").alias("label"))).select("query_id", F.col("label").alias("prototype"))
        else:
            proto = first.join(self.bank.select(F.col("id").alias("bank_id"), "prototype"), "bank_id").select("query_id", "prototype")
        dev = first.join(q.withColumnsRenamed({"id": "query_id", "vec": "q"}), "query_id").join(self.bank.select(F.col("id").alias("bank_id"), F.col("vec").alias("m")), "bank_id").join(proto, "query_id")
        dev = dev.select(F.col("query_id").alias("id"), "distance", "prototype", subtract(F.col("q"), F.col("m")).alias("vec"))
        zero = lambda bases: {g: (np.zeros_like(b[0]), b[1]) for g, b in bases.items()}  # noqa: E731  a deviation is centred already
        out = dev.select("id", F.lit("D0").alias("method"), F.col("distance").alias("score"))
        for name, bases, by in (("D1_Global", self.features, None), ("D2_NVSGlobal", self.deltas, None), ("D1_Proto", self.features, "prototype"), ("D3_NVSProto", self.deltas, "prototype")):
            known = zero(bases)
            r = subspace.residuals(dev, known if by else {"": known[None]}, by)
            out = out.unionByName(r.select("id", F.lit(name).alias("method"), F.col("residual").alias("score")))
        return out


def fit(vectors: DataFrame, transformed: DataFrame, bank: DataFrame, prototypes: int = 4, rank: int = 8, least: int = 32, seed: int = 42) -> Deviation:
    """Fits on normal vectors (id, vec), their transforms (id, vec) and the chosen bank's ids.

    A prototype with fewer than ``least`` vectors uses the global bases.
    """
    v = vectors.select("id", normalized(F.col("vec")).alias("vec"))
    d = transformed.select("id", normalized(F.col("vec")).alias("t")).join(v, "id").select("id", subtract(F.col("t"), F.col("vec")).alias("vec"))
    cluster = subspace.spherical_kmeans(v, prototypes, seed).withColumnRenamed("cluster", "prototype")
    out = []
    for rows, centered in ((v, True), (d, False)):
        of = subspace.moments(rows.join(cluster, "id"), "prototype")
        total = [sum(x) for x in zip(*of.values(), strict=True)]
        bases = {g: subspace.basis(*m, rank=rank, centered=centered) for g, m in of.items() if m[0] >= least}
        bases[None] = subspace.basis(*total, rank=rank, centered=centered)
        out.append(bases)
    return Deviation(v.join(cluster, "id").join(bank.select("id"), "id", "left_semi"), *out)


def calibrated(scores: DataFrame, normal: DataFrame, image: str, quantile: float = 0.95) -> DataFrame:
    """(id, method, z, flagged): scores clamped on each method's own normal state; a method without one is an error."""
    state = calibration.clamped_mad(normal, ["method"], "score", image, quantile)
    j = scores.join(F.broadcast(state), "method", "left")
    m = F.when(F.col("mad").isNull(), F.raise_error(F.lit("a method isn't calibrated")).cast("double")).otherwise(F.col("mad"))
    return j.withColumn("z", calibration.clamped(F.col("score"), F.col("median"), m)).select("id", "method", "z", (F.col("z") >= F.col("threshold")).alias("flagged"))


def protocol_bank(vectors: DataFrame, name: str, seed: int = 42) -> DataFrame:
    """The ids of a named bank (see selection.PRESETS); vectors are (id, vec, group)."""
    strategy, size = selection.PRESETS[name]
    if strategy == "full" or vectors.count() <= size:
        return vectors.select("id")
    if strategy == "random":
        return selection.random_bank(vectors, "id", size, seed).select("id")
    if strategy == "merge_reduce":
        return selection.merge_reduce(vectors, size, max(1, -(-vectors.count() // 10_000)), seed=seed).select("id")
    if strategy == "image_balanced":
        quota = selection.round_robin_quota(vectors.groupBy("group").agg(F.count("*").alias("n")), "group", size)
        return selection.kcenter_bank(vectors, quota, "group", seed).select("id")
    one = vectors.withColumn("_all", F.lit(0))
    return selection.kcenter_bank(one, one.groupBy("_all").agg(F.lit(size).alias("quota")), "_all", seed).select("id")
