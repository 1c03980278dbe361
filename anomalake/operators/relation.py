"""Attention signatures and relation trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def signature(weights: DataFrame, keys: list[str], bins: int = 5) -> DataFrame:
    """One row a source: mass in ``bins`` radial bins, mass in ``bins`` rank bins, entropy.

    ``weights`` is (keys, target, distance, weight). Weights are taken over their sum; radial bins are equal parts of
    the source's largest distance; a weight's rank is its place by descending weight, ties to the smaller target.
    """
    whole = Window.partitionBy(*keys)
    w = weights.withColumn("_w", F.col("weight") / F.sum("weight").over(whole)).withColumn("_far", F.max("distance").over(whole)).withColumn("_n", F.count("*").over(whole))
    w = w.withColumn("_rank", F.row_number().over(whole.orderBy(F.desc("weight"), "target")) - 1)
    radial = F.least(F.floor(F.coalesce(F.try_divide(F.col("distance"), F.col("_far")), F.lit(0.0)) * bins), F.lit(bins - 1))
    rank = F.least(F.floor(F.col("_rank") * bins / F.col("_n")), F.lit(bins - 1))
    w = w.withColumn("_radial", radial).withColumn("_bin", rank)
    cols = [F.sum(F.when(F.col("_radial") == i, F.col("_w")).otherwise(0.0)).alias(f"radial_{i}") for i in range(bins)]
    cols += [F.sum(F.when(F.col("_bin") == i, F.col("_w")).otherwise(0.0)).alias(f"rank_{i}") for i in range(bins)]
    return w.groupBy(*keys).agg(*cols, (-F.sum(F.when(F.col("_w") > 0, F.col("_w") * F.ln("_w")).otherwise(0.0))).alias("entropy"))


def median_trajectory(long: DataFrame, keys: list[str], dim: str, value: str) -> DataFrame:
    """The coordinate-wise median over transforms."""
    return long.groupBy(*keys, dim).agg(F.percentile(value, F.lit(0.5)).alias("median"))


def normalized_trajectory(long: DataFrame, keys: list[str], dim: str, value: str, clip: float = 5.0) -> DataFrame:
    """Medians scaled by each coordinate's own median and interquartile range over all keys, clipped, then of unit L2 norm."""
    med = median_trajectory(long, keys, dim, value)
    stat = med.groupBy(dim).agg(F.percentile("median", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    z = med.join(F.broadcast(stat), dim).withColumn("z", (F.col("median") - F.col("q")[1]) / F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(1e-6)))
    z = z.withColumn("z", F.greatest(F.least("z", F.lit(clip)), F.lit(-clip)))
    n = F.greatest(F.sqrt(F.sum(F.col("z") * F.col("z")).over(Window.partitionBy(*keys))), F.lit(1e-12))
    return z.select(*keys, dim, (F.col("z") / n).alias("value"))


def agreement(a: DataFrame, b: DataFrame, key: str, cluster: str) -> DataFrame:
    """The share of keys with the same cluster in both tables."""
    return a.select(key, F.col(cluster).alias("_a")).join(b.select(key, F.col(cluster).alias("_b")), key).agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agreement"))
