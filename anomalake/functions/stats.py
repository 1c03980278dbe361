"""Scalar statistics as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normal quantile of the one-sided 95% bound, and the factor that makes a MAD an estimate of a deviation.
Z95, MAD_SCALE = 1.6448536269514722, 1.4826


def wilson_lower(successes: Column, n: Column, z: float = Z95) -> Column:
    """The one-sided lower Wilson bound; 0 without observations."""
    n = n.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(low, F.lit(0.0))).otherwise(0.0)


def finite(x: Column) -> Column:
    """NULL for NaN and infinities, as reports and JSON need it."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def robust(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and raw MAD of each group (two exact percentiles; the second pass joins the small median table back)."""
    med = df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.count(value).alias("n"))
    dev = df.join(med, by).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    return med.join(dev.groupBy(*by).agg(F.percentile("_d", F.lit(0.5)).alias("mad")), by)
