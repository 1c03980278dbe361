"""Patch manifests, and the paired bootstrap of false-positive rates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anomalake.functions.hashing import blake2b_u64

TRANSFORMS = 9


def patch_key(*extra: Column) -> Column:
    return F.concat_ws("|", "category", "split", "image", F.col("x").cast("string"), F.col("y").cast("string"), *extra)


def budgets(images: DataFrame, most: int, patches: int) -> DataFrame:
    """Adds budget: all patches where they fit, else equal shares of ``most``, the first images by path one more."""
    w = Window.partitionBy("category", "split")
    n = F.count("*").over(w)
    i = F.row_number().over(w.orderBy("image")) - 1
    share = F.floor(F.lit(most) / n) + F.when(i < F.lit(most) % n, 1).otherwise(0)
    return images.withColumn("budget", F.when(n * patches <= most, patches).otherwise(F.least(share, F.lit(patches))).cast("int"))


def transform_manifest(images: DataFrame, side: int, most: int, seed: int = 42) -> DataFrame:
    """(category, split, image, x, y, transform_id, seed, physical_id): each image's patches in hash order up to its budget.

    ``images`` is (category, split, image). The coordinates' order is the same for all images of a (category, split),
    so only a side x side table is hashed and ranked for each.
    """
    grid = images.select("category", "split").distinct().select("category", "split", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("cell"))
    grid = grid.select("category", "split", (F.col("cell") % side).alias("x"), F.floor(F.col("cell") / side).cast("int").alias("y"))
    order = blake2b_u64(F.concat_ws("|", "category", "split", F.col("x").cast("string"), F.col("y").cast("string"), F.lit(str(seed))))
    ranked = grid.withColumn("_o", order).withColumn("_r", F.row_number().over(Window.partitionBy("category", "split").orderBy("_o", "y", "x")))
    rows = budgets(images, most, side * side).join(ranked, ["category", "split"]).filter(F.col("_r") <= F.col("budget"))
    transform = F.pmod(blake2b_u64(patch_key(F.lit(str(seed)))), F.lit(TRANSFORMS).cast("decimal(20,0)")).cast("int")
    return rows.select("category", "split", "image", "x", "y", transform.alias("transform_id"), F.lit(seed).alias("seed"), patch_key().alias("physical_id"))


def paired_bootstrap(normals: DataFrame, base: str, candidate: str, seed: int, samples: int = 2000) -> dict:
    """The difference of two false-positive rates over the same normal images, with a 95% interval.

    A resample of n images only matters through how many of the three differences (-1, 0, 1) it draws, so three counts
    reach the driver and each resample is one multinomial draw.
    """
    d = (F.col(candidate).cast("int") - F.col(base).cast("int")).alias("d")
    count = {r.d: r.n for r in normals.select(d).groupBy("d").agg(F.count("*").alias("n")).collect()}
    n = sum(count.values())
    if not n:
        raise ValueError("there are no normal images")
    p = np.array([count.get(k, 0) for k in (-1, 0, 1)]) / n
    draw = np.random.default_rng(seed).multinomial(n, p, size=samples)
    deltas = (draw[:, 2] - draw[:, 0]) / n
    return {"images": n, "samples": samples, "delta": float(p[2] - p[0]), "low": float(np.quantile(deltas, 0.025)), "high": float(np.quantile(deltas, 0.975))}
