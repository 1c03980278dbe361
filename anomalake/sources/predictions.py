"""Saved predictions and caches: identity, shape and finite checks before anything is scored from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anomalake.functions.stats import finite


def audit(saved: DataFrame, truth: DataFrame, keys: list[str], shape: list[str], value: str) -> DataFrame:
    """(keys, problem) of predictions that can't be scored: without truth or prediction, repeated, of another shape, or not finite."""
    s = saved.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.max(c).alias(c) for c in shape), F.count_if(finite(F.col(value).cast("double")).isNull()).alias("_bad"))
    t = truth.select(*keys, *(F.col(c).alias(f"_t_{c}") for c in shape), F.lit(True).alias("_t"))
    j = s.join(t, keys, "full_outer")
    other = F.lit(False)
    for c in shape:
        other = other | ~F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    problem = F.when(F.col("_n").isNull(), "no prediction").when(F.col("_t").isNull(), "no truth").when(F.col("_n") > 1, "repeated").when(other, "shape").when(F.col("_bad") > 0, "not finite")
    return j.select(*keys, problem.alias("problem")).filter("problem is not null")


def lookup(wanted: DataFrame, cache: DataFrame, keys: list[str], shape: list[str], value: str) -> DataFrame:
    """Adds cached: ``hit`` where the cache has the key once, with the wanted shape and a finite value; ``stale`` where it has another; else ``miss``."""
    c = cache.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.max(x).alias(f"_c_{x}") for x in shape), F.count_if(finite(F.col(value).cast("double")).isNull()).alias("_bad"))
    same = (F.col("_n") == 1) & (F.col("_bad") == 0)
    for x in shape:
        same = same & F.col(x).eqNullSafe(F.col(f"_c_{x}"))
    return wanted.join(c, keys, "left").withColumn("cached", F.when(F.col("_n").isNull(), "miss").when(same, "hit").otherwise("stale")).select(*wanted.columns, "cached")


def index(entries: DataFrame, key: str, path: str, readable: str) -> DataFrame:
    """(key, path, copies): the first readable file, by path, that holds each key; unreadable ones are passed over."""
    return entries.filter(F.col(readable)).groupBy(key).agg(F.min(path).alias(path), F.count("*").alias("copies"))


def method_rows(rows: DataFrame, method: str, categories: DataFrame) -> DataFrame:
    """One method's row for each category; a category without exactly one is an error when the result is read."""
    m = rows.filter(F.col("method") == method)
    n = m.groupBy("category").agg(F.count("*").alias("_n"))
    bad = categories.select("category").distinct().join(n, "category", "full_outer").filter("_n is null or _n <> 1")
    guard = bad.agg(F.when(F.count("*") > 0, F.raise_error(F.concat(F.lit("incomplete: "), F.max("category").cast("string"))).cast("boolean")).otherwise(True).alias("_ok"))
    return m.join(F.broadcast(guard), F.col("_ok")).drop("_ok")  # one row


def manifest_problems(rows: DataFrame, side: int, transforms: int, version: str, most: int, category: str | None = None, split: str | None = None, seed: int | None = None, images: DataFrame | None = None, transform: Column | None = None) -> DataFrame:
    """(physical_id, problem) of patch-manifest rows that break a rule; the manifest is sound where there are none.

    ``rows`` is (category, split, image, x, y, transform_id, seed, version, physical_id). ``transform`` is the id that
    each row should have. An empty manifest, and one of more than ``most`` rows, give a row with a null id.
    """
    own = F.concat_ws("/", "category", "split", "image", F.col("x").cast("string"), F.col("y").cast("string"))
    rules = [
        ("identity", F.col("physical_id").eqNullSafe(own)),
        ("transform", F.col("transform_id").between(0, transforms - 1)),
        ("place", F.col("x").between(0, side - 1) & F.col("y").between(0, side - 1)),
        ("version", F.col("version") == version),
        ("category", F.lit(True) if category is None else F.col("category") == category),
        ("split", F.lit(True) if split is None else F.col("split") == split),
        ("seed", F.lit(True) if seed is None else F.col("seed") == seed),
        ("assignment", F.lit(True) if transform is None else F.col("transform_id") == transform),
    ]
    if images is not None:
        rows = rows.join(images.select("image").distinct().withColumn("_known", F.lit(True)), "image", "left")
        rules.append(("image", F.col("_known").isNotNull()))
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules)))
    each = rows.select("physical_id", F.explode(broken).alias("problem"))
    twice = rows.groupBy("physical_id").agg(F.count("*").alias("n")).filter("n > 1").select("physical_id", F.lit("repeated").alias("problem"))
    size = rows.agg(F.count("*").alias("n")).filter((F.col("n") == 0) | (F.col("n") > most)).select(F.lit(None).cast("string").alias("physical_id"), F.when(F.col("n") == 0, "empty").otherwise("too many").alias("problem"))
    return each.unionByName(twice).unionByName(size)
