"""Connected regions of masks held as rows (image, y, x), their coverage, and region-based curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomalake.operators.ranking import counts_at, histogram, partial_area, running


def label_cells(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each cell the index of its 4-connected region's first cell in (y, x) order; union-find over sorted neighbours."""
    order = np.lexsort((x, y))
    place = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(y[order], x[order], strict=True))}
    parent = list(range(len(order)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (a, b), i in place.items():
        for near in ((a - 1, b), (a, b - 1)):
            j = place.get(near)
            if j is not None:
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    out = np.empty(len(order), np.int64)
    for i, at in enumerate(order):
        out[at] = root(place[int(y[at]), int(x[at])])
    return out


def regions(mask: DataFrame, image: list[str]) -> DataFrame:
    """(image, y, x, region): 4-connected regions of the mask's cells; an image is one group, bounded by its size."""
    fields = ", ".join(f"`{c}` {t}" for c, t in mask.select(*image).dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["y", "x"])
        return pdf[[*image, "y", "x"]].assign(region=label_cells(pdf["y"].to_numpy(), pdf["x"].to_numpy()))

    return mask.select(*image, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).groupBy(*image).applyInPandas(one, f"{fields}, y int, x int, region long")


def coverage(cells: DataFrame, image: list[str], predicted: str, image_cells: int, small: float = 0.001) -> DataFrame:
    """One row: regions, mean share of a region's cells that are predicted, and the same for regions of few cells."""
    per = cells.groupBy(*image, "region").agg(F.count("*").alias("size"), F.avg(F.col(predicted).cast("double")).alias("covered"))
    few = F.col("size") <= small * image_cells
    return per.agg(
        F.count("*").alias("region_count"),
        F.avg("covered").alias("region_mean_coverage"),
        F.count_if(few).alias("small_region_count"),
        F.avg(F.when(few, F.col("covered"))).alias("small_region_mean_coverage"),
    )


def region_curve(cells: DataFrame, pixels: DataFrame, thresholds: DataFrame, image: list[str], label: str, score: str, strict: bool) -> DataFrame:
    """(threshold, fpr, pro): background false-positive rate and mean region overlap at each threshold.

    A region's overlap at a threshold is a running count over its own sorted scores, so no product of thresholds and
    pixels is made; the regions' curves are summed as steps: each region cell adds 1/size from its score down.
    """
    size = cells.groupBy(*image, "region").agg(F.count("*").alias("size"))
    steps = cells.join(size, [*image, "region"]).select(F.col(score).cast("double").alias("score"), (F.lit(1.0) / F.col("size")).alias("w"))
    h = histogram(pixels, [], label, score)
    c = counts_at(h, thresholds, [], strict)
    t = thresholds.select(F.col("threshold").alias("score"), F.lit(0.0).alias("w"), F.lit(1).alias("_t")).distinct()
    rows = steps.groupBy("score").agg(F.sum("w").alias("w")).withColumn("_t", F.lit(0)).unionByName(t)
    then = [F.desc("_t") if strict else F.asc("_t")]
    n = size.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"))
    pro = running(rows, [], {"_w": F.col("w")}, then).filter("_t = 1").crossJoin(F.broadcast(n)).select(F.col("score").alias("threshold"), (F.col("_w") / F.col("_n")).alias("pro"))  # one row
    return c.join(pro, "threshold").select("threshold", F.try_divide(F.col("fp").cast("double"), F.col("negatives").cast("double")).alias("fpr"), "pro")


def aupro(curve: DataFrame, limit: float = 0.30, closed: bool = False) -> DataFrame:
    """The area under the curve up to the limit, over the limit; the curve starts at (0, 0) and, where closed, ends at (1, 1)."""
    start = curve.limit(1).select(F.explode(F.array(*(F.lit(float(v)) for v in ((0, 1) if closed else (0,))))).alias("fpr")).withColumn("pro", F.col("fpr"))
    return partial_area(curve.select("fpr", "pro").unionByName(start), [], limit)


def patch_mask(mask: DataFrame, image: list[str], scale: int) -> DataFrame:
    """A mask max-pooled to patches of scale x scale cells."""
    return mask.groupBy(*image, F.floor(F.col("y") / scale).cast("int").alias("py"), F.floor(F.col("x") / scale).cast("int").alias("px")).agg(F.max(F.col("truth").cast("int")).alias("truth"))


def evaluation_size(h: int, w: int) -> tuple[int, int]:
    """A quarter of each side, rounded down; a side below 4 is an error."""
    if min(h, w) < 4:
        raise ValueError("an image needs at least 4 rows and columns")
    return h // 4, w // 4


def bilinear(maps: DataFrame, image: list[str], size_in: tuple[int, int], size_out: tuple[int, int]) -> DataFrame:
    """Resizes maps of rows (image, y, x, score) by half-pixel bilinear interpolation: each output cell joins its four neighbours."""
    (h, w), (oh, ow) = size_in, size_out

    def axis(n: int, m: int, out: str, at: str, weight: str):
        i = F.col(out)
        pos = F.greatest((i + 0.5) * n / m - 0.5, F.lit(0.0))
        low = F.least(F.floor(pos).cast("int"), F.lit(n - 1))
        frac = pos - low
        return F.array(F.struct(low.alias(at), (1 - frac).alias(weight)), F.struct(F.least(low + 1, F.lit(n - 1)).alias(at), frac.alias(weight)))

    spark = maps.sparkSession
    ys = spark.range(oh).select(F.col("id").cast("int").alias("oy")).select("oy", F.explode(axis(h, oh, "oy", "y", "wy")).alias("a")).select("oy", "a.*")
    xs = spark.range(ow).select(F.col("id").cast("int").alias("ox")).select("ox", F.explode(axis(w, ow, "ox", "x", "wx")).alias("a")).select("ox", "a.*")
    got = maps.join(F.broadcast(ys), "y").join(F.broadcast(xs), "x")
    return got.groupBy(*image, "oy", "ox").agg(F.sum(F.col("score") * F.col("wy") * F.col("wx")).alias("score"))
