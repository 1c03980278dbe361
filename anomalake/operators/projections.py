"""Scores as projections over layers, calibration pivots, pooled thresholds, grids and resource estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def weights_of(raw: Column, total: Column) -> Column:
    """(max(w, 0) + 1e-8) over its sum."""
    return (F.greatest(raw, F.lit(0.0)) + 1e-8) / total


def method_scores(long: DataFrame, weights: DataFrame, keys: list[str], labels: dict[str, str]) -> DataFrame:
    """One row a key: raw mean, each layer alone, equal means of the two calibrated forms, and weighted means of ``ecdf``.

    ``long`` is (keys, layer, raw, ecdf, mad) with a label column for each weighted method in ``labels``;
    ``weights`` is (method, label, layer, weight), the rows with a null label being the global ones, which also serve
    where a label is null or has none. A weight's table is a row a layer and label, so it is joined, not collected.
    """
    layers = sorted(r.layer for r in long.select("layer").distinct().collect())  # a few by construction
    glob = weights.filter("label is null").select("layer", F.col("weight").alias("_g"))
    got = long.join(glob, "layer")
    for method, label in labels.items():
        own = weights.filter((F.col("method") == method) & F.col("label").isNotNull()).select("layer", F.col("label").alias(label), F.col("weight").alias(f"_w_{method}"))
        got = got.join(own, ["layer", label], "left")
    lifted = {"Global": F.greatest("_g", F.lit(0.0)) + 1e-8} | {m: F.greatest(F.coalesce(f"_w_{m}", "_g"), F.lit(0.0)) + 1e-8 for m in labels}
    return got.groupBy(*keys).agg(
        F.avg("raw").alias("Official"),
        *(F.max(F.when(F.col("layer") == x, F.col("raw"))).alias(f"L_{x}") for x in layers),
        F.avg("ecdf").alias("ECDF_Equal"),
        F.avg("mad").alias("MAD_Equal"),
        *((F.sum(w * F.col("ecdf")) / F.sum(w)).alias(m) for m, w in lifted.items()),
    )


def five_maps(base: Column, first: Column, second: Column) -> list[Column]:
    """The base map, two heads, and each head's even blend with the base."""
    return [base.alias("base"), first.alias("first"), second.alias("second"), ((base + first) / 2).alias("base_first"), ((base + second) / 2).alias("base_second")]


def conditional_residual(v: Column, common: Column, local: Column, weight: Column) -> Column:
    """The norm of v less (1 - weight) times its common and weight times its local projection; arrays of one length."""
    projected = F.zip_with(common, local, lambda a, b: (1 - weight) * a + weight * b)
    return F.sqrt(F.aggregate(F.zip_with(v, projected, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))


def pivot_state(rows: DataFrame, key: str, layers: list) -> DataFrame:
    """(key, median_<layer>, scale_<layer>) from calibration rows (key, layer, median, scale); a missing layer is null."""
    return rows.groupBy(key).agg(*(F.max(F.when(F.col("layer") == x, F.col(c))).alias(f"{c}_{x}") for x in layers for c in ("median", "scale")))


def unpivot_state(wide: DataFrame, key: str, layers: list) -> DataFrame:
    """Calibration rows (key, layer, median, scale) back from the wide form; layers that are null there give none."""
    cells = F.array(*(F.struct(F.lit(x).alias("layer"), F.col(f"median_{x}").alias("median"), F.col(f"scale_{x}").alias("scale")) for x in layers))
    return wide.select(key, F.explode(cells).alias("x")).select(key, "x.*").filter("median is not null")


def pooled_threshold(df: DataFrame, by: list[str], value: str, percent: float, factor: float = 1.0) -> DataFrame:
    """(by, n, threshold): a percentile of all pooled values, linear between ranks, times a factor."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), (F.percentile(value, F.lit(percent / 100)) * factor).alias("threshold"))


def value_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, missing, not_finite, sound): whether a column has values and all are finite; one pass over the rows."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))
    v = F.col("x.v")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    g = df.select(F.explode(cells).alias("x")).groupBy(F.col("x.column").alias("column")).agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("missing"), F.count_if(F.coalesce(odd, F.lit(False))).alias("not_finite"))
    return g.withColumn("sound", (F.col("n") > 0) & (F.col("missing") == 0) & (F.col("not_finite") == 0))


def candidate_resources(images: DataFrame, by: list[str], patch: int, width: int, most: int, index: str | None = None, every: int = 8) -> DataFrame:
    """(by, images, patches, bytes, entries): patches of whole cells, float32 bytes of their vectors, and entries within a bank.

    With ``index``, every ``every``-th image is kept out, as it calibrates.
    """
    used = images if index is None else images.filter(F.col(index) % every != 0)
    n = (F.floor(F.col("h") / patch) * F.floor(F.col("w") / patch)).cast("long")
    g = used.groupBy(*by).agg(F.count("*").alias("images"), F.sum(n).alias("patches"))
    return g.withColumns({"bytes": F.col("patches") * width * 4, "entries": F.least("patches", F.lit(most).cast("long"))})


def crops(length: Column, size: int, step: int) -> Column:
    """Crops of ``size`` that cover a side of ``length``, ``step`` apart, the last one flush with the end."""
    return F.when(length <= size, 1).otherwise(F.ceil((length - size) / step) + 1).cast("int")


def grid_distances(spark: SparkSession, side: int) -> DataFrame:
    """(a, b, dy, dx, distance) of every two cells of a side x side grid: a fixed table of side**4 rows, by arithmetic."""
    n = side * side
    c = spark.range(n * n).select((F.col("id") / n).cast("int").alias("a"), (F.col("id") % n).cast("int").alias("b"))
    y, x = (lambda k: F.floor(F.col(k) / side)), (lambda k: F.col(k) % side)
    return c.select("a", "b", (y("b") - y("a")).cast("int").alias("dy"), (x("b") - x("a")).cast("int").alias("dx")).withColumn("distance", F.sqrt((F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).cast("double")))


def product(spark: SparkSession, **values: list) -> DataFrame:
    """Every combination of some parameters' values; the table is as large as the product of the short lists."""
    out = spark.range(1).select()
    for name, v in values.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, v))).alias(name))
    return out


def mismatches(expected: dict, actual: dict) -> dict:
    """{name: (expected, actual)} of settings that differ, at any depth, by dotted names."""
    out = {}
    for k in sorted({*expected, *actual}, key=str):
        a, b = expected.get(k), actual.get(k)
        if isinstance(a, dict) and isinstance(b, dict):
            out |= {f"{k}.{n}": v for n, v in mismatches(a, b).items()}
        elif a != b:
            out[str(k)] = (a, b)
    return out


def instance_rows(cells: DataFrame, image: list[str], score: str, threshold: float) -> DataFrame:
    """A row for each region: its cells, 95th percentile and largest response, margin above the threshold, whether it is met."""
    g = cells.groupBy(*image, "region").agg(F.count("*").alias("size"), F.percentile(score, F.lit(0.95)).alias("q95"), F.max(score).alias("peak"))
    return g.withColumns({"margin": F.col("q95") - threshold, "detected": F.col("peak") > threshold})


def localization(cells: DataFrame, image: list[str], hit: Column, small: float) -> DataFrame:
    """One row: mean recall over anomalous images, over those with little truth, share of normal images with a hit, and hits per true cell."""
    i = cells.groupBy(*image).agg(F.sum("truth").alias("t"), F.count_if(hit & (F.col("truth") == 1)).alias("tp"), F.count_if(hit).alias("p"), F.count("*").alias("n"))
    recall = F.col("tp") / F.when(F.col("t") > 0, F.col("t"))
    return i.agg(
        F.avg(recall).alias("mean_recall"),
        F.avg(F.when(F.col("t") <= small * F.col("n"), recall)).alias("small_recall"),
        F.avg(F.when(F.col("t") == 0, (F.col("p") > 0).cast("double"))).alias("normal_positive_rate"),
        F.try_divide(F.sum("p").cast("double"), F.sum("t").cast("double")).alias("oversegmentation"),
    )


def summary(rows: DataFrame, key: str, method: str, base: str, metrics: list[str], tolerance: float = 1e-10) -> DataFrame:
    """For each method and metric: the macro mean, its difference from the base method's, and keys improved, tied and declined."""
    long = rows.unpivot([key, method], metrics, "metric", "value")
    b = long.filter(F.col(method) == base).select(key, "metric", F.col("value").alias("_b"))
    d = F.col("value") - F.col("_b")
    g = long.join(b, [key, "metric"], "left").groupBy(method, "metric").agg(
        F.avg("value").alias("macro"), F.count("value").alias("valid"), F.avg(d).alias("delta"),
        F.count_if(d > tolerance).alias("improved"), F.count_if(F.abs(d) <= tolerance).alias("tied"), F.count_if(d < -tolerance).alias("declined"),
    )
    return g
