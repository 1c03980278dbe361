"""Calibration of distances on normal data, and the fusion of calibrated layers and methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anomalake.functions.stats import MAD_SCALE, robust, wilson_lower

# The three rules' smallest scales.
LEAST_SCALE, EPSILON = 1e-8, 1e-6


def scaled_mad(df: DataFrame, by: list[str], value: str, least_rows: int = 256) -> DataFrame:
    """(by, n, median, scale): scale = max(1.4826 MAD, 1e-8); null for groups with fewer finite values than needed."""
    got = robust(df.filter(F.col(value).isNotNull() & ~F.isnan(value)), by, value)
    enough = F.col("n") >= least_rows
    return got.select(*by, "n", F.when(enough, F.col("median")).alias("median"), F.when(enough, F.greatest(F.col("mad") * MAD_SCALE, F.lit(LEAST_SCALE))).alias("scale"))


def mad_plus_epsilon(df: DataFrame, by: list[str], value: str, image: str, quantiles: tuple[float, float] = (0.95, 0.995)) -> DataFrame:
    """median, MAD + 1e-6, and two thresholds on the unclamped scale: of the images' maxima and of all values."""
    state = robust(df, by, value).withColumn("mad", F.col("mad") + EPSILON)
    z = df.join(state, by).withColumn("_z", (F.col(value) - F.col("median")) / F.col("mad"))
    top = z.groupBy(*by, image).agg(F.max("_z").alias("_m")).groupBy(*by).agg(F.percentile("_m", F.lit(quantiles[0])).alias("tau_image"))
    return state.join(top, by).join(z.groupBy(*by).agg(F.percentile("_z", F.lit(quantiles[1])).alias("tau_pixel")), by)


def clamped_mad(df: DataFrame, by: list[str], value: str, image: str, quantile: float = 0.95) -> DataFrame:
    """median, max(MAD, 1e-6) and the threshold: a quantile of the images' largest clamped scores."""
    state = robust(df, by, value).withColumn("mad", F.greatest("mad", F.lit(EPSILON)))
    z = df.join(state, by).withColumn("_z", clamped(F.col(value), F.col("median"), F.col("mad")))
    top = z.groupBy(*by, image).agg(F.max("_z").alias("_m"))
    return state.join(top.groupBy(*by).agg(F.percentile("_m", F.lit(quantile)).alias("threshold")), by)


def clamped(x: Column, median: Column, scale: Column) -> Column:
    return F.greatest((x - median) / scale, F.lit(0.0))


def ecdf_surprise(df: DataFrame, reference: DataFrame, by: list[str], value: str) -> DataFrame:
    """-ln(1 - F(x) + 1e-8), F the share of a group's reference values not above x.

    Both sides are counted by distinct value first, so the running count is over distinct values, not rows.
    """
    ref = reference.groupBy(*by, value).agg(F.count("*").alias("_r"))
    vals = df.select(*by, value).distinct().withColumn("_r", F.lit(0).cast("long")).unionByName(ref)
    w = Window.partitionBy(*by).orderBy(value)
    grid = vals.groupBy(*by, value).agg(F.sum("_r").alias("_r")).withColumn("_c", F.sum("_r").over(w)).withColumn("_n", F.sum("_r").over(Window.partitionBy(*by)))
    return df.join(grid.select(*by, value, (-F.log(1 - F.col("_c") / F.col("_n") + 1e-8)).alias("surprise")), [*by, value])


def standardize(long: DataFrame, stats: DataFrame, by: list[str], value: str, out: str = "z") -> DataFrame:
    """(value - median) / scale with a group's own state, unclamped; a group without a positive scale is an error."""
    bad = F.col("scale").isNull() | ~(F.col("scale") > 0)
    scale = F.when(bad, F.raise_error(F.lit("scale must be positive")).cast("double")).otherwise(F.col("scale"))
    return long.join(stats.select(*by, "median", "scale"), by).withColumn(out, (F.col(value) - F.col("median")) / scale).drop("median", "scale")


def layer_equal(long: DataFrame, keys: list[str], value: str = "z") -> DataFrame:
    """The unweighted mean over layers."""
    return long.groupBy(*keys).agg(F.avg(value).alias("fused"))


def variants(long: DataFrame, keys: list[str], last: str) -> DataFrame:
    """raw mean, equal-weight mean of calibrated layers, and the last layer alone, one row a key."""
    return long.groupBy(*keys).agg(F.avg("raw").alias("raw_mean"), F.avg("z").alias("mad_equal"), F.max(F.when(F.col("layer") == last, F.col("z"))).alias("last_layer"))


def reliability_weighted(long: DataFrame, weights: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Weighted mean over layers; a label's weights, or where it has none the global ones (label null in ``weights``).

    Weights are (max(w, 0) + 1e-8) over their sum across the layers.
    """
    local = weights.filter(F.col(label).isNotNull()).withColumnRenamed("weight", "_l")
    common = weights.filter(F.col(label).isNull()).select("layer", F.col("weight").alias("_g"))
    got = long.join(local, ["layer", label], "left").join(common, "layer").withColumn("_w", F.greatest(F.coalesce("_l", "_g"), F.lit(0.0)) + 1e-8)
    return got.groupBy(*keys).agg((F.sum(F.col("_w") * F.col("z")) / F.sum("_w")).alias("weighted"))


def blend(a: Column, b: Column, alpha: float) -> Column:
    """(1 - alpha) a + alpha b."""
    return (1 - alpha) * a + alpha * b


def reliability(df: DataFrame, success: Column, label: str, layer: str, valid: Column | None = None, least: int = 256) -> DataFrame:
    """(label, layer, successes, n, value, fallback): Wilson's lower bound, the layer's global one where n is small.

    The global rows have a null label. Labels with no row in a layer appear with n = 0.
    """
    rows = df if valid is None else df.filter(valid)
    cells = rows.groupBy(label, layer).agg(F.sum(success.cast("long")).alias("successes"), F.count("*").alias("n"))
    total = cells.groupBy(layer).agg(F.sum("successes").alias("_s"), F.sum("n").alias("_n"))
    labels = cells.groupBy(F.lit(1).alias("_one")).agg(F.collect_set(label).alias("_labels"))
    dense = total.withColumn("_one", F.lit(1)).join(labels, "_one").select(layer, "_s", "_n", F.explode("_labels").alias(label))
    got = dense.join(cells, [label, layer], "left").withColumns({"successes": F.coalesce("successes", F.lit(0)), "n": F.coalesce("n", F.lit(0))})
    low, base = wilson_lower(F.col("successes"), F.col("n")), wilson_lower(F.col("_s"), F.col("_n"))
    short = F.col("n") < least
    local = got.select(label, layer, "successes", "n", F.when(short, base).otherwise(low).alias("value"), short.alias("fallback"))
    glob = total.select(F.lit(None).cast(dict(df.dtypes)[label]).alias(label), layer, F.col("_s").alias("successes"), F.col("_n").alias("n"), base.alias("value"), F.lit(False).alias("fallback"))
    return local.unionByName(glob)
