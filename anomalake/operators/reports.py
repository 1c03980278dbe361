"""Grouped, macro and paired reports, and constraint checks over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anomalake.functions.stats import finite


def macro(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Unweighted means over categories that skip null and non-finite values, with each metric's valid count."""
    cols = [c for m in metrics for c in (F.avg(finite(F.col(m).cast("double"))).alias(m), F.count(finite(F.col(m).cast("double"))).alias(f"{m}_valid"))]
    return rows.groupBy(*by).agg(F.count("*").alias("categories"), *cols)


def complete(rows: DataFrame, by: list[str], expected: int) -> DataFrame:
    """The rows, after a check that each group has exactly the expected number of categories."""
    n = F.count("*").over(Window.partitionBy(*by))
    return rows.withColumn("_n", n).filter(F.when(F.col("_n") != expected, F.raise_error(F.lit("a group isn't complete")).cast("boolean")).otherwise(True)).drop("_n")


def deltas(rows: DataFrame, key: list[str], method: str, base: str, metrics: list[str]) -> DataFrame:
    """Each other method's metrics minus the base method's; a missing value makes a null."""
    b = rows.filter(F.col(method) == base).select(*key, *(F.col(m).alias(f"_b_{m}") for m in metrics))
    return rows.filter(F.col(method) != base).join(b, key).select(*key, method, *((F.col(m) - F.col(f"_b_{m}")).alias(f"delta_{m}") for m in metrics))


def changes(delta: DataFrame, by: list[str], column: str, tolerance: float = 1e-10) -> DataFrame:
    """How many rows improved, tied (within the tolerance) and declined."""
    d = F.col(column)
    return delta.groupBy(*by).agg(F.count_if(d > tolerance).alias("improved"), F.count_if(F.abs(d) <= tolerance).alias("tied"), F.count_if(d < -tolerance).alias("declined"))


def average_relative_drop(source: Column, target: Column) -> Column:
    return F.avg(F.least(F.lit(0.0), target - source))


def rank_protocols(rows: DataFrame, protocol: str, metric: str, cost: str, tolerance: float = 0.002) -> DataFrame:
    """Protocols by mean metric; all within the tolerance of the best are ranked by cost, the others follow by metric."""
    g = rows.groupBy(protocol).agg(F.count("*").alias("runs"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.avg(cost).alias("cost"))
    g = g.withColumn("near", F.col("mean") >= F.max("mean").over(Window.partitionBy()) - tolerance)
    w = Window.orderBy(F.desc("near"), F.when(F.col("near"), F.col("cost")), F.desc("mean"), protocol)
    return g.withColumn("rank", F.row_number().over(w))


def disjoint(df: DataFrame, role: str, key: str) -> DataFrame:
    """Keys that break a disjoint split: in several roles, or repeated in one. Empty where all is well."""
    return df.groupBy(key).agg(F.count_distinct(role).alias("roles"), F.count("*").alias("n")).filter("roles > 1 or n > 1")


def match_rows(selected: DataFrame, candidates: DataFrame, value: str, key: str) -> DataFrame:
    """Each selected row with the first unused candidate of the same value: the i-th of a value takes the i-th."""
    a = selected.withColumn("_i", F.row_number().over(Window.partitionBy(value).orderBy(key)))
    b = candidates.select(F.col(key).alias("candidate"), F.col(value), F.row_number().over(Window.partitionBy(value).orderBy(key)).alias("_i"))
    return a.join(b, [value, "_i"], "left").select(key, "candidate")


def expected_keys(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem) for keys that are missing, unexpected or repeated."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    j = n.join(expected.select(*keys).distinct().withColumn("_e", F.lit(True)), keys, "full_outer")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_n") > 1, "repeated")
    return j.select(*keys, problem.alias("problem")).filter("problem is not null")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with the side; counts of repeated rows matter."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def union_reports(*parts: DataFrame) -> DataFrame:
    """Reports one below another; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def stage_rollup(rows: DataFrame) -> DataFrame:
    """Calls, seconds and the highest peak for each phase and stage."""
    return rows.groupBy("phase", "stage").agg(F.count("*").alias("calls"), F.sum("seconds").alias("seconds"), F.max("peak").alias("peak"))


def close(a: DataFrame, b: DataFrame, keys: list[str], metric: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose metric differs by more than the tolerance between two tables, or is missing in one."""
    j = a.select(*keys, F.col(metric).alias("_a")).join(b.select(*keys, F.col(metric).alias("_b")), keys, "full_outer")
    return j.filter(~F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= tolerance, F.col("_a").isNull() & F.col("_b").isNull())).select(*keys, F.col("_a").alias("first"), F.col("_b").alias("second"))


def combined(image: DataFrame, pixel: DataFrame, key: str, image_metrics: list[str], pixel_metrics: list[str]) -> DataFrame:
    """Image metrics of one method beside pixel metrics of another, by category."""
    return image.select(key, *image_metrics).join(pixel.select(key, *pixel_metrics), key)


def markdown(report: DataFrame, digits: int = 4, most: int = 1000) -> str:
    """A report of few rows as a Markdown table; missing values are N/A. More than ``most`` rows are an error."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")

    def cell(v) -> str:
        return "N/A" if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else str(v)

    lines = [report.columns, ["---"] * len(report.columns), *([cell(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
