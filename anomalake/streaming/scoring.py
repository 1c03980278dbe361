"""Scores of arriving rows against a fitted calibration, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored(stream: DataFrame, state: DataFrame, by: list[str], value: str) -> DataFrame:
    """The stream with z = (value - median) / scale of its group; groups without a state are dropped, as a static join does."""
    return stream.join(state.select(*by, "median", "scale"), by).withColumn("z", (F.col(value) - F.col("median")) / F.col("scale")).drop("median", "scale")


def windowed(stream: DataFrame, by: list[str], time: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Row counts and the largest z of each tumbling window; windows close once the watermark has passed them."""
    g = stream.withWatermark(time, late).groupBy(F.window(time, width), *by)
    return g.agg(F.count("*").alias("n"), F.max("z").alias("max_z")).select(F.col("window.start").alias("start"), *by, "n", "max_z")
