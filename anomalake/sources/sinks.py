"""Reports, maps, banks and stage markers on any file system that Spark writes to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomalake.functions.hashing import json_safe
from anomalake.functions.stats import finite


def json_columns(df: DataFrame) -> DataFrame:
    """The rows with NaN and infinities of top-level numbers as null, as JSON can't hold them."""
    return df.withColumns({c: finite(F.col(c)).cast(t) for c, t in df.dtypes if t in ("double", "float")}) if df.columns else df


def write_csv(df: DataFrame, path: str, allow_empty: bool = False) -> None:
    """A report with a header; Spark's commit makes it all or nothing. An empty one is an error unless allowed."""
    if not allow_empty and df.isEmpty():
        raise ValueError("the report is empty")
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def write_json(df: DataFrame, path: str) -> None:
    json_columns(df).write.mode("errorifexists").json(path)


def write_maps(df: DataFrame, path: str, by: tuple[str, ...] = ("category", "domain", "shift", "label")) -> None:
    """Maps and masks as Parquet, in folders by group so that reads prune them."""
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)


def write_bank(df: DataFrame, path: str) -> None:
    """A bank of (category, layer, id, vec)."""
    df.write.mode("errorifexists").partitionBy("category", "layer").parquet(path)


def read_bank(spark: SparkSession, path: str, width: int, rows: int | None = None) -> DataFrame:
    """A bank whose vectors have the expected width, and each layer the expected rows; anything else is an error."""
    bank = spark.read.parquet(path)
    bad = bank.groupBy("category", "layer").agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi")).filter((F.col("lo") != width) | (F.col("hi") != width) | (F.lit(False) if rows is None else F.col("n") != rows))
    found = bad.limit(5).collect()
    if found:
        raise ValueError(f"the bank has other shapes: {found}")
    return bank


def missing(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What a read-through cache still lacks."""
    return wanted.join(cache.select(*keys).distinct(), keys, "left_anti")


class Stage:
    """A stage's folder and its completion marker: made once, skipped only where the same identity has completed."""

    def __init__(self, spark: SparkSession, path: str, identity: dict):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.spark, self.path, self.identity = spark, path.rstrip("/"), json_safe(identity)

    @property
    def marker(self) -> str:
        return f"{self.path}/complete.json"

    def completed(self) -> bool:
        if not self.fs.exists(self._path(self.marker)):
            return False
        said = json.loads("".join(r.value for r in self.spark.read.text(self.marker).collect()))
        return all(said.get(k) == v for k, v in self.identity.items())

    def start(self, skip: bool = False) -> bool:
        """Whether there is work to do; a folder that exists is only accepted if skipping is allowed and it is complete."""
        if self.fs.exists(self._path(self.path)):
            if skip and self.completed():
                return False
            raise FileExistsError(self.path)
        self.fs.mkdirs(self._path(self.path))
        return True

    def finish(self, **extra) -> None:
        tmp = self._path(f"{self.marker}.tmp")
        out = self.fs.create(tmp, True)
        out.write(bytearray(json.dumps(self.identity | json_safe(extra), sort_keys=True, allow_nan=False).encode()))
        out.close()
        if not self.fs.rename(tmp, self._path(self.marker)):
            raise OSError(f"{self.marker} can't be put in place")
