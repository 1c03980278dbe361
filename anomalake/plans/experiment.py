"""Whole runs: fit a bank, calibrate, score, evaluate; in two phases with a barrier between scores and labels."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomalake.functions.hashing import fingerprint
from anomalake.operators import calibration, knn, ranking, selection
from anomalake.sources.sinks import Stage


@dataclass(frozen=True)
class Protocol:
    """What identifies a run."""

    strategy: str = "kcenter"
    bank_rows: int = 100
    metric: str = "l2"
    neighbours: int = 1
    modulus: int = 8
    seed: int = 42

    def identity(self) -> dict:
        return asdict(self) | {"fingerprint": fingerprint(asdict(self))}


def build_bank(vectors: DataFrame, protocol: Protocol) -> DataFrame:
    """(id, vec): the reference bank of normal vectors (id, vec, group) by the protocol's strategy."""
    if protocol.strategy == "full":
        return vectors.select("id", "vec")
    if protocol.strategy == "random":
        return selection.random_bank(vectors, "id", protocol.bank_rows, protocol.seed).select("id", "vec")
    if protocol.strategy == "image_balanced":
        quota = selection.round_robin_quota(vectors.groupBy("group").agg(F.count("*").alias("n")), "group", protocol.bank_rows)
        picked = selection.kcenter_bank(vectors, quota, "group", protocol.seed)
    elif protocol.strategy == "kcenter":
        one = vectors.withColumn("_all", F.lit(0))
        picked = selection.kcenter_bank(one, one.groupBy("_all").agg(F.least(F.count("*"), F.lit(protocol.bank_rows)).alias("quota")), "_all", protocol.seed)
    elif protocol.strategy == "merge_reduce":
        picked = selection.merge_reduce(vectors, protocol.bank_rows, max(1, -(-vectors.count() // 20_000)), seed=protocol.seed)
    else:
        raise ValueError(protocol.strategy)
    return vectors.join(picked.select("id"), "id", "left_semi").select("id", "vec")


def score_phase(spark: SparkSession, root: str, train: DataFrame, test: DataFrame, protocol: Protocol) -> Stage:
    """Phase one: writes raw distances of calibration and test rows. It is given no labels: train is (id, vec, group), test (id, vec)."""
    stage = Stage(spark, f"{root}/scores", protocol.identity())
    if not stage.start(skip=True):
        return stage
    split = selection.modulus_split(train, ["group"], ["id"], protocol.modulus)
    bank = build_bank(split.filter("split = 'memory'"), protocol)
    bank.write.parquet(f"{root}/scores/bank")
    bank = spark.read.parquet(f"{root}/scores/bank")
    for name, rows in (("calibration", split.filter("split = 'calibration'")), ("test", test)):
        knn.nearest(rows.select("id", "vec"), bank, protocol.neighbours, protocol.metric).groupBy(F.col("query_id").alias("id")).agg(F.avg("distance").alias("raw")).write.parquet(f"{root}/scores/{name}")
    stage.finish(phase="scores")
    return stage


def metric_phase(spark: SparkSession, root: str, labels: DataFrame, protocol: Protocol, caps: tuple[float, ...] = (0.01, 0.05)) -> tuple[DataFrame, DataFrame]:
    """Phase two, only after phase one is complete: (ranking metrics, operating points) by category of labels (id, label, category)."""
    if not Stage(spark, f"{root}/scores", protocol.identity()).completed():
        raise RuntimeError("the scores aren't complete: labels stay closed")
    cal = spark.read.parquet(f"{root}/scores/calibration").withColumn("one", F.lit(1))
    state = calibration.scaled_mad(cal, ["one"], "raw", least_rows=1)
    z = calibration.standardize(spark.read.parquet(f"{root}/scores/test").withColumn("one", F.lit(1)), state, ["one"], "raw")
    rows = z.join(labels, "id")
    return ranking.auroc_ap(rows, ["category"], "label", "z"), ranking.fixed_fpr(rows, ["category"], "label", "z", list(caps))
