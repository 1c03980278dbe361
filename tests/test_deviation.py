import pytest
from pyspark.sql import functions as F

from anomalake.operators import reports
from anomalake.plans import deviation


def test_scores_of_all_methods(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("group"))
    train, test = v.filter("id % 4 <> 0"), v.filter("id % 4 = 0")
    moved = train.select("id", F.transform("vec", lambda x, i: x + 0.05 * F.sin(i.cast("double"))).alias("vec"))
    m = deviation.fit(train, moved, deviation.protocol_bank(train, "random_5k"), prototypes=3, rank=4)
    s = m.score(test).cache()
    n = {r.method: r.n for r in s.groupBy("method").agg(F.count("*").alias("n")).collect()}
    assert n == dict.fromkeys(deviation.METHODS, test.count())
    assert s.filter("score < 0 or isnan(score)").count() == 0
    z = deviation.calibrated(s, m.score(train.filter("id % 8 = 1")), "id")
    assert z.count() == s.count() and z.filter("z < 0").count() == 0
    with pytest.raises(Exception):  # noqa: B017
        deviation.calibrated(s, s.filter("method = 'D0'"), "id").collect()


def test_report_helpers(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", None), ("z", 2.0)], "k string, m double")
    b = spark.createDataFrame([("x", 1.0 + 1e-12), ("y", None), ("w", 2.0)], "k string, m double")
    assert sorted(r.k for r in reports.close(a, b, ["k"], "m").collect()) == ["w", "z"]
    assert reports.markdown(a.orderBy("k").limit(2)).splitlines()[2:] == ["| x | 1.0000 |", "| y | N/A |"]
    assert reports.combined(a, b.withColumnRenamed("m", "p"), "k", ["m"], ["p"]).count() == 2
