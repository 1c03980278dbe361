import json

import pytest
from pyspark.sql import functions as F

from anomalake.functions import hashing
from anomalake.plans.experiment import Protocol, metric_phase, score_phase
from anomalake.sources import records, sinks
from anomalake.streaming import scoring


def touch(root, *paths):
    for p in paths:
        f = root / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")


def by_name(df):
    return {r.path.rsplit("/", 1)[1]: r for r in df.collect()}


def test_folder_records(spark, tmp_path):
    touch(tmp_path, "cup/train/good/1.png", "cup/test/good/2.png", "cup/test/crack/3.png", "cup/test/crack/4.PNG", "cup/ground_truth/crack/3_mask.png", "cup/readme.txt")
    got = by_name(records.folder_records(spark, str(tmp_path)))
    assert {k: (r.label, r.role, bool(r.mask_path)) for k, r in got.items()} == {"1.png": (0, "train", False), "2.png": (0, "evaluation", False), "3.png": (1, "evaluation", True), "4.PNG": (1, "evaluation", False)}
    audit = records.group_audit(records.folder_records(spark, str(tmp_path))).first()
    assert (audit.train, audit.normal, audit.anomalous, audit.missing_masks) == (1, 1, 2, 1)


def test_paired_and_variant_records(spark, tmp_path):
    touch(tmp_path / "b", "01/train/ok/a.bmp", "01/test/ko/B1.bmp", "01/test/ko/c.bmp", "01/ground_truth/ko/b1.png", "01/ground_truth/ko/d.png")
    rows, bad = records.paired_records(spark, str(tmp_path / "b"))
    assert {k: bool(r.mask_path) for k, r in by_name(rows).items()} == {"a.bmp": False, "B1.bmp": True, "c.bmp": False}
    assert sorted((r.stem, r.path is None) for r in bad.collect()) == [("c", False), ("d", True)]
    touch(tmp_path / "v", "can/train/good/000_regular.png", "can/test_public/bad/001_shift_1.png", "can/test_public/good/002.png", "can/test_public/ground_truth/bad/001_shift_1_mask.png")
    got = by_name(records.variant_records(spark, str(tmp_path / "v")))
    assert {k: (r.label, r.shift, bool(r.mask_path)) for k, r in got.items()} == {"000_regular.png": (0, "regular", False), "001_shift_1.png": (1, "shift_1", True), "002.png": (0, "regular", False)}


def test_csv_records_reject_bad_rows(spark, tmp_path):
    (tmp_path / "split_csv").mkdir()
    f = tmp_path / "split_csv/1cls.csv"
    f.write_text("object,split,label,image,mask\ncan,train,normal,a.jpg,\ncan,test,anomaly,b.jpg,b.png\n")
    got = by_name(records.csv_records(spark, str(tmp_path)))
    assert (got["a.jpg"].label, got["b.jpg"].label, got["b.jpg"].mask_path) == (0, 1, f"{tmp_path}/b.png")
    for row in ("can,test,anomaly,../c.jpg,", "can,valid,normal,c.jpg,", "can,train,normal,a.jpg,", "can,test,normal,c.jpg,c.png"):
        f.write_text(f"object,split,label,image,mask\ncan,train,normal,a.jpg,\n{row}\n")
        spark.catalog.clearCache()
        with pytest.raises(Exception):  # noqa: B017
            records.csv_records(spark, str(tmp_path)).collect()


def test_metadata_records(spark, tmp_path):
    for group, rows in (("a/d0/s0/test", [("1.png", "normal", None), ("2.png", "anomaly", "2m.png")]), ("a/d0/s1/test", [("3.png", "anomaly", None)])):
        touch(tmp_path, f"{group}/x")
        (tmp_path / group / "metadata.jsonl").write_text("\n".join(json.dumps({"file_name": a, "label": b, "mask": c}) for a, b, c in rows))
    got = by_name(records.metadata_records(spark, str(tmp_path)))
    assert {k: (r.label, r.shift, r.mask_capability) for k, r in got.items()} == {"1.png": (0, "s0", "pixel"), "2.png": (1, "s0", "pixel"), "3.png": (1, "s1", "image_only")}
    want = spark.createDataFrame([("d0", "s0"), ("d0", "s2")], "domain string, shift string")
    assert sorted((r.shift, r.problem) for r in records.check_groups(records.metadata_records(spark, str(tmp_path)), want).collect()) == [("s1", "unexpected"), ("s2", "missing")]


def test_sinks_and_stages(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan"), 1.5), ("b", float("inf"), None)], "k string, x double, y double")
    sinks.write_json(df, f"{tmp_path}/j")
    assert sorted((r.k, r.asDict().get("x")) for r in spark.read.schema("k string, x double").json(f"{tmp_path}/j").collect()) == [("a", None), ("b", None)]
    sinks.write_csv(df, f"{tmp_path}/c")
    assert sinks.read_csv(spark, f"{tmp_path}/c", "k string, x double, y double").count() == 2
    with pytest.raises(ValueError):
        sinks.write_csv(df.limit(0), f"{tmp_path}/e")
    bank = spark.createDataFrame([("c", 7, 1, [1.0, 2.0])], "category string, layer int, id long, vec array<double>")
    sinks.write_bank(bank, f"{tmp_path}/bank")
    assert sinks.read_bank(spark, f"{tmp_path}/bank", 2, 1).count() == 1
    with pytest.raises(ValueError):
        sinks.read_bank(spark, f"{tmp_path}/bank", 3)
    s = sinks.Stage(spark, f"{tmp_path}/s", {"seed": 1})
    assert s.start() and not s.completed()
    with pytest.raises(FileExistsError):
        s.start(skip=True)
    s.finish(rows=3)
    assert s.completed() and not s.start(skip=True) and not sinks.Stage(spark, f"{tmp_path}/s", {"seed": 2}).completed()
    assert sinks.missing(df.select("k"), df.filter("k = 'a'"), ["k"]).first().k == "b"


@pytest.mark.parametrize("strategy", ["full", "random", "kcenter", "merge_reduce", "image_balanced"])
def test_two_phases_with_a_barrier(spark, tmp_path, strategy):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("group"))
    train, test = v.filter("group < 8 and id % 3 <> 0"), v.filter("id % 3 = 0")
    labels = test.select("id", (F.col("group") >= 8).cast("int").alias("label"), F.lit("all").alias("category"))
    p = Protocol(strategy=strategy, bank_rows=60)
    with pytest.raises(RuntimeError):
        metric_phase(spark, str(tmp_path), labels, p)
    score_phase(spark, str(tmp_path), train, test.select("id", "vec"), p)
    score_phase(spark, str(tmp_path), train, test.select("id", "vec"), p)  # completed: skipped
    m, o = metric_phase(spark, str(tmp_path), labels, p)
    r = m.first()
    assert 0 < r.auroc <= 1 and 0 < r.ap <= 1 and all(x.actual_fpr <= x.cap for x in o.collect())


def test_streaming_scores(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value").write.parquet(f"{tmp_path}/in")
    src = spark.read.parquet(f"{tmp_path}/in")
    state = src.groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.lit(10.0).alias("scale"))
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    q = scoring.windowed(scoring.scored(stream, state, ["event_type"], "value"), ["event_type"], "ts", "1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == src.count()


def test_hash_identities():
    assert hashing.identity({"b": float("nan"), "a": [1]}) == hashing.identity({"a": [1], "b": None})
    assert hashing.fingerprint({"a": 1, "_t": 5, "n": {"_x": 1, "y": 2}}) == hashing.fingerprint({"a": 1, "n": {"y": 2}})
    assert hashing.stable_u64("x") != hashing.stable_u64("x", "big")
