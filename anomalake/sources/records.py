"""Scans of labelled image sets into record tables: labels, splits and masks come from paths and metadata, never from pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anomalake.functions.hashing import forward_slashes, safe_relative

RECORD = "path string, label int, mask_path string, category string, dataset string, domain string, shift string, role string, mask_capability string"
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]
# The file types that count as images.
SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")


def files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, rel): every image file below root; only the listing is read, as the content column is pruned."""
    glob = pattern or "*.{" + ",".join([*SUFFIXES, *(s.upper() for s in SUFFIXES)]) + "}"
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path")
    base = root.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    return f.select("path", F.substring_index(forward_slashes(F.col("path")), base, -1).alias("rel"))


def _part(rel: Column, i: int) -> Column:
    return F.get(F.split(rel, "/"), F.lit(i))


def _stem(rel: Column) -> Column:
    return F.regexp_extract(rel, r"([^/]*?)(?:\.[^./]*)?$", 1)


def _record(df: DataFrame, **values) -> DataFrame:
    df = df.withColumns({k: v if isinstance(v, Column) else F.lit(v).cast("string") for k, v in values.items()})
    return df.select(*(F.col(c).cast(t.split()[1]).alias(c) for c, t in zip(COLUMNS, RECORD.split(", "), strict=True)))


def folder_records(spark: SparkSession, root: str, dataset: str = "mvtec", mask_suffix: str = "_mask") -> DataFrame:
    """category/train/good, category/test/<defect> and category/ground_truth/<defect>/<stem>_mask: the label is the folder."""
    f = files(spark, root).withColumns({"category": _part(F.col("rel"), 0), "part": _part(F.col("rel"), 1), "defect": _part(F.col("rel"), 2), "stem": _stem(F.col("rel"))})
    masks = f.filter("part = 'ground_truth'").select("category", "defect", F.regexp_replace("stem", f"{mask_suffix}$", "").alias("stem"), F.col("path").alias("mask_path"))
    images = f.filter("part in ('train', 'test')").join(masks, ["category", "defect", "stem"], "left")
    label = F.when(F.col("defect") == "good", 0).otherwise(1)
    return _record(images, label=label, dataset=dataset, domain="default", shift="none", role=F.when(F.col("part") == "train", "train").otherwise("evaluation"), mask_capability=F.when(F.col("part") == "train", "not_evaluation").otherwise("pixel"))


def csv_records(spark: SparkSession, root: str, table: str = "split_csv/1cls.csv") -> DataFrame:
    """object,split,label,image,mask rows; values outside the enumerations, unsafe paths and repeated images are errors."""
    schema = "object string, split string, label string, image string, mask string"
    rows = spark.read.csv(f"{root}/{table}", header=True, schema=schema, mode="FAILFAST", enforceSchema=False)
    ok = F.col("split").isin("train", "test") & F.col("label").isin("normal", "anomaly") & safe_relative(F.col("image")) & (F.col("mask").isNull() | safe_relative(F.col("mask"))) & ((F.col("label") == "anomaly") | F.col("mask").isNull())
    n = F.count("*").over(Window.partitionBy("image"))
    good = F.when(ok & (F.col("_n") == 1), True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("bad row:"), "object", "split", "label", "image")).cast("boolean"))
    rows = rows.withColumn("_n", n).filter(good)
    full = lambda c: F.concat(F.lit(root.rstrip("/") + "/"), c)
    return _record(rows.withColumn("category", F.col("object")), path=full(F.col("image")), mask_path=F.when(F.col("mask").isNotNull(), full(F.col("mask"))), label=F.when(F.col("label") == "normal", 0).otherwise(1), dataset="visa", domain="default", shift="none", role=F.when(F.col("split") == "train", "train").otherwise("evaluation"), mask_capability=F.when(F.col("split") == "train", "not_evaluation").otherwise("pixel"))


def paired_records(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(records, unmatched): category/train/ok, test/{ok,ko}, ground_truth/ko, joined on lower-case stems from both sides."""
    f = files(spark, root).withColumns({"category": _part(F.col("rel"), 0), "part": _part(F.col("rel"), 1), "kind": _part(F.col("rel"), 2), "stem": F.lower(_stem(F.col("rel")))})
    masks = f.filter("part = 'ground_truth'").select("category", "stem", F.col("path").alias("mask_path"))
    images = f.filter("part in ('train', 'test')")
    bad = images.filter("part = 'test' and kind = 'ko'").select("category", "stem", "path").join(masks, ["category", "stem"], "full_outer").filter("path is null or mask_path is null")
    matched = images.join(masks.withColumn("kind", F.lit("ko")), ["category", "stem", "kind"], "left")
    label = F.when(F.col("kind") == "ok", 0).otherwise(1)
    return _record(matched, label=label, dataset="btad", domain="default", shift="none", role=F.when(F.col("part") == "train", "train").otherwise("evaluation"), mask_capability=F.when(F.col("part") == "train", "not_evaluation").otherwise("pixel")), bad


def metadata_records(spark: SparkSession, root: str) -> DataFrame:
    """category/domain/shift/split/metadata.jsonl rows {file_name, label, mask}; a group has pixel truth if all its anomalies have masks."""
    rows = spark.read.schema("file_name string, label string, mask string").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.jsonl").json(root).withColumn("_file", F.input_file_name())
    base = root.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    rel = F.substring_index(F.col("_file"), base, -1)
    rows = rows.withColumns({"category": _part(rel, 0), "domain": _part(rel, 1), "shift": _part(rel, 2), "split": _part(rel, 3), "_dir": F.regexp_replace(rel, "[^/]*$", "")})
    y = F.when(F.lower("label").isin("normal", "good", "0"), 0).otherwise(1)
    whole = F.min(F.when((y == 1) & F.col("mask").isNull(), 0).otherwise(1)).over(Window.partitionBy("category", "domain", "shift"))
    full = lambda c: F.concat(F.lit(root.rstrip("/") + "/"), F.col("_dir"), c)
    return _record(rows.withColumn("_y", y), path=full(F.col("file_name")), mask_path=F.when(F.col("mask").isNotNull(), full(F.col("mask"))), label=F.col("_y"), dataset="robust", role=F.when(F.col("split") == "train", "train").otherwise("evaluation"), mask_capability=F.when(F.col("split") == "train", "not_evaluation").when(whole == 1, "pixel").otherwise("image_only"))


def variant_records(spark: SparkSession, root: str) -> DataFrame:
    """category/{train,validation}/good and test_public/{good,bad,ground_truth/bad}; the shift is the stem's second part, or regular."""
    f = files(spark, root, "*.png").withColumns({"category": _part(F.col("rel"), 0), "part": _part(F.col("rel"), 1), "kind": _part(F.col("rel"), 2), "stem": _stem(F.col("rel"))})
    masks = f.filter("kind = 'ground_truth'").select("category", F.regexp_replace("stem", "_mask$", "").alias("stem"), F.col("path").alias("mask_path"), F.lit("bad").alias("kind"))
    images = f.filter("kind in ('good', 'bad')").join(masks, ["category", "stem", "kind"], "left")
    variant = F.when(F.col("stem").contains("_"), F.regexp_replace("stem", "^[^_]*_", "")).otherwise("regular")
    return _record(images, label=F.when(F.col("kind") == "good", 0).otherwise(1), dataset="ad2", domain="default", shift=variant, role=F.when(F.col("part") == "test_public", "evaluation").otherwise(F.col("part")), mask_capability=F.when(F.col("part") == "test_public", "pixel").otherwise("not_evaluation"))


def group_audit(records: DataFrame) -> DataFrame:
    """Counts of each (dataset, category, domain, shift): train, normal, anomalous and masked records."""
    train = F.col("role") == "train"
    return records.groupBy("dataset", "category", "domain", "shift").agg(F.count_if(train).alias("train"), F.count_if(~train & (F.col("label") == 0)).alias("normal"), F.count_if(~train & (F.col("label") == 1)).alias("anomalous"), F.count_if(~train & (F.col("label") == 1) & F.col("mask_path").isNull()).alias("missing_masks"))


def check_groups(records: DataFrame, expected: DataFrame) -> DataFrame:
    """(domain, shift) groups that only one side has, or that lack one of the two labels; empty where all is well."""
    have = records.filter("role = 'evaluation'").groupBy("domain", "shift").agg(F.count_distinct("label").alias("labels"))
    j = have.join(expected.select("domain", "shift").distinct().withColumn("_e", F.lit(True)), ["domain", "shift"], "full_outer")
    return j.select("domain", "shift", F.when(F.col("labels").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("labels") < 2, "one label").alias("problem")).filter("problem is not null")
