"""The driver's tables in the roles that the operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(queries, bank): every eighth vector against the others, with the label as class."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return v.filter("id % 8 = 0"), v.filter("id % 8 <> 0")


MEASURES = ("quantity", "extendedprice", "discount", "tax")


def _added(rows: str, c: str) -> Column:
    """The sum of a field of structs from the first to the last; null where all are."""
    known = F.filter(F.transform(rows, lambda r: r[c]), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x))


def layers(spark: SparkSession, sf: str, in_order: bool = False) -> DataFrame:
    """lineitem's four measures as layers, summed per order: (image, layer, raw).

    Sums of doubles differ in their last bits by the order of their terms, which parts equal sums. With ``in_order``
    an order's rows are added as they stand in the table's files, however Spark splits and shuffles them.
    """
    t = table(spark, sf, "lineitem")
    if in_order:
        place = ["row_index"] if len(t.inputFiles()) == 1 else ["file_path", "row_index"]
        rows = t.select(F.col("l_orderkey").alias("image"), F.struct(*(F.col(f"_metadata.{c}") for c in place), *(F.col(f"l_{c}").alias(c) for c in MEASURES)).alias("_row"))
        rows = rows.groupBy("image").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))  # as many as an order has lines
        li = rows.select("image", *(_added("_rows", c).alias(c) for c in MEASURES))
    else:
        li = t.groupBy(F.col("l_orderkey").alias("image")).agg(*(F.sum(f"l_{c}").alias(c) for c in MEASURES))
    return li.unpivot(["image"], list(MEASURES), "layer", "raw")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """events as maps: (image, y, x, score, truth), a user's days by four-hour blocks."""
    e = table(spark, sf, "events")
    cell = e.select(F.col("user_id").alias("image"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("y"), F.floor(F.hour("ts") / 4).cast("int").alias("x"), "value", "event_type")
    return cell.groupBy("image", "y", "x").agg(F.max("value").alias("score"), F.max((F.col("event_type") == "error").cast("int")).alias("truth"))


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


GRID = """grid as (select user_id image, date_diff('day', date '2024-01-01', ts::date)::int y, (hour(ts) // 4)::int x,
  max(value) score, max((event_type = 'error')::int) truth from events group by all)"""
REGIONS = GRID + """, m as (select image, y, x from grid where truth = 1),
reach(image, y, x, cell) as (select image, y, x, y * 10 + x from m
  union select m.image, m.y, m.x, r.cell from reach r join m on m.image = r.image and abs(m.y - r.y) + abs(m.x - r.x) = 1),
cells as (select image, y, x, min(cell) region from reach group by all)"""
LAYERS = """layers as (unpivot (select l_orderkey image, sum(l_quantity) quantity, sum(l_extendedprice) extendedprice, sum(l_discount) discount, sum(l_tax) tax
  from lineitem group by all) on quantity, extendedprice, discount, tax into name layer value raw)"""
SCALED = LAYERS + """, stats as (select layer, quantile_cont(raw, 0.5) median, count(*) n, greatest(mad(raw) * 1.4826, 1e-8) scale from layers group by all)"""
