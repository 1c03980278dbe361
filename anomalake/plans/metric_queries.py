"""Registered queries: ranking metrics, operating points, regions and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomalake.operators import projections, ranking, regions
from anomalake.plans.tables import GRID, REGIONS, grid, r6, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _ranked(rows: str, by: str) -> str:
    part = f"partition by {by}" if by else ""
    g = f"{by}, " if by else ""
    return f"""with t as ({rows}), g as (select {g}score, sum(y) p, count(*) n from t group by all),
c as (select *, sum(p) over w tp, sum(n) over w m from g window w as ({part} order by score desc)),
a as (select {g}sum(n)::bigint n, sum(p)::bigint positives, sum((n - p) * (tp - p) + (n - p) * p / 2)::double won, sum(p::double * tp / m) ap from c group by all)
select {g}n, positives, case when positives > 0 and positives < n then round(won / (positives::double * (n - positives)), 6) end auroc,
  case when positives > 0 and positives < n then round(ap / positives, 6) end ap from a"""


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


@query("auroc_ap_documents", _ranked("select source, quality y, n_chars::double score from documents join labels using (doc_id)", "source"))
def auroc_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return _rounded(ranking.auroc_ap(d, ["source"], "quality", "n_chars"), "auroc", "ap")


@query("auroc_ap_lineitem", _ranked("select (l_returnflag = 'R')::int y, l_discount score from lineitem", ""))
def auroc_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_discount")
    return _rounded(ranking.auroc_ap(li, [], "y", "l_discount"), "auroc", "ap")


@query("auroc_ap_by_status", _ranked("select l_linestatus, (l_returnflag = 'R')::int y, l_quantity * l_tax score from lineitem", "l_linestatus"))
def auroc_status(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") * F.col("l_tax")).alias("s"))
    return _rounded(ranking.auroc_ap(li, ["l_linestatus"], "y", "s"), "auroc", "ap")


@query(
    "best_f1",
    """with t as (select l_linestatus, (l_returnflag = 'R')::int y, l_extendedprice s from lineitem),
q as (select l_linestatus, unnest(v) threshold from (select l_linestatus, list_distinct(quantile_cont(s, (select list(i / 63 order by i) from range(64) r(i)))) v from t group by all)),
c as (select q.l_linestatus, threshold, sum((s >= threshold and y = 1)::int) tp, sum((s >= threshold and y = 0)::int) fp, sum(y) p from q join t using (l_linestatus) group by all)
select l_linestatus, round(2 * tp / (tp + fp + p), 6) f1, round(threshold, 4) threshold from c qualify row_number() over (partition by l_linestatus order by 2 * tp / (tp + fp + p) desc, threshold) = 1""".replace("quantile_cont(s, (select list(i / 63 order by i) from range(64) r(i)))", "quantile_cont(s, [" + ", ".join(f"{i / 63!r}" for i in range(64)) + "])"),
)
def best_f1(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_extendedprice")
    return ranking.best_f1(li, ["l_linestatus"], "y", "l_extendedprice", 64).select("l_linestatus", r6("f1").alias("f1"), F.round("threshold", 4).alias("threshold"))


@query(
    "fixed_fpr",
    """with t as (select l_linestatus g, (l_returnflag = 'R')::int y, l_discount s from lineitem),
k as (select g, cap, (floor(cap * count(*) + 1e-9) + 1)::bigint k, count(*) negatives from t, (select unnest([0.01, 0.05, 0.2]) cap) where y = 0 group by g, cap),
o as (select g, s, row_number() over (partition by g order by s desc) r from t where y = 0),
b as (select k.g, cap, s boundary, negatives from k join o on o.g = k.g and r = k)
select b.g l_linestatus, cap::double cap, round(boundary, 6) boundary, count_if(y = 0 and s > boundary) fp, count_if(y = 1 and s > boundary) tp, count_if(y = 1) positives, any_value(negatives) negatives,
  round(count_if(y = 0 and s > boundary) / any_value(negatives), 6) actual_fpr, round(count_if(y = 1 and s > boundary) / count_if(y = 1), 6) recall from b join t on t.g = b.g group by b.g, cap, boundary""",
)
def fixed_fpr(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_discount")
    return _rounded(ranking.fixed_fpr(li, ["l_linestatus"], "y", "l_discount", [0.01, 0.05, 0.2]), "boundary", "actual_fpr", "recall")


@query(
    "complementarity",
    """with t as (select (o_orderstatus = 'F')::int y, o_totalprice a, o_custkey::double b from orders),
k as (select floor(0.05 * count(*) + 1e-9)::bigint k from t where y = 0),
e as (select (select a from t where y = 0 order by a desc limit 1 offset (select k from k)) ea, (select b from t where y = 0 order by b desc limit 1 offset (select k from k)) eb),
r as (select y, a > ea pa, b > eb pb from t, e),
c as (select count_if(y = 1) defect, count_if(y = 0) normal, count_if(y = 1 and pa and pb) tp_both, count_if(y = 1 and pa and not pb) tp_lost, count_if(y = 1 and not pa and pb) tp_gained,
  count_if(y = 0 and pa and pb) fp_both, count_if(y = 0 and pa and not pb) fp_lost, count_if(y = 0 and not pa and pb) fp_gained from r)
select *, round(tp_gained / nullif(defect - tp_both - tp_lost, 0), 6) rescued, round(tp_both / nullif(tp_both + tp_lost, 0), 6) kept from c""",
)
def complementarity(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_totalprice").alias("a"), F.col("o_custkey").cast("double").alias("b"))
    return _rounded(ranking.complementarity(o, "y", "a", "b", 0.05), "rescued", "kept")


@query("binary_f1", "with c as (select l_linestatus, count_if(l_returnflag = 'R' and l_discount > 0.05) tp, count_if(l_returnflag <> 'R' and l_discount > 0.05) fp, count_if(l_returnflag = 'R' and l_discount <= 0.05) fn from lineitem group by all) select *, round(2 * tp / (2 * tp + fp + fn), 6) f1 from c")
def binary_f1(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") > 0.05).cast("int").alias("p"))
    return _rounded(ranking.f1(li, ["l_linestatus"], "y", "p"), "f1")


@query("linear_thresholds", "select event_type, i::int i, round(max(value) - (max(value) - min(value)) * i / 199, 6) threshold from events, range(200) r(i) group by event_type, r.i")
def linear_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ranking.linear_thresholds(table(spark, sf, "events"), ["event_type"], "value"), "threshold")


@query("quantile_thresholds", "select event_type, round(unnest(v), 6) threshold from (select event_type, list_distinct(quantile_cont(value, [" + ", ".join(f"{i / 31!r}" for i in range(32)) + "])) v from events group by all)")
def quantile_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ranking.quantile_thresholds(table(spark, sf, "events"), ["event_type"], "value", 32), "threshold")


@query("regions_4conn", f"with recursive {REGIONS} select image, count(*) size, min(y * 10 + x)::int first_cell from cells group by image, region")
def regions_4conn(spark: SparkSession, sf: str) -> DataFrame:
    r = regions.regions(grid(spark, sf).filter("truth = 1"), ["image"])
    return r.groupBy("image", "region").agg(F.count("*").alias("size"), F.min(F.col("y") * 10 + F.col("x")).alias("first_cell")).drop("region")


@query(
    "region_coverage",
    f"""with recursive {REGIONS}, p as (select image, region, count(*) size, avg((score > 300)::int) covered from cells join grid using (image, y, x) group by all)
select count(*) region_count, round(avg(covered), 6) region_mean_coverage, count_if(size <= 1) small_region_count, round(avg(covered) filter (size <= 1), 6) small_region_mean_coverage from p""",
)
def region_coverage(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(spark, sf)
    cells = regions.regions(g.filter("truth = 1"), ["image"]).join(g, ["image", "y", "x"]).withColumn("hit", F.col("score") > 300)
    return _rounded(regions.coverage(cells, ["image"], "hit", image_cells=1000), "region_mean_coverage", "small_region_mean_coverage")


def _aupro_sql(thresholds: str, op: str) -> str:
    return f"""with recursive {REGIONS}, t as ({thresholds}), s as (select image, region, count(*) n from cells group by all),
pro as (select threshold, avg(c) pro from (select threshold, image, region, avg((score {op} threshold)::int) c from cells join grid using (image, y, x), t group by all) group by all),
fpr as (select threshold, avg((score {op} threshold)::int) fpr from grid, t where truth = 0 group by all),
b as (select fpr, max(pro) pro from (select fpr, pro from pro join fpr using (threshold) union all select 0, 0) group by all),
l as (select fpr, pro, lag(fpr) over (order by fpr) x0, lag(pro) over (order by fpr) y0 from b)
select round(sum((least(fpr, 0.3) - x0) * (y0 + y0 + (pro - y0) * (least(fpr, 0.3) - x0) / (fpr - x0)) / 2) / 0.3, 6) area from l where x0 < 0.3"""


@query("aupro_quantile", _aupro_sql("select unnest(list_distinct(quantile_cont(score, [" + ", ".join(f"{i / 63!r}" for i in range(64)) + "]))) threshold from grid", ">="))
def aupro_quantile(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(spark, sf)
    cells = regions.regions(g.filter("truth = 1"), ["image"]).join(g, ["image", "y", "x"])
    t = ranking.quantile_thresholds(g, [], "score", 64)
    return _rounded(regions.aupro(regions.region_curve(cells, g, t, ["image"], "truth", "score", strict=False)), "area")


@query("aupro_linear", _aupro_sql("select max(score) - (max(score) - min(score)) * i / 199 threshold from grid, range(200) r(i) group by i", ">"))
def aupro_linear(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(spark, sf)
    cells = regions.regions(g.filter("truth = 1"), ["image"]).join(g, ["image", "y", "x"])
    t = ranking.linear_thresholds(g, [], "score").select("threshold")
    return _rounded(regions.aupro(regions.region_curve(cells, g, t, ["image"], "truth", "score", strict=True)), "area")


@query(
    "localization",
    f"""with {GRID}, i as (select image, sum(truth) t, count_if(score > 300 and truth = 1) tp, count_if(score > 300) p, count(*) n from grid group by all)
select round(avg(tp / t) filter (t > 0), 6) mean_recall, round(avg(tp / t) filter (t > 0 and t <= 0.2 * n), 6) small_recall, round(avg((p > 0)::int) filter (t = 0), 6) normal_positive_rate, round(sum(p) / nullif(sum(t), 0), 6) oversegmentation from i""",
)
def localization(spark: SparkSession, sf: str) -> DataFrame:
    got = projections.localization(grid(spark, sf), ["image"], F.col("score") > 300, 0.2)
    return got.withColumns({c: r6(c) for c in got.columns})


@query("patch_mask", f"with {GRID} select image, (y // 3)::int py, (x // 3)::int px, max(truth) truth from grid group by all")
def patch_mask(spark: SparkSession, sf: str) -> DataFrame:
    return regions.patch_mask(grid(spark, sf), ["image"], 3)


@query(
    "bilinear_upsample",
    f"""with {GRID}, f as (select image, y, x, score from grid),
ax as (select m, i, case when greatest((i + 0.5) * m / (2 * m) - 0.5, 0) is not null then greatest((i + 0.5) * m / (2 * m) - 0.5, 0) end pos from (select 30 m, unnest(range(60)) i union all select 6, unnest(range(12)))),
w as (select m, i, least(floor(pos), m - 1)::int cell, (1 - (pos - floor(pos)))::double w from ax union all select m, i, least(floor(pos) + 1, m - 1)::int, (pos - floor(pos))::double from ax)
select image, wy.i::int oy, wx.i::int ox, round(sum(score * wy.w * wx.w), 6) score from f join w wy on wy.m = 30 and wy.cell = y join w wx on wx.m = 6 and wx.cell = x group by all""",
)
def bilinear(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(spark, sf).select("image", "y", "x", "score")
    return regions.bilinear(g, ["image"], (30, 6), (60, 12)).withColumn("score", r6("score"))
