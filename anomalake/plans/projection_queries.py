"""Registered queries: method projections, calibration pivots, thresholds, resources, grids, instances and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomalake.functions.vectors import normalized
from anomalake.operators import calibration, projections, ranking, regions, selection
from anomalake.plans.metric_queries import _aupro_sql
from anomalake.plans.table_queries import METHODS, _methods
from anomalake.plans.tables import REGIONS, SCALED, grid, layers, r6, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


KINDS = ("Relation", "Shuffled", "Feature", "Position")
_weighted = ", ".join(f"round(sum((greatest(coalesce(w{i}, g), 0) + 1e-8) * ecdf) / sum(greatest(coalesce(w{i}, g), 0) + 1e-8), 5) as {k}" for i, k in enumerate(KINDS))
_own = ", ".join(f"case when image % {7 + i} > 0 and (image % {7 + i} + l * {i + 1}) % 5 <> 4 then ((image % {7 + i} + l * {i + 1}) % 5) / 4.0 - 0.25 end w{i}" for i in range(4))


@query(
    "method_projections",
    f"""with {SCALED}, o as (select layer, row_number() over (order by layer) l from stats), c as (select layer, raw, -ln(1 - (sum(count(*)) over (partition by layer order by raw)) / (sum(count(*)) over (partition by layer)) + 1e-8) ecdf from layers group by layer, raw),
z as (select image, layer, raw, ecdf, (raw - median) / scale mad, l / 10.0 g, {_own} from layers join stats using (layer) join c using (layer, raw) join o using (layer))
select image, round(avg(raw), 4) as Official, round(max(raw) filter (layer = 'discount'), 4) L_discount, round(max(raw) filter (layer = 'extendedprice'), 4) L_extendedprice, round(max(raw) filter (layer = 'quantity'), 4) L_quantity, round(max(raw) filter (layer = 'tax'), 4) L_tax,
  round(avg(ecdf), 5) ECDF_Equal, round(avg(mad), 5) MAD_Equal, round(sum((g + 1e-8) * ecdf) / sum(g + 1e-8), 5) as "Global", {_weighted} from z group by image""",
)
def method_projections(spark: SparkSession, sf: str) -> DataFrame:
    long = layers(spark, sf, in_order=True)  # equal sums have to be one value to the ECDF
    z = calibration.standardize(long, calibration.scaled_mad(long, ["layer"], "raw", 1), ["layer"], "raw", "mad")
    ecdf = calibration.ecdf_surprise(long, long, ["layer"], "raw").select("image", "layer", F.col("surprise").alias("ecdf"))
    z = z.join(ecdf, ["image", "layer"])
    names = ["discount", "extendedprice", "quantity", "tax"]
    w = [("Global", None, x, i / 10.0) for i, x in enumerate(names, 1)]
    for i, k in enumerate(KINDS):
        w += [(k, v, x, ((v + n * (i + 1)) % 5) / 4.0 - 0.25) for v in range(1, 7 + i) for n, x in enumerate(names, 1) if (v + n * (i + 1)) % 5 != 4]
    labels = {f"_{k}": F.when(F.col("image") % (7 + i) > 0, F.col("image") % (7 + i)) for i, k in enumerate(KINDS)}
    got = projections.method_scores(z.withColumns(labels), spark.createDataFrame(w, "method string, label long, layer string, weight double"), ["image"], {k: f"_{k}" for k in KINDS})
    return got.withColumns({c: F.round(c, 4 if c == "Official" or c.startswith("L_") else 5) for c in got.columns if c != "image"})


@query("five_maps", f"with {SCALED}, z as (select image, max((raw - median) / scale) filter (layer = 'quantity') a, max((raw - median) / scale) filter (layer = 'tax') b, max((raw - median) / scale) filter (layer = 'discount') c from layers join stats using (layer) group by all) select image, round(a, 6) base, round(b, 6) as first, round(c, 6) as second, round((a + b) / 2, 6) base_first, round((a + c) / 2, 6) base_second from z")
def five_maps(spark: SparkSession, sf: str) -> DataFrame:
    long = layers(spark, sf)
    z = calibration.standardize(long, calibration.scaled_mad(long, ["layer"], "raw", 1), ["layer"], "raw")
    wide = z.groupBy("image").agg(*(F.max(F.when(F.col("layer") == x, F.col("z"))).alias(x) for x in ("quantity", "tax", "discount")))
    got = wide.select("image", *projections.five_maps(F.col("quantity"), F.col("tax"), F.col("discount")))
    return got.withColumns({c: r6(c) for c in got.columns if c != "image"})


@query("conditional_residual", "select vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(embedding[i]::double - (1 - label / 10.0) * (case when i <= 8 then embedding[i]::double else 0 end) - label / 10.0 * (case when i > label * 4 and i <= label * 4 + 4 then embedding[i]::double else 0 end), 2)))), 5) residual from embeddings")
def conditional_residual(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    common = F.transform("v", lambda x, i: F.when(i < 8, x).otherwise(0.0))
    local = F.transform("v", lambda x, i: F.when((i >= F.col("label") * 4) & (i < F.col("label") * 4 + 4), x).otherwise(0.0))
    return e.select("vec_id", F.round(projections.conditional_residual(F.col("v"), common, local, F.col("label") / 10.0), 5).alias("residual"))


_STATE = "c as (select event_type as category, user_id % 4 as layer, round(quantile_cont(value, 0.5), 6) median, round(greatest(1.4826 * mad(value), 1e-8), 6) scale from events group by all)"


def _state(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("category"), (F.col("user_id") % 4).alias("layer"), "value")
    return calibration.scaled_mad(e, ["category", "layer"], "value", 1).select("category", "layer", r6("median").alias("median"), r6("scale").alias("scale"))


@query("calibration_pivot", f"with {_STATE} select category, " + ", ".join(f"max({c}) filter (layer = {i}) {c}_{i}" for i in range(4) for c in ("median", "scale")) + " from c group by all")
def calibration_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return projections.pivot_state(_state(spark, sf), "category", list(range(4)))


@query("calibration_rows", f"with {_STATE} select category, layer::int as layer, median, scale from c where layer <> 3")
def calibration_rows(spark: SparkSession, sf: str) -> DataFrame:
    return projections.unpivot_state(projections.pivot_state(_state(spark, sf), "category", [0, 1, 2]), "category", [0, 1, 2])


@query("pooled_threshold", "select event_type, count(*) n, round(quantile_cont(value, 0.995) * 1.2, 6) threshold from events group by all")
def pooled_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return projections.pooled_threshold(table(spark, sf, "events"), ["event_type"], "value", 99.5, 1.2).withColumn("threshold", r6("threshold"))


@query("value_report", "with v as (select unnest(['l_quantity', 'ratio']) as \"column\", unnest([l_quantity, case when l_tax > 0 then l_discount / l_tax end]) v, l_tax t, l_discount d from lineitem) select \"column\", count(*) n, count_if(v is null and not (\"column\" = 'ratio' and t = 0 and d > 0)) missing, count_if(\"column\" = 'ratio' and t = 0 and d > 0) not_finite, count_if(v is null) = 0 sound from v group by all")
def value_report(spark: SparkSession, sf: str) -> DataFrame:
    ratio = F.when(F.col("l_tax") > 0, F.col("l_discount") / F.col("l_tax")).when(F.col("l_discount") > 0, float("inf"))
    return projections.value_report(table(spark, sf, "lineitem").select("l_quantity", ratio.alias("ratio")), ["l_quantity", "ratio"])


@query("candidate_resources", "select c_mktsegment segment, count(*) images, sum((h // 16) * (w // 16))::bigint patches, (sum((h // 16) * (w // 16)) * 5120)::bigint bytes, least(sum((h // 16) * (w // 16)), 100000)::bigint entries from (select c_mktsegment, c_custkey, 64 + c_custkey % 640 h, 64 + c_nationkey * 20 w from customer) where c_custkey % 8 <> 0 group by all")
def candidate_resources(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("i"), (64 + F.col("c_custkey") % 640).alias("h"), (64 + F.col("c_nationkey") * 20).alias("w"))
    return projections.candidate_resources(c, ["segment"], 16, 1280, 100_000, "i")


@query("crop_counts", "select p_partkey, case when side <= 448 then 1 else ceil((side - 448) / 224.0)::int + 1 end crops from (select p_partkey, (p_retailprice)::int side from part)")
def crop_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", projections.crops(F.round("p_retailprice").cast("int"), 448, 224).alias("crops"))


@query("grid_distances", "select (a // 1)::int a, b::int b, (b // 6 - a // 6)::int dy, (b % 6 - a % 6)::int dx, sqrt(pow(b // 6 - a // 6, 2) + pow(b % 6 - a % 6, 2)) distance from range(36) x(a), range(36) y(b)")
def grid_distances(spark: SparkSession, sf: str) -> DataFrame:
    return projections.grid_distances(spark, 6)


@query("config_product", "select * from (values (5000), (30000)) a(size), (values ('kcenter'), ('random'), ('full')) b(strategy), (values (0.25), (0.5)) c(alpha)")
def config_product(spark: SparkSession, sf: str) -> DataFrame:
    return projections.product(spark, size=[5000, 30000], strategy=["kcenter", "random", "full"], alpha=[0.25, 0.5])


@query("augmented_candidates", "select vec_id, source, round(list_sum(list_transform(v, lambda x: abs(x) / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12))), 4) mass from (select vec_id, 'original' source, embedding::double[] v from embeddings union all select vec_id, 'transformed', list_transform(embedding::double[], lambda x: x * 0.5 + 0.01) from embeddings)")
def augmented_candidates(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    both = e.withColumn("source", F.lit("original")).unionByName(e.select("vec_id", F.transform("v", lambda x: x * 0.5 + 0.01).alias("v"), F.lit("transformed").alias("source")))
    return both.select("vec_id", "source", F.round(F.aggregate(normalized(F.col("v")), F.lit(0.0), lambda s, x: s + F.abs(x)), 4).alias("mass"))


@query("instance_rows", f"with recursive {REGIONS}, p as (select image, region, count(*) size, quantile_cont(score, 0.95) q, max(score) m, min(y * 10 + x)::int first_cell from cells join grid using (image, y, x) group by all) select image, first_cell, size, round(q, 5) q95, m peak, round(q - 300, 5) margin, m > 300 detected from p")
def instance_rows(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(spark, sf)
    cells = regions.regions(g.filter("truth = 1"), ["image"]).join(g, ["image", "y", "x"])
    first = cells.groupBy("image", "region").agg(F.min(F.col("y") * 10 + F.col("x")).alias("first_cell"))
    got = projections.instance_rows(cells, ["image"], "score", 300.0).join(first, ["image", "region"])
    return got.select("image", "first_cell", "size", F.round("q95", 5).alias("q95"), "peak", F.round("margin", 5).alias("margin"), "detected")


@query("aupro_closed", _aupro_sql("select unnest(list_distinct(quantile_cont(score, [" + ", ".join(f"{i / 255!r}" for i in range(256)) + "]))) threshold from grid", ">=").replace("union all select 0, 0)", "union all select 0, 0 union all select 1, 1)"))
def aupro_closed(spark: SparkSession, sf: str) -> DataFrame:
    g = grid(spark, sf)
    cells = regions.regions(g.filter("truth = 1"), ["image"]).join(g, ["image", "y", "x"])
    curve = regions.region_curve(cells, g, ranking.quantile_thresholds(g, [], "score", 256), ["image"], "truth", "score", strict=False)
    return regions.aupro(curve, closed=True).withColumn("area", r6("area"))


@query(
    "method_summary",
    f"""with {METHODS}, l as (select category, method, unnest(['auroc', 'ap']) metric, unnest([auroc, ap]) as "value" from r), j as (select a.method, a.metric, a.value v, a.value - b.value d from l a left join l b on b.method = 'customer' and a.category = b.category and a.metric = b.metric)
select method, metric, round(avg(v), 4) macro, count(v) valid, round(avg(d), 4) delta, count(*) filter (d > 1e-10) improved, count(*) filter (abs(d) <= 1e-10) tied, count(*) filter (d < -1e-10) declined from j group by all""",
)
def method_summary(spark: SparkSession, sf: str) -> DataFrame:
    return projections.summary(_methods(spark, sf), "category", "method", "customer", ["auroc", "ap"]).withColumns({c: F.round(c, 4) for c in ("macro", "delta")})


@query(
    "budget_floors",
    "select p_size, n, least(n, 1) floor_budget from (select p_size, count(*) n from part group by all)",
)
def budget_floors(spark: SparkSession, sf: str) -> DataFrame:
    """The budgets where the total is that of the floors: each cluster gets its floor and no more."""
    c = {r.p_size: r.n for r in table(spark, sf, "part").groupBy("p_size").agg(F.count("*").alias("n")).collect()}  # a row a cluster
    got = selection.waterfill(c, sum(min(n, 1) for n in c.values()), 1)
    return spark.createDataFrame([(k, c[k], v) for k, v in sorted(got.items())], "p_size int, n long, floor_budget long")
