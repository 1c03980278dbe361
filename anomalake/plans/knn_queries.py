"""Registered queries: nearest neighbours and their calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomalake.functions.vectors import normalized
from anomalake.operators import calibration as cal
from anomalake.operators import knn, subspace
from anomalake.plans.tables import SCALED, layers, r6, table, vectors

Q: dict = {}
SQL: dict[str, str] = {}
PAIRS = """q as (select vec_id, embedding::double[] v, label from embeddings where vec_id % 8 = 0),
b as (select vec_id, embedding::double[] v, label from embeddings where vec_id % 8 <> 0)"""


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query(
    "knn_calibrated_report",
    f"""with {PAIRS}, d as (select q.vec_id, q.label, min(list_distance(q.v, b.v)) d from q, b group by all),
s as (select label, count(*) n, quantile_cont(d, 0.5) median, greatest(1.4826 * mad(d), 1e-8) scale from d group by all)
select s.label, n, round(median, 6) median, round(scale, 6) scale, round(max((d - median) / scale), 4) max_z from s join d using (label) group by all""",
)
def report(spark: SparkSession, sf: str) -> DataFrame:
    q, b = vectors(spark, sf)
    d = knn.nearest(q, b).join(q.select(F.col("id").alias("query_id"), "label"), "query_id")
    s = cal.scaled_mad(d, ["label"], "distance", least_rows=1)
    z = cal.standardize(d, s, ["label"], "distance")
    top = z.groupBy("label").agg(F.max("z").alias("max_z"))
    return s.join(top, "label").select("label", "n", r6("median").alias("median"), r6("scale").alias("scale"), F.round("max_z", 4).alias("max_z"))


for _name, _metric, _f in (("knn1_l2", "l2", "list_distance(q.v, b.v)"), ("knn1_squared", "squared", "list_distance(q.v, b.v) ** 2"), ("knn1_cosine", "cosine", "list_cosine_distance(q.v, b.v)")):

    def _one(spark: SparkSession, sf: str, metric: str = _metric) -> DataFrame:
        q, b = vectors(spark, sf)
        return knn.nearest(q, b, 1, metric).select("query_id", "bank_id", r6("distance").alias("distance"))

    query(_name, f"with {PAIRS}, d as (select q.vec_id query_id, b.vec_id bank_id, {_f} d from q, b) select query_id, arg_min(bank_id, d) bank_id, round(min(d), 6) distance from d group by all")(_one)


@query("knn5_l2", f"with {PAIRS}, d as (select q.vec_id query_id, b.vec_id bank_id, list_distance(q.v, b.v) d from q, b) select query_id, bank_id, round(d, 6) distance, row_number() over (partition by query_id order by d, bank_id)::int rank from d qualify rank <= 5")
def knn5(spark: SparkSession, sf: str) -> DataFrame:
    q, b = vectors(spark, sf)
    return knn.nearest(q, b, 5).select("query_id", "bank_id", r6("distance").alias("distance"), "rank")


@query("multi_bank_cosine", f"with {PAIRS} select q.vec_id query_id, b.label bank, round(1 - max(list_cosine_similarity(q.v, b.v)), 6) score from q, b group by all")
def multi_bank(spark: SparkSession, sf: str) -> DataFrame:
    q, b = vectors(spark, sf)
    return knn.nearest(q, b, 1, "cosine", by="label").select("query_id", F.col("label").alias("bank"), r6("distance").alias("score"))


@query(
    "topk_vote",
    f"""with {PAIRS}, d as (select q.vec_id query_id, b.label, row_number() over (partition by q.vec_id order by list_cosine_distance(q.v, b.v), b.vec_id) r from q, b),
c as (select query_id, label, count(*) votes from d where r <= 5 group by all)
select query_id, label, votes from c qualify row_number() over (partition by query_id order by votes desc, label) = 1""",
)
def topk_vote(spark: SparkSession, sf: str) -> DataFrame:
    q, b = vectors(spark, sf)
    return knn.vote(knn.nearest(q, b, 5, "cosine"), b.select("id", "label"))


@query(
    "nearest_label_lookup",
    f"with {PAIRS}, d as (select q.vec_id query_id, q.label own, b.label, list_distance(q.v, b.v) d from q, b), n as (select query_id, own, arg_min(label, d) label from d group by all) select own, count(*) n, count_if(own = label) agreed from n group by all",
)
def nearest_label(spark: SparkSession, sf: str) -> DataFrame:
    q, b = vectors(spark, sf)
    n = knn.nearest(q, b).join(b.select(F.col("id").alias("bank_id"), "label"), "bank_id").join(q.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return n.groupBy("own").agg(F.count("*").alias("n"), F.count_if(F.col("own") == F.col("label")).alias("agreed"))


@query(
    "centroid_assign",
    """with c as (select label, list(m order by i) v from (select label, i, avg(x) m from (select label, generate_subscripts(embedding, 1) i, unnest(embedding)::double x from embeddings) group by all) group by all),
d as (select vec_id query_id, c.label, list_cosine_distance(embedding::double[], c.v) d from embeddings, c)
select query_id, arg_min(label, d)::bigint assigned, round(min(d), 6) distance from d group by all""",
)
def centroid_assign(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    c = v.select("label", F.posexplode("vec")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("x"))
    centres = c.select(F.col("label").cast("long").alias("id"), F.transform("x", lambda p: p["m"]).alias("vec"))
    return knn.nearest(v, centres, 1, "cosine").select("query_id", F.col("bank_id").alias("assigned"), r6("distance").alias("distance"))


@query("channel_scaled_grid", f"with {PAIRS}, d as (select q.vec_id id, min(list_distance(q.v, b.v)) / 64 d from q, b group by all) select vec_id cell, round(coalesce(d, 0), 6) distance from embeddings left join d on id = vec_id")
def channel_scaled(spark: SparkSession, sf: str) -> DataFrame:
    q, b = vectors(spark, sf)
    n = knn.nearest(q, b).join(q.select(F.col("id").alias("query_id"), F.size("vec").alias("channels")), "query_id").select(F.col("query_id").alias("cell"), (F.col("distance") / F.col("channels")).alias("distance"), "bank_id")
    return knn.dense(n, table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell")), ["cell"]).select("cell", r6("distance").alias("distance"))


@query("normalized_vectors", "select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 4) norm, round(embedding[1]::double / sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) first from embeddings")
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    n = normalized(F.col("embedding"))
    return v.select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 4).alias("norm"), r6(n[0]).alias("first"))


@query("anchor_labels", f"with {PAIRS}, d as (select q.vec_id query_id, b.label, row_number() over (partition by q.vec_id order by list_distance(q.v, b.v), b.vec_id) layer, list_distance(q.v, b.v) d from q, b), n as (select query_id, label, count(*) votes, avg(d) cost from d where layer <= 4 group by all) select query_id, (case when votes >= 2 then label else -1 end)::int as label from n qualify row_number() over (partition by query_id order by votes desc, cost, label) = 1")
def anchor_labels(spark: SparkSession, sf: str) -> DataFrame:
    q, b = vectors(spark, sf)
    n = knn.nearest(q, b, 4).join(b.select(F.col("id").alias("bank_id"), "label"), "bank_id")
    return knn.resolve_anchor(n.select("query_id", F.col("rank").alias("layer"), "label", F.col("distance").alias("cost")))


@query("subspace_residuals")
def subspace_residuals(spark: SparkSession, sf: str) -> DataFrame:
    q, b = vectors(spark, sf)
    m = subspace.moments(b, "label")
    bases = {g: subspace.basis(*v, rank=8, centered=True) for g, v in m.items()}
    total = subspace.moments(b)
    bases[None] = subspace.basis(*total[""], rank=8, centered=True)
    return subspace.residuals(q, bases, "label").select("id", r6("residual").alias("residual"), r6("explained").alias("explained"))


@query("prototype_clusters")
def prototype_clusters(spark: SparkSession, sf: str) -> DataFrame:
    _, b = vectors(spark, sf)
    return subspace.spherical_kmeans(b, 10).groupBy("cluster").agg(F.count("*").alias("n"))


@query("mad_scaled", "select event_type, count(*) n, round(quantile_cont(value, 0.5), 6) median, round(greatest(1.4826 * mad(value), 1e-8), 6) scale from events group by all having count(*) >= 100")
def mad_scaled(spark: SparkSession, sf: str) -> DataFrame:
    got = cal.scaled_mad(table(spark, sf, "events"), ["event_type"], "value", least_rows=100)
    return got.filter("scale is not null").select("event_type", "n", r6("median").alias("median"), r6("scale").alias("scale"))


@query(
    "mad_plus_epsilon",
    """with s as (select event_type, quantile_cont(value, 0.5) median, mad(value) + 1e-6 mad from events group by all),
z as (select event_type, user_id, (value - median) / mad z from events join s using (event_type)),
i as (select event_type, quantile_cont(m, 0.95) t from (select event_type, user_id, max(z) m from z group by all) group by all)
select event_type, round(median, 6) median, round(mad, 6) mad, round(any_value(i.t), 6) tau_image, round(quantile_cont(z, 0.995), 6) tau_pixel from z join s using (event_type) join i using (event_type) group by event_type, median, mad""",
)
def mad_plus_epsilon(spark: SparkSession, sf: str) -> DataFrame:
    got = cal.mad_plus_epsilon(table(spark, sf, "events"), ["event_type"], "value", "user_id")
    return got.select("event_type", *(r6(c).alias(c) for c in ("median", "mad", "tau_image", "tau_pixel")))


@query(
    "mad_clamped",
    """with s as (select event_type, quantile_cont(value, 0.5) median, greatest(mad(value), 1e-6) mad from events group by all),
z as (select event_type, user_id, max(greatest((value - median) / mad, 0)) m from events join s using (event_type) group by all)
select event_type, round(median, 6) median, round(mad, 6) mad, round(quantile_cont(m, 0.95), 6) threshold from z join s using (event_type) group by event_type, median, mad""",
)
def mad_clamped(spark: SparkSession, sf: str) -> DataFrame:
    got = cal.clamped_mad(table(spark, sf, "events"), ["event_type"], "value", "user_id")
    return got.select("event_type", r6("median").alias("median"), r6("mad").alias("mad"), r6("threshold").alias("threshold"))


@query(
    "ecdf_surprise",
    """with r as (select event_type, value from events where user_id % 2 = 0), n as (select event_type, count(*) n from r group by all),
c as (select e.event_id, e.event_type, count(r.value) c from events e left join r on r.event_type = e.event_type and r.value <= e.value where e.user_id % 2 = 1 group by all)
select event_id, round(-ln(1 - c / n + 1e-8), 6) surprise from c join n using (event_type)""",
)
def ecdf_surprise(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return cal.ecdf_surprise(e.filter("user_id % 2 = 1"), e.filter("user_id % 2 = 0"), ["event_type"], "value").select("event_id", r6("surprise").alias("surprise"))


@query("layer_equal_fusion", f"with {SCALED} select image, round(avg((raw - median) / scale), 6) fused from layers join stats using (layer) group by all")
def layer_equal_fusion(spark: SparkSession, sf: str) -> DataFrame:
    x = layers(spark, sf)
    z = cal.standardize(x, cal.scaled_mad(x, ["layer"], "raw"), ["layer"], "raw")
    return cal.layer_equal(z, ["image"]).select("image", r6("fused").alias("fused"))


@query("score_variants", f"with {SCALED} select image, round(avg(raw), 4) raw_mean, round(avg((raw - median) / scale), 6) mad_equal, round(max((raw - median) / scale) filter (layer = 'tax'), 6) last_layer from layers join stats using (layer) group by all")
def score_variants(spark: SparkSession, sf: str) -> DataFrame:
    x = layers(spark, sf)
    z = cal.standardize(x, cal.scaled_mad(x, ["layer"], "raw"), ["layer"], "raw")
    return cal.variants(z, ["image"], "tax").select("image", F.round("raw_mean", 4).alias("raw_mean"), r6("mad_equal").alias("mad_equal"), r6("last_layer").alias("last_layer"))


@query(
    "reliability_weighted",
    f"""with {SCALED}, z as (select image, layer, image % 7 as label, (raw - median) / scale z from layers join stats using (layer)),
w as (select layer, label, avg((z > 1)::int) w from z where label < 5 group by all), g as (select layer, avg((z > 1)::int) g from z group by all)
select image, round(sum((greatest(coalesce(w, g), 0) + 1e-8) * z) / sum(greatest(coalesce(w, g), 0) + 1e-8), 6) weighted from z left join w using (layer, label) join g using (layer) group by all""",
)
def reliability_weighted(spark: SparkSession, sf: str) -> DataFrame:
    x = layers(spark, sf)
    z = cal.standardize(x, cal.scaled_mad(x, ["layer"], "raw"), ["layer"], "raw").withColumn("label", F.col("image") % 7)
    hit = F.avg((F.col("z") > 1).cast("double")).alias("weight")
    w = z.filter("label < 5").groupBy("layer", "label").agg(hit).unionByName(z.groupBy("layer").agg(hit).withColumn("label", F.lit(None).cast("long")))
    return cal.reliability_weighted(z, w, ["image"], "label").select("image", r6("weighted").alias("weighted"))


@query("fused_methods", f"with {SCALED}, z as (select image, max(greatest((raw - median) / scale, 0)) filter (layer = 'quantity') a, max(greatest((raw - median) / scale, 0)) filter (layer = 'tax') b from layers join stats using (layer) group by all) select image, round(0.75 * a + 0.25 * b, 6) fused_25, round(0.5 * a + 0.5 * b, 6) fused_50 from z")
def fused_methods(spark: SparkSession, sf: str) -> DataFrame:
    x = layers(spark, sf)
    s = cal.scaled_mad(x, ["layer"], "raw")
    z = x.join(s, "layer").withColumn("z", cal.clamped(F.col("raw"), F.col("median"), F.col("scale")))
    p = z.groupBy("image").agg(*(F.max(F.when(F.col("layer") == n, F.col("z"))).alias(k) for n, k in (("quantity", "a"), ("tax", "b"))))
    return p.select("image", r6(cal.blend(F.col("a"), F.col("b"), 0.25)).alias("fused_25"), r6(cal.blend(F.col("a"), F.col("b"), 0.5)).alias("fused_50"))


@query(
    "wilson_reliability",
    """with o as (select c_nationkey nation, o_orderpriority priority, (o_totalprice > avg(o_totalprice) over ())::int s from orders join customer on o_custkey = c_custkey),
t as (select priority, sum(s) s, count(*) n from o group by all), c as (select nation, priority, sum(s) s, count(*) n from o group by all),
g as (select nation, t.priority, coalesce(c.s, 0) s, coalesce(c.n, 0) n, t.s ts, t.n tn from (select distinct nation from o) cross join t left join c using (nation, priority)
  union all select null, priority, s, n, s, n from t),
p as (select *, case when n < 120 then ts else s end::double k, case when n < 120 then tn else n end::double m from g)
select nation, priority, s::bigint successes, n::bigint n, round(greatest((k / m + z * z / (2 * m) - z * sqrt(k / m * (1 - k / m) / m + z * z / (4 * m * m))) / (1 + z * z / m), 0), 6) as value, (n < 120 and nation is not null) fallback
from p, (select 1.6448536269514722::double z)""",
)
def wilson_reliability(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    o = o.join(F.broadcast(o.agg(F.avg("o_totalprice").alias("_m"))), F.lit(True))
    return cal.reliability(o, F.col("o_totalprice") > F.col("_m"), "nation", "priority", least=120).withColumn("value", r6("value"))


