"""Registered queries: reports, splits, selection, signatures and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomalake.functions import hashing
from anomalake.operators import relation, reports, selection
from anomalake.plans.tables import r6, table, vectors

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _methods(spark: SparkSession, sf: str) -> DataFrame:
    """(category, method, auroc, ap): a report whose second metric is missing for some categories."""
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("category")).agg(F.avg("s_acctbal").alias("auroc"), F.max("s_acctbal").alias("m")).withColumn("method", F.lit("supplier"))
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("category")).agg(F.avg("c_acctbal").alias("auroc"), F.max("c_acctbal").alias("m")).withColumn("method", F.lit("customer"))
    return s.unionByName(c).select("category", "method", "auroc", F.when(F.col("m") > 9000, F.col("m")).alias("ap"))


METHODS = """r as (select category, method, auroc, case when m > 9000 then m end ap from (select s_nationkey category, avg(s_acctbal) auroc, max(s_acctbal) m, 'supplier' as method from supplier group by all
  union all select c_nationkey, avg(c_acctbal), max(c_acctbal), 'customer' from customer group by all))"""


@query("macro_with_na", f"with {METHODS} select method, count(*) categories, round(avg(auroc), 4) auroc, count(auroc) auroc_valid, round(avg(ap), 4) ap, count(ap) ap_valid from r group by all")
def macro_with_na(spark: SparkSession, sf: str) -> DataFrame:
    return reports.macro(_methods(spark, sf), ["method"], ["auroc", "ap"]).withColumns({"auroc": F.round("auroc", 4), "ap": F.round("ap", 4)})


@query("metric_deltas", f"with {METHODS} select a.category, a.method, round(a.auroc - b.auroc, 4) delta_auroc, round(a.ap - b.ap, 4) delta_ap from r a join r b on a.category = b.category and b.method = 'customer' where a.method <> 'customer'")
def metric_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return reports.deltas(_methods(spark, sf), ["category"], "method", "customer", ["auroc", "ap"]).withColumns({c: F.round(c, 4) for c in ("delta_auroc", "delta_ap")})


@query("change_counts", f"with {METHODS} select a.method, count_if(a.auroc - b.auroc > 1e-10) improved, count_if(abs(a.auroc - b.auroc) <= 1e-10) tied, count_if(a.auroc - b.auroc < -1e-10) declined from r a join r b on a.category = b.category and b.method = 'customer' where a.method <> 'customer' group by all")
def change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.changes(reports.deltas(_methods(spark, sf), ["category"], "method", "customer", ["auroc"]), ["method"], "delta_auroc")


@query("relative_drop", f"with {METHODS} select round(avg(least(0, a.auroc - b.auroc)), 6) as drop_ from r a join r b on a.category = b.category and b.method = 'customer' where a.method = 'supplier'")
def relative_drop(spark: SparkSession, sf: str) -> DataFrame:
    m = _methods(spark, sf)
    a = m.filter("method = 'supplier'").select("category", F.col("auroc").alias("t"))
    return a.join(m.filter("method = 'customer'").select("category", F.col("auroc").alias("s")), "category").agg(r6(reports.average_relative_drop(F.col("s"), F.col("t"))).alias("drop_"))


@query("audit_counts", "select n_name nation, c_mktsegment segment, count(*) images, count_if(c_acctbal < 0) anomalies, count_if(o is null) without_mask, round(min(c_acctbal), 2) least from customer join nation on c_nationkey = n_nationkey left join (select distinct o_custkey o from orders) on o = c_custkey group by all")
def audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "orders").select(F.col("o_custkey").alias("o")).distinct(), F.col("o") == F.col("c_custkey"), "left")
    return c.groupBy(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("images"), F.count_if(F.col("c_acctbal") < 0).alias("anomalies"), F.count_if(F.col("o").isNull()).alias("without_mask"), F.round(F.min("c_acctbal"), 2).alias("least"))


@query("stage_rollup", "select event_type as phase, user_id % 5 as stage, count(*) calls, round(sum(value), 2) as seconds, max(value) as peak from events group by all")
def stage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("phase"), (F.col("user_id") % 5).alias("stage"), F.col("value").alias("seconds"), F.col("value").alias("peak"))
    return reports.stage_rollup(e).withColumn("seconds", F.round("seconds", 2))


@query(
    "protocol_rank",
    """with g as (select s_nationkey protocol, count(*) runs, avg(s_acctbal) mean, stddev_pop(s_acctbal) std, avg(s_suppkey) cost from supplier group by all), n as (select *, mean >= max(mean) over () - 800 near from g)
select protocol, runs, round(mean, 4) mean, round(std, 4) std, round(cost, 4) cost, near, row_number() over (order by near desc, case when near then cost end, mean desc, protocol)::int rank from n""",
)
def protocol_rank(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("protocol"), "s_acctbal", F.col("s_suppkey").cast("double").alias("c"))
    return reports.rank_protocols(s, "protocol", "s_acctbal", "c", 800.0).withColumns({c: F.round(c, 4) for c in ("mean", "std", "cost")})


@query("modulus_split", "select c_custkey, case when (row_number() over (partition by c_mktsegment order by c_custkey) - 1) % 8 = 0 then 'calibration' else 'memory' end split from customer")
def modulus_split(spark: SparkSession, sf: str) -> DataFrame:
    return selection.modulus_split(table(spark, sf, "customer"), ["c_mktsegment"], ["c_custkey"]).select("c_custkey", "split")


@query("cap_per_group", "select o_orderkey, o_orderpriority from orders qualify row_number() over (partition by o_orderpriority, o_orderstatus order by o_orderkey) <= 20")
def cap_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return selection.cap_per_group(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], ["o_orderkey"], 20).select("o_orderkey", "o_orderpriority")


@query(
    "three_way_split",
    """with n as (select count(*) n, round(count(*) * 0.2)::bigint k from customer), a as (select c_custkey, row_number() over (order by md5('42|' || c_custkey), c_custkey) r from customer),
b as (select c_custkey, r > k late, k, n, row_number() over (partition by r > k order by md5('43|' || c_custkey), c_custkey) s from a, n)
select c_custkey, case when not late then 'calibration' when s <= round((n - k) * 0.3)::bigint then 'fit' else 'memory' end split from b""",
)
def three_way_split(spark: SparkSession, sf: str) -> DataFrame:
    return selection.three_way_split(table(spark, sf, "customer"), "c_custkey").select("c_custkey", "split")


@query("random_bank", "select p_partkey from part order by md5('42|' || p_partkey), p_partkey limit 100")
def random_bank(spark: SparkSession, sf: str) -> DataFrame:
    return selection.random_bank(table(spark, sf, "part"), "p_partkey", 100).select("p_partkey")


@query("balanced_quota", "with f as (select p_brand, row_number() over (partition by p_brand order by p_partkey) i from part), t as (select * from f order by i, p_brand limit 90) select p_brand, n, coalesce(quota, 0) quota from (select p_brand, count(*) n from f group by all) left join (select p_brand, count(*) quota from t group by all) using (p_brand)")
def balanced_quota(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return selection.round_robin_quota(c, "p_brand", 90)


@query("waterfill")
def waterfill(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "part").groupBy("p_size").agg(F.count("*").alias("n")).collect()  # a row a cluster
    got = selection.waterfill({r.p_size: r.n for r in c}, 100, 1)
    return spark.createDataFrame(sorted(got.items()), "p_size int, budget int")


@query("stratified_bank", "select p_partkey, p_size from part qualify row_number() over (partition by p_size order by md5('42|' || p_partkey), p_partkey) <= 2 * p_size")
def stratified_bank(spark: SparkSession, sf: str) -> DataFrame:
    return selection.stratified(table(spark, sf, "part"), "p_size", {i: 2 * i for i in range(1, 51)}, "p_partkey").select("p_partkey", "p_size")


@query("kcenter_bank")
def kcenter_bank(spark: SparkSession, sf: str) -> DataFrame:
    _, b = vectors(spark, sf)
    return selection.kcenter_bank(b, b.groupBy("label").agg(F.lit(5).alias("quota")), "label")


@query("merge_reduce_bank")
def merge_reduce_bank(spark: SparkSession, sf: str) -> DataFrame:
    _, b = vectors(spark, sf)
    return selection.merge_reduce(b, 20, 4)


@query(
    "attention_signature",
    """with w as (select user_id src, hour(ts) dst, max(value) v, abs(hour(ts) - 12)::double d from events group by all),
n as (select src, v / sum(v) over p w, d, max(d) over p far, count(*) over p n, row_number() over (partition by src order by v desc, dst) - 1 as r from w window p as (partition by src)),
b as (select *, least(floor(coalesce(d / nullif(far, 0), 0) * 5), 4) rad, least(floor(r * 5 / n), 4) rk from n)
select src, """
    + ", ".join(f"round(coalesce(sum(w) filter (rad = {i}), 0), 6) radial_{i}" for i in range(5))
    + ", "
    + ", ".join(f"round(coalesce(sum(w) filter (rk = {i}), 0), 6) rank_{i}" for i in range(5))
    + ", round(-sum(case when w > 0 then w * ln(w) else 0 end), 6) entropy from b group by all",
)
def attention_signature(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("src"), F.hour("ts").alias("target")).agg(F.max("value").alias("weight")).withColumn("distance", F.abs(F.col("target") - 12).cast("double"))
    got = relation.signature(e, ["src"])
    return got.select("src", *(r6(c).alias(c) for c in got.columns[1:]))


@query(
    "trajectory_norm",
    """with m as (select user_id k, event_type dim, quantile_cont(value, 0.5) med from events group by all), s as (select dim, quantile_cont(med, 0.25) q1, quantile_cont(med, 0.5) q2, quantile_cont(med, 0.75) q3 from m group by all),
z as (select k, dim, greatest(least((med - q2) / greatest(q3 - q1, 1e-6), 5), -5) z from m join s using (dim)) select k, dim, round(z / greatest(sqrt(sum(z * z) over (partition by k)), 1e-12), 6) as value from z""",
)
def trajectory_norm(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("dim"), "value")
    return relation.normalized_trajectory(e, ["k"], "dim", "value").withColumn("value", r6("value"))


@query("cluster_agreement", "select round(avg((c_nationkey % 3 = c_custkey % 3)::int), 6) agreement from customer")
def cluster_agreement(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    a, b = c.select("c_custkey", (F.col("c_nationkey") % 3).cast("long").alias("g")), c.select("c_custkey", (F.col("c_custkey") % 3).alias("g"))
    return relation.agreement(a, b, "c_custkey", "g").withColumn("agreement", r6("agreement"))


@query(
    "manifest_digest",
    """with h as (select lang, sha256(doc_id || '|' || source) h from documents), p as (select lang, h[1:2] p, count(*) n, sha256(string_agg(h, chr(10) order by h)) d from h group by all)
select lang, sum(n)::bigint n, sha256(string_agg(d, chr(10) order by p, d)) digest from p group by all""",
)
def manifest_digest(spark: SparkSession, sf: str) -> DataFrame:
    return hashing.set_digest(table(spark, sf, "documents"), ["lang"], F.concat_ws("|", F.col("doc_id").cast("string"), "source"))


@query("stable_seeds")
def stable_seeds(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select("page_id", hashing.stable_seed("broad", hashing.forward_slashes(F.col("url")), 42).alias("seed"), hashing.blake2b_u64(F.col("url")).alias("little"), hashing.blake2b_u64(F.col("url"), "big").alias("big"))


@query("disjoint_check", "with r as (select case when doc_id % 3 = 0 then 'fit' else 'memory' end as role, text from documents) select sha256(text) text_sha256, count(distinct role) roles, count(*) n from r group by text having count(distinct role) > 1 or count(*) > 1")
def disjoint_check(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 3 == 0, "fit").otherwise("memory").alias("role"), F.sha2("text", 256).alias("text_sha256"))
    return reports.disjoint(d, "role", "text_sha256")


@query(
    "exact_row_match",
    """with d as (select doc_id, sha256(text) h from documents), a as (select doc_id, h, row_number() over (partition by h order by doc_id) i from d where doc_id % 3 = 0), b as (select doc_id candidate, h, row_number() over (partition by h order by doc_id) i from d where doc_id % 3 <> 0)
select doc_id, candidate from a left join b using (h, i)""",
)
def exact_row_match(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return reports.match_rows(d.filter("doc_id % 3 = 0"), d.filter("doc_id % 3 <> 0"), "h", "doc_id")


@query("expected_keys", "select coalesce(o_custkey, c_custkey) as \"key\", case when o_custkey is null then 'missing' when c_custkey is null then 'unexpected' else 'repeated' end problem from (select o_custkey, count(*) n from orders group by all) full join (select c_custkey from customer) on o_custkey = c_custkey where o_custkey is null or c_custkey is null or n > 1")
def expected_keys(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))
    return reports.expected_keys(o, table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), ["key"])


@query("role_union", "select role, count(*) n, count(distinct path) paths, count_if(mask is null) without_mask from (select 'train' as role, c_name path, null mask from customer union all select 'evaluation', s_name, s_nationkey::varchar from supplier) group by all")
def role_union(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.lit("train").alias("role"), F.col("c_name").alias("path"))
    s = table(spark, sf, "supplier").select(F.lit("evaluation").alias("role"), F.col("s_name").alias("path"), F.col("s_nationkey").cast("string").alias("mask"))
    return reports.union_reports(s, c).groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"), F.count_if(F.col("mask").isNull()).alias("without_mask"))


@query("path_fields", "select page_id, regexp_extract(url, '^https?://([^/]+)', 1) host, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) stem, not regexp_matches(url, '^/|^[A-Za-z]:|(^|/)\\.\\.(/|$)') and url <> '' safe from pages")
def path_fields(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1).alias("stem"), hashing.safe_relative(F.col("url")).alias("safe"))
