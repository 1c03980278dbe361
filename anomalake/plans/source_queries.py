"""Registered queries: image-set layouts written from the tables and scanned back, sinks, markers, saved predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anomalake.operators import reports
from anomalake.plans.tables import table
from anomalake.sources import predictions, records, scratch, sinks

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """(k, n, m): a key, a number for its category, and its part of the layout: 0 and 1 train, 2 normal, 3 and 4 anomalous."""
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 5).alias("m"))


S = "s as (select s_suppkey k, s_nationkey n, s_suppkey % 5 m from supplier)"


def _name(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _written(spark: SparkSession, name: str, *files: DataFrame) -> str:
    root = scratch.folder(spark, name)
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    scratch.write_files(out, root)
    return root


def _told(found: DataFrame, root: str) -> DataFrame:
    """The records with paths below the root."""
    base = root.rsplit("/", 1)[-1] + "/"
    return found.withColumns({c: F.substring_index(c, base, -1) for c in ("path", "mask_path")})


def _folder_root(spark: SparkSession, sf: str) -> str:
    s = _suppliers(spark, sf).withColumns({"c": _name("c", F.col("n") % 3), "kind": F.when(F.col("m") <= 2, "good").when(F.col("m") == 3, "dent").otherwise("hole")})
    images = s.select(_name(F.col("c"), F.when(F.col("m") <= 1, "/train/").otherwise("/test/"), F.col("kind"), "/", F.col("k"), ".png").alias("rel"), F.lit("image").alias("content"))
    masks = s.filter("m >= 3 and k % 20 <> 19").select(_name(F.col("c"), "/ground_truth/", F.col("kind"), "/", F.col("k"), "_mask.png").alias("rel"), F.lit("image").alias("content"))
    return _written(spark, "folders", images, masks)


FOLDER = f"""with {S}, f as (select *, 'c' || (n % 3) c, case when m <= 2 then 'good' when m = 3 then 'dent' else 'hole' end kind from s),
r as (select c || (case when m <= 1 then '/train/' else '/test/' end) || kind || '/' || k || '.png' path, (m >= 3)::int as label, case when m >= 3 and k % 20 <> 19 then c || '/ground_truth/' || kind || '/' || k || '_mask.png' end mask_path,
  c category, case when m <= 1 then 'train' else 'evaluation' end as role, case when m <= 1 then 'not_evaluation' else 'pixel' end mask_capability from f)"""
SHOWN = ("path", "label", "mask_path", "category", "role", "mask_capability")


@query("scan_folders", FOLDER + " select * from r")
def scan_folders(spark: SparkSession, sf: str) -> DataFrame:
    root = _folder_root(spark, sf)
    return _told(records.folder_records(spark, root), root).select(*SHOWN)


@query("scan_files", FOLDER + " select path from r union all select mask_path from r where mask_path is not null")
def scan_files(spark: SparkSession, sf: str) -> DataFrame:
    return records.files(spark, _folder_root(spark, sf)).select(F.col("rel").alias("path"))


@query(
    "scan_pairs",
    f"""with {S}, f as (select *, '0' || (1 + n % 3) c from s)
select c || (case when m <= 1 then '/train/ok/' when m = 2 then '/test/ok/' else '/test/ko/' end) || 'Img' || k || '.png' path, (m >= 3)::int as label, case when m >= 3 then c || '/ground_truth/ko/IMG' || k || '.png' end mask_path,
  c category, case when m <= 1 then 'train' else 'evaluation' end as role, case when m <= 1 then 'not_evaluation' else 'pixel' end mask_capability from f""",
)
def scan_pairs(spark: SparkSession, sf: str) -> DataFrame:
    s = _suppliers(spark, sf).withColumn("c", _name("0", 1 + F.col("n") % 3))
    part = F.when(F.col("m") <= 1, "/train/ok/Img").when(F.col("m") == 2, "/test/ok/Img").otherwise("/test/ko/Img")
    images = s.select(_name(F.col("c"), part, F.col("k"), ".png").alias("rel"), F.lit("image").alias("content"))
    masks = s.filter("m >= 3").select(_name(F.col("c"), "/ground_truth/ko/IMG", F.col("k"), ".png").alias("rel"), F.lit("image").alias("content"))
    root = _written(spark, "pairs", images, masks)
    return _told(records.paired_records(spark, root)[0], root).select(*SHOWN)


def _metadata_root(spark: SparkSession, sf: str) -> str:
    s = _suppliers(spark, sf)
    line = F.to_json(F.struct(_name(F.col("k"), ".png").alias("file_name"), F.when(F.col("m") <= 2, "normal").otherwise("anomaly").alias("label"), F.when(F.expr("m >= 3 and k % 20 <> 19"), _name("masks/", F.col("k"), ".png")).alias("mask")))
    rel = _name("c", F.col("n") % 2, "/d", F.col("k") % 2, "/s", F.col("n") % 3, F.when(F.col("m") <= 1, "/train").otherwise("/test"), "/metadata.jsonl")
    return _written(spark, "metadata", s.groupBy(rel.alias("rel")).agg(F.array_join(F.collect_list(line), "\n").alias("content")))


METADATA = f"""with {S}, f as (select *, 'c' || (n % 2) category, 'd' || (k % 2) as domain, 's' || (n % 3) shift, case when m <= 1 then 'train' else 'test' end part, (m >= 3)::int as label, case when m >= 3 and k % 20 <> 19 then 'masks/' || k || '.png' end mask from s),
g as (select *, category || '/' || domain || '/' || shift || '/' || part || '/' dir, min(case when label = 1 and mask is null then 0 else 1 end) over (partition by category, domain, shift) whole from f),
r as (select dir || k || '.png' path, label, dir || mask mask_path, category, domain, shift, case when part = 'train' then 'train' else 'evaluation' end as role, case when part = 'train' then 'not_evaluation' when whole = 1 then 'pixel' else 'image_only' end mask_capability from g)"""


@query("scan_metadata", METADATA + " select * from r")
def scan_metadata(spark: SparkSession, sf: str) -> DataFrame:
    root = _metadata_root(spark, sf)
    return _told(records.metadata_records(spark, root), root).select("path", "label", "mask_path", "category", "domain", "shift", "role", "mask_capability")


@query("group_audit", METADATA + " select 'robust' dataset, category, domain, shift, count_if(role = 'train') train, count_if(role <> 'train' and label = 0) as normal, count_if(role <> 'train' and label = 1) anomalous, count_if(role <> 'train' and label = 1 and mask_path is null) missing_masks from r group by all")
def group_audit(spark: SparkSession, sf: str) -> DataFrame:
    return records.group_audit(records.metadata_records(spark, _metadata_root(spark, sf)))


@query("group_check", METADATA + ", h as (select domain, shift, count(distinct label) n from r where role = 'evaluation' group by all), e as (select 'd' || i domain, 's' || j shift from range(3) a(i), range(3) b(j)) select domain, shift, case when n is null then 'missing' when e is null then 'unexpected' else 'one label' end problem from h full join (select *, 1 e from e) using (domain, shift) where n is null or e is null or n < 2")
def group_check(spark: SparkSession, sf: str) -> DataFrame:
    expected = spark.range(9).select(_name("d", (F.col("id") / 3).cast("int")).alias("domain"), _name("s", F.col("id") % 3).alias("shift"))
    return records.check_groups(records.metadata_records(spark, _metadata_root(spark, sf)), expected)


@query(
    "scan_csv",
    f"""with {S} select 'c' || (n % 3) || '/Images/' || k || '.JPG' path, (m >= 3)::int as label, case when m >= 3 then 'c' || (n % 3) || '/Masks/' || k || '.png' end mask_path, 'c' || (n % 3) category,
  case when m <= 1 then 'train' else 'evaluation' end as role, case when m <= 1 then 'not_evaluation' else 'pixel' end mask_capability from s""",
)
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    s, c = _suppliers(spark, sf), _name("c", F.col("n") % 3)
    line = F.concat_ws(",", c, F.when(F.col("m") <= 1, "train").otherwise("test"), F.when(F.col("m") <= 2, "normal").otherwise("anomaly"), _name(c, "/Images/", F.col("k"), ".JPG"), F.when(F.col("m") >= 3, _name(c, "/Masks/", F.col("k"), ".png")).otherwise(""))
    root = _written(spark, "split", s.groupBy(F.lit("split_csv/1cls.csv").alias("rel")).agg(F.concat(F.lit("object,split,label,image,mask\n"), F.array_join(F.collect_list(line), "\n")).alias("content")))  # a set's one split file
    return _told(records.csv_records(spark, root), root).select(*SHOWN)


@query(
    "scan_variants",
    f"""with {S}, f as (select *, 'v' || (n % 4) c, k || (case k % 3 when 0 then '' when 1 then '_overexposed' else '_shift_1' end) stem from s)
select c || (case m when 0 then '/train/good/' when 1 then '/validation/good/' when 2 then '/test_public/good/' else '/test_public/bad/' end) || stem || '.png' path, (m >= 3)::int as label, case when m >= 3 then c || '/test_public/ground_truth/bad/' || stem || '_mask.png' end mask_path,
  c category, case k % 3 when 0 then 'regular' when 1 then 'overexposed' else 'shift_1' end shift, case m when 0 then 'train' when 1 then 'validation' else 'evaluation' end as role from f""",
)
def scan_variants(spark: SparkSession, sf: str) -> DataFrame:
    s = _suppliers(spark, sf).withColumns({"c": _name("v", F.col("n") % 4), "stem": _name(F.col("k"), F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, "_overexposed").otherwise("_shift_1"))})
    part = F.when(F.col("m") == 0, "/train/good/").when(F.col("m") == 1, "/validation/good/").when(F.col("m") == 2, "/test_public/good/").otherwise("/test_public/bad/")
    images = s.select(_name(F.col("c"), part, F.col("stem"), ".png").alias("rel"), F.lit("image").alias("content"))
    masks = s.filter("m >= 3").select(_name(F.col("c"), "/test_public/ground_truth/bad/", F.col("stem"), "_mask.png").alias("rel"), F.lit("image").alias("content"))
    root = _written(spark, "variants", images, masks)
    return _told(records.variant_records(spark, root), root).select("path", "label", "mask_path", "category", "shift", "role")


@query("report_round_trip", "select 'supplier' as method, s_nationkey::varchar category, count(*)::varchar n, null as top from supplier group by s_nationkey union all select 'customer', c_nationkey::varchar, count(*)::varchar, max(c_custkey)::varchar from customer group by c_nationkey")
def report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("category")).agg(F.count("*").alias("n")).withColumn("method", F.lit("supplier"))
    b = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("category")).agg(F.count("*").alias("n"), F.max("c_custkey").alias("top")).withColumn("method", F.lit("customer"))
    both, path = reports.union_reports(a, b).select("method", "category", "n", "top"), scratch.folder(spark, "report")
    sinks.write_csv(both, path)
    return sinks.read_csv(spark, path, "method string, category string, n string, top string")


@query("json_round_trip", "select s_suppkey k, case when s_suppkey % 3 <> 0 then s_acctbal end balance from supplier")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.when(F.col("s_suppkey") % 3 == 0, F.when(F.col("s_suppkey") % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(F.col("s_acctbal"))
    path = scratch.folder(spark, "json")
    sinks.write_json(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), odd.alias("balance")), path)
    return spark.read.schema("k bigint, balance double").json(path)


@query("bank_round_trip", "select 'c' || label as category, vec_id % 4 as layer, count(*) n, round(sum(list_sum(embedding::double[])), 3) total from embeddings group by all")
def bank_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(_name("c", F.col("label")).alias("category"), (F.col("vec_id") % 4).alias("layer"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    path = scratch.folder(spark, "bank")
    sinks.write_bank(e, path)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return sinks.read_bank(spark, path, 64).groupBy("category", F.col("layer").cast("long").alias("layer")).agg(F.count("*").alias("n"), F.round(F.sum(total), 3).alias("total"))


@query("stage_marker", "select * from (values ('new', true), ('completed before', false), ('completed after', true), ('again', false), ('other identity', false)) t(step, answer)")
def stage_marker(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "region").count()
    path, identity = scratch.folder(spark, "stage"), {"stage": "fit", "rows": n}
    one = sinks.Stage(spark, path, identity)
    said = [("new", one.start()), ("completed before", one.completed())]
    one.finish(seconds=1.5)
    said += [("completed after", one.completed()), ("again", sinks.Stage(spark, path, identity).start(skip=True)), ("other identity", sinks.Stage(spark, path, identity | {"rows": -1}).completed())]
    return spark.createDataFrame(said, "step string, answer boolean")


def _saved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    saved = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 7).alias("h"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("v"))
    return saved, table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 7).alias("h"))


SAVED = "s as (select o_custkey k, count(*) n, max(o_orderkey % 7) h, count_if(o_orderkey % 5 = 0) bad from orders group by o_custkey), t as (select c_custkey k, c_custkey % 7 h from customer)"


@query("saved_predictions", f"with {SAVED}, j as (select coalesce(s.k, t.k) k, case when n is null then 'no prediction' when t.k is null then 'no truth' when n > 1 then 'repeated' when s.h <> t.h then 'shape' when bad > 0 then 'not finite' end problem from s full join t on s.k = t.k) select * from j where problem is not null")
def saved_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return predictions.audit(*_saved(spark, sf), ["k"], ["h"], "v")


@query("cache_lookup", f"with {SAVED} select t.k, t.h, case when n is null then 'miss' when n = 1 and bad = 0 and s.h = t.h then 'hit' else 'stale' end cached from t left join s on s.k = t.k")
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    saved, wanted = _saved(spark, sf)
    return predictions.lookup(wanted, saved, ["k"], ["h"], "v")


@query("path_index", "select user_id, min('raw/' || event_id || '.bin') path, count(*) copies from events where event_type <> 'error' group by all")
def path_index(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", _name("raw/", F.col("event_id"), ".bin").alias("path"), (F.col("event_type") != "error").alias("ok"))
    return predictions.index(e, "user_id", "path", "ok")


@query("method_rows", "select event_type as method, user_id % 5 category, round(sum(value), 2) total from events where event_type = 'click' group by all")
def method_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "events").groupBy(F.col("event_type").alias("method"), (F.col("user_id") % 5).alias("category")).agg(F.round(F.sum("value"), 2).alias("total"))
    return predictions.method_rows(r, "click", r.select("category"))


@query(
    "manifest_problems",
    """with r as (select 'c' || (page_id % 3) category, 'memory' split, url image, page_id % 40 x, page_id % 33 y, page_id % 10 t, page_id % 4 seed, case when page_id % 7 = 0 then 'v0' else 'v1' end v, page_id % 6 as want, length(html) n, page_id from pages),
p as (select *, case when page_id % 11 = 0 then 'x' else concat_ws('/', category, split, image, x, y) end physical_id from r),
e as (select physical_id, unnest([case when page_id % 11 = 0 then 'identity' end, case when t > 8 then 'transform' end, case when x > 31 or y > 31 then 'place' end, case when v <> 'v1' then 'version' end, case when category <> 'c1' then 'category' end, case when seed <> 2 then 'seed' end, case when t <> want then 'assignment' end, case when image not in (select image from r where n > 2000) then 'image' end]) problem from p)
select * from e where problem is not null union all select physical_id, 'repeated' from p group by physical_id having count(*) > 1 union all select null, 'too many' from p having count(*) > 10""",
)
def manifest_problems(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    r = table(spark, sf, "pages").select(_name("c", i % 3).alias("category"), F.lit("memory").alias("split"), F.col("url").alias("image"), (i % 40).alias("x"), (i % 33).alias("y"), (i % 10).alias("transform_id"), (i % 4).alias("seed"), F.when(i % 7 == 0, "v0").otherwise("v1").alias("version"), (i % 6).alias("want"), F.char_length("html").alias("n"), "page_id")
    own = F.concat_ws("/", "category", "split", "image", F.col("x").cast("string"), F.col("y").cast("string"))
    r = r.withColumn("physical_id", F.when(i % 11 == 0, "x").otherwise(own))
    return predictions.manifest_problems(r, 32, 9, "v1", 10, category="c1", split="memory", seed=2, images=r.filter("n > 2000"), transform=F.col("want"))
