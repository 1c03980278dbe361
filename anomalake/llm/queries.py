"""The contract's queries: each takes its rows through its operator and adds nothing but digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomalake.llm import bpe, decontaminate, html, langid, media, minhash, pii, suffix, toxicity, warc
from anomalake.llm.store import Workspace, read_documents

#: The public vocabulary file of the contract's encoding; a parameter of every operator that uses one.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = media.write(read_documents(spark, sf_dir), Workspace(spark, "media"))
    got = media.read(spark, manifest)
    sound = F.when(F.col("error").isNull(), F.col("payload")).otherwise(F.raise_error(F.concat_ws(": ", "archive", "error")).cast("binary"))
    return got.withColumn("payload", sound).select(
        F.nullif("key", F.lit("")).cast("long").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"), tolerance=0.2)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.duplicates(read_documents(spark, sf_dir), Workspace(spark, "minhash"), size=4, percent=80)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_documents(spark, sf_dir), VOCABULARY)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_documents(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(read_documents(spark, sf_dir, "pages"), Workspace(spark, "warc"))
    kind = F.when(F.col("kind") == "record", F.col("record_type")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("gap in"), "path", "begin", "reason")))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read_documents(spark, sf_dir).select("doc_id", "text"), pii.fit(spark))

    def of(k: int):
        return lambda x: x["kind"] == k

    count = [F.size(F.filter("pii.base", of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.BASE)]
    return found.select("doc_id", *count, F.sha2(pii.listed(F.col("pii.base")), 256).alias("base_sha256"), pii.listed(F.col("pii.spans")).alias("spans"))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix.deduplicate(read_documents(spark, sf_dir), Workspace(spark, "suffix"), length=200)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_documents(spark, sf_dir), read_documents(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~langid.held_out("doc_id", 4, 2)))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", langid.held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~langid.held_out("doc_id", 5, 0)))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 reads back, without the columns that depend on the stored form."""
    return op1_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_media": op1_media, "op2_decontaminate": op2_decontaminate, "op3_minhash": op3_minhash, "op4_bpe": op4_bpe, "op5_html": op5_html, "op6_warc": op6_warc, "op7_pii": op7_pii, "op8_suffix": op8_suffix, "op9_toxicity": op9_toxicity, "op10_langid": op10_langid, "media_payloads": media_payloads}
#: Words' shingles are joined by the blank that no word holds; groups by reachability over linked pairs.
_OP3 = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) s from w),
e as materialized (select doc_id, len(s) n, hash(unnest(s)) g from s),
n as (select doc_id, len(s) n from s),
c as (select a.doc_id a, b.doc_id b, count(*) k, any_value(a.n) x, any_value(b.n) y from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c where 100 * k >= 80 * (x + y - k) union all select b, a from c where 100 * k >= 80 * (x + y - k)),
r as (select doc_id a, doc_id b from n union select r.a, l.b from r join l on r.b = l.a)
select doc_id, any_value(n)::bigint n_shingles, min(b) component_id, doc_id = min(b) kept from n join r on doc_id = a group by doc_id"""
#: Bytes as two hexadecimal digits each; starts of repeated strings make runs where they overlap or touch.
_OP8 = """with t as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
s as (select doc_id, unnest(range(0, length(x) // 2 - 199)) i, x from t),
h as materialized (select doc_id, i, md5(substr(x, 2 * i + 1, 400)) h from s),
f as (select doc_id, i from (select doc_id, i, count(*) over (partition by h) n from h) where n > 1),
g as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end b from f),
u as (select doc_id, i, sum(b) over (partition by doc_id order by i) r from g),
v as (select doc_id, r, min(i) a, max(i) + 200 z from u group by 1, 2),
o as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) p from v),
k as (select o.doc_id, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' order by a) y, max(z) z, sum(z - a) m, count(*) c, any_value(x) x from o join t using (doc_id) group by 1)
select t.doc_id, (length(t.x) // 2)::bigint n_bytes, coalesce(m, 0)::bigint n_removed, coalesce(c, 0)::bigint n_spans, sha256(unhex(case when k.doc_id is null then t.x else y || substr(k.x, 2 * z + 1) end)) kept_sha256 from t left join k on t.doc_id = k.doc_id"""
_PAYLOADS = """with t as (select doc_id, hex(encode(coalesce(text, ''))) x from documents), n as (select doc_id, x, (length(x) // 2)::bigint n from t),
p as (select doc_id, x, n, (greatest(1, (n + 191) // 192) * 192)::bigint m from n)
select doc_id, n n_bytes, m payload_bytes, sha256(unhex(x || repeat('20', (m - n)::int))) payload_sha256 from p"""
#: Base32 in SQL: five hexadecimal digits of the SHA-1 make four letters.
ORACLE: dict[str, str] = {
    "media_payloads": _PAYLOADS,
    "op3_minhash": _OP3,
    "op8_suffix": _OP8,
    "op6_warc": """with p as (select page_id, sha1(coalesce(html, '')) h, octet_length(encode(coalesce(html, ''))) n from pages),
d as (select *, min(page_id) over (partition by h) f, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (((('0x' || substr(h, (5 * (i // 4) + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))) & 31)))::int, 1)) c from p)
select page_id, n::bigint payload_bytes, array_to_string(c, '') payload_digest, case when page_id = f then 'response' else 'revisit' end record_type, case when page_id <> f then f end refers_to from d""",
}
