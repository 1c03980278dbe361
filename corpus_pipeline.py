"""The corpus pipeline: five of the llm operators applied to documents one after another.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. Null ids and texts pass every stage: a null text is not toxic, has no shingles, holds no
benchmark item and no personal data, and encodes to no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anomalake.llm import bpe, decontaminate, langid, minhash, pii, toxicity
from anomalake.llm.queries import VOCABULARY
from anomalake.llm.store import Workspace, bounded_batches, read_documents

#: Score from which a document is rejected as toxic.
TOXIC = 0.3
#: Dropped ids up to which they are broadcast to the documents (8 bytes each); beyond, they are joined by shuffle.
BROADCAST_IDS = 2_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC by a model of the labelled rows that op9 learns from."""
    labels = read_documents(spark, sf_dir, "labels").filter(~langid.held_out("doc_id", 4, 2))
    scored = toxicity.score(docs, toxicity.fit(docs, labels), out="_toxicity")
    return scored.filter(F.col("_toxicity") < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: that with the smallest id, of an id's several texts the smallest.

    Rows that share an id and a text are one document, of which one row stays; rows without an id stay.
    """
    ws = Workspace(spark, "dedup")
    rows, key = docs, "doc_id"
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        rows, key = ws.table(number_rows(docs), "rows"), "_row"  # written once, so the numbers hold
    found = minhash.duplicates(rows, ws, size=5, percent=80, key=key)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    n = gone.count()
    return rows.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, key, "left_anti").select(*docs.columns)


def number_rows(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, _row, in the order of ids and texts; one row of those with equal ids and texts, and null numbers for null ids."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    known = docs.filter("doc_id is not null")
    if rest:
        known = known.groupBy("doc_id", "text").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("_rest")).select("doc_id", "text", "_rest.*")
    else:
        known = known.distinct()
    known = known.orderBy("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    return known.unionByName(docs.filter("doc_id is null").withColumn("_row", F.lit(None).cast("long")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edited or not."""
    return decontaminate.clean(docs, read_documents(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the new text."""
    out = pii.redact(docs, pii.fit(spark))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their text, their number, and the text that they decode to."""
    bounded_batches(spark)
    out = bpe.encode(docs, VOCABULARY, decoded="decoded")
    return out.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("encoding", encode),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    ws = Workspace(spark, "pipeline")
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
