"""Exact nearest neighbours of a stated query set against a bank of any size.

Queries are taken in blocks of bounded size to the tasks that hold the bank; each task keeps a running top k for the
block while it streams its share of the bank, so a task sends k rows a query and memory is a block's. The partial
results meet in a grouped top k. The bank is never collected and no cross join is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and bank rows that are compared at a time.
QUERIES, ROWS = 4096, 8192


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _distances(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        return 1 - unit(q) @ unit(b).T
    d = np.maximum((q * q).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (q @ b.T), 0)
    return d if metric == "squared" else np.sqrt(d)


def nearest(queries: DataFrame, bank: DataFrame, k: int = 1, metric: str = "l2", by: str | None = None, block: int = QUERIES) -> DataFrame:
    """(query_id, [by,] rank, bank_id, distance): the k nearest bank rows, ties to the smaller id.

    ``queries`` and ``bank`` are (id, vec); ``by`` names a bank column whose values are banks of their own. Metrics:
    l2, squared, cosine (1 - cosine). Null vectors are left out. Query blocks of ``block`` rows are bounded by that.
    """
    q = queries.filter("vec is not null")
    n = q.count()
    blocks = max(1, -(-n // block))
    kind = dict(bank.dtypes).get(by, "string") if by else "string"
    rows = bank.filter("vec is not null").select(F.col(by).cast("string").alias("g") if by else F.lit("").alias("g"), "id", "vec")
    out = None
    for i in range(blocks):
        part = q.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).select("id", "vec").orderBy("id").toArrow().combine_chunks()
        if not part.num_rows:
            continue
        ids = part.column(0).to_numpy()
        mat = _matrix(part.column(1).combine_chunks() if isinstance(part.column(1), pa.ChunkedArray) else part.column(1))

        def run(batches: Iterator[pa.RecordBatch], ids=ids, mat=mat) -> Iterator[pa.RecordBatch]:
            best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for s in range(0, batch.num_rows, ROWS):
                    b = batch.slice(s, ROWS)
                    group = np.array(b.column(0).to_pylist(), object)
                    bank_ids, vec = b.column(1).to_numpy(), _matrix(b.column(2))
                    for g in dict.fromkeys(group.tolist()):
                        own = group == g
                        d, at = _distances(mat, vec[own], metric), np.broadcast_to(bank_ids[own], (len(mat), int(own.sum())))
                        if g in best:
                            d, at = np.concatenate([best[g][0], d], 1), np.concatenate([best[g][1], at], 1)
                        order = np.lexsort((at, d), axis=1)[:, :k]
                        best[g] = np.take_along_axis(d, order, 1), np.take_along_axis(at, order, 1)
            for g, (d, at) in best.items():
                m = d.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array([g] * d.size, pa.string()), pa.array(at.ravel()), pa.array(d.ravel())], names=["query_id", "g", "bank_id", "distance"])

        one = rows.mapInArrow(run, "query_id long, g string, bank_id long, distance double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = queries.sparkSession.createDataFrame([], "query_id long, g string, bank_id long, distance double")
    w = Window.partitionBy("query_id", "g").orderBy("distance", "bank_id")
    top = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.select("query_id", *([F.col("g").cast(kind).alias(by)] if by else []), "rank", "bank_id", "distance")


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, label, votes): the neighbours' most frequent label, ties to the smaller one; labels is (id, label)."""
    n = neighbours.join(labels.withColumnRenamed("id", "bank_id"), "bank_id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    w = Window.partitionBy("query_id").orderBy(F.desc("votes"), "label")
    return n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def resolve_anchor(neighbours: DataFrame) -> DataFrame:
    """The label of four layers' nearest neighbours (query_id, layer, label, cost).

    Three or more agreeing layers decide; so does a single agreeing pair; of two pairs that with the smaller mean cost;
    otherwise -1.
    """
    votes = neighbours.groupBy("query_id", "label").agg(F.count("*").alias("votes"), F.avg("cost").alias("cost")).withColumn("pairs", F.sum((F.col("votes") == 2).cast("int")).over(Window.partitionBy("query_id")))
    w = Window.partitionBy("query_id").orderBy(F.desc("votes"), "cost", "label")
    top = votes.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return top.select("query_id", F.when(F.col("votes") >= 2, F.col("label")).otherwise(-1).cast("int").alias("label"))


def dense(neighbours: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbours scattered to a full grid: cells that weren't queried have distance 0 and neighbour -1."""
    return grid.join(neighbours, keys, "left").withColumns({"distance": F.coalesce("distance", F.lit(0.0)), "bank_id": F.coalesce("bank_id", F.lit(-1))})
