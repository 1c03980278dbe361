"""Deterministic seeds, content hashes and identities of manifests."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_seed(tag: str, path: Column, seed: int) -> Column:
    """crc32 of ``seed|tag|path``."""
    return F.crc32(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), path).cast("binary"))


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def safe_relative(path: Column) -> Column:
    """Whether a path is relative and never leaves its root."""
    return ~path.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)") & (path != "")


def stable_u64(text: str, order: str = "little") -> int:
    """An 8-byte BLAKE2b digest as an unsigned integer, in either byte order."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), order)


def blake2b_u64(text: Column, order: str = "little") -> Column:
    """stable_u64 of each value as decimal(20,0); Spark has no BLAKE2b, so an Arrow function computes it."""
    digest = F.udf(lambda t: None if t is None else str(stable_u64(t, order)), "string", useArrow=True)
    return digest(text).cast("decimal(20,0)")


def json_safe(value):
    """NaN and infinities as null, at any depth; keys that begin with an underscore stay."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    return [json_safe(v) for v in value] if isinstance(value, (list, tuple)) else value


def without_runtime(value):
    """A configuration without the keys, at any depth, that begin with an underscore."""
    if isinstance(value, dict):
        return {k: without_runtime(v) for k, v in value.items() if not str(k).startswith("_")}
    return [without_runtime(v) for v in value] if isinstance(value, (list, tuple)) else value


def identity(value) -> str:
    """sha256 of the canonical JSON form."""
    return hashlib.sha256(json.dumps(json_safe(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def fingerprint(config: dict) -> str:
    return identity(without_runtime(config))


def set_digest(df: DataFrame, by: list[str], item: Column) -> DataFrame:
    """An order-independent digest of each group's items: sha256 of their sorted hashes, 16 partial lists at a time.

    Items are hashed first, sorted within 256 parts by their first byte, and the parts' digests are joined in order;
    a part is the only thing that has to fit in memory.
    """
    h = df.select(*by, F.sha2(item.cast("string").cast("binary"), 256).alias("_h")).withColumn("_p", F.substring("_h", 1, 2))
    part = h.groupBy(*by, "_p").agg(F.count("*").alias("_n"), F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), "\n"), 256).alias("_d"))
    return part.groupBy(*by).agg(F.sum("_n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_d"))), lambda x: x["_d"]), "\n"), 256).alias("digest"))
