"""Splits, quotas and the selection of reference banks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The named banks, (strategy, rows) with no bound as None.
PRESETS = {
    "full_train": ("full", None),
    "random_5k": ("random", 5_000),
    "random_10k": ("random", 10_000),
    "random_30k": ("random", 30_000),
    "kcenter_5k": ("kcenter", 5_000),
    "kcenter_10k": ("kcenter", 10_000),
    "kcenter_30k": ("kcenter", 30_000),
    "merge_reduce_30k": ("merge_reduce", 30_000),
    "image_balanced_30k": ("image_balanced", 30_000),
}


def order_key(*parts: Column | str, seed: int = 42) -> Column:
    """A pseudo-random order of rows that any engine can compute: md5 of seed|parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)).cast("binary"))


def modulus_split(df: DataFrame, by: list[str], order: list[str], modulus: int = 8) -> DataFrame:
    """Adds split: every modulus-th row of a group, in order, is calibration and the others memory."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("split", F.when((F.row_number().over(w) - 1) % modulus == 0, "calibration").otherwise("memory"))


def three_way_split(df: DataFrame, key: str, calibration: float = 0.2, fit: float = 0.3, seed: int = 42, fit_seed: int = 43) -> DataFrame:
    """Adds split: a random share for calibration, a share of the rest (by another order) to fit on, the rest for memory."""
    n = df.count()
    k = round(n * calibration)
    m = round((n - k) * fit)
    a = df.withColumn("_r", F.row_number().over(Window.orderBy(order_key(key, seed=seed), key)))
    b = a.withColumn("_s", F.when(F.col("_r") > k, F.row_number().over(Window.partitionBy(F.col("_r") > k).orderBy(order_key(key, seed=fit_seed), key))))
    return b.withColumn("split", F.when(F.col("_r") <= k, "calibration").when(F.col("_s") <= m, "fit").otherwise("memory")).drop("_r", "_s")


def cap_per_group(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first rows of each group: a feature of audits, not a way around skew; Spark prunes groups while it sorts."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def random_bank(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """A bank of ``size`` rows in hash order: the sampling operator."""
    return df.orderBy(order_key(key, seed=seed), key).limit(size)


def round_robin_quota(counts: DataFrame, group: str, total: int) -> DataFrame:
    """(group, n, quota): quotas as equal as the groups' sizes allow, spare rows to the smaller group keys first.

    ``counts`` is (group, n), a row a group. The water level is the largest L with sum(min(n, L)) <= total.
    """
    c = counts.select(group, F.col("n").cast("long").alias("n"))
    w = Window.orderBy("n", group)
    s = c.withColumn("_below", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_left", F.count("*").over(w.rowsBetween(0, Window.unboundedFollowing)))
    # filled groups are those whose size is within the level that is left for them and all larger ones
    s = s.withColumn("_full", F.col("n") * F.col("_left") + F.col("_below") <= total)
    rest = s.agg(F.coalesce(F.sum(F.when(F.col("_full"), F.col("n"))), F.lit(0)).alias("_used"), F.count_if(~F.col("_full")).alias("_open"))
    level = s.join(F.broadcast(rest), F.lit(True)).withColumn("_level", F.when(F.col("_open") > 0, F.floor((total - F.col("_used")) / F.col("_open"))))
    level = level.withColumn("_spare", F.when(F.col("_open") > 0, total - F.col("_used") - F.col("_level") * F.col("_open")).otherwise(0))
    rank = F.row_number().over(Window.partitionBy("_full").orderBy(group))
    return level.select(group, "n", F.when(F.col("_full"), F.col("n")).otherwise(F.col("_level") + F.when(rank <= F.col("_spare"), 1).otherwise(0)).cast("long").alias("quota"))


def waterfill(counts: dict[int, int], total: int, minimum: int = 32) -> dict[int, int]:
    """Proportional whole budgets within each group's size: a floor first, then shares of what is left, by largest remainder.

    Floors that need more than the total are all 0. A total below 1 or above the groups' sizes is an error. Groups that reach their size leave the round and the rest is shared again; ties go to the larger size, then to
    the smaller key. A driver-side step over one number a group.
    """
    if not counts or min(counts.values()) < 0 or not 1 <= total <= sum(counts.values()) or minimum < 0:
        raise ValueError("budgets need groups, a floor that isn't negative, and a total between 1 and the groups' sizes")
    out = {g: min(n, minimum) for g, n in counts.items()}
    if sum(out.values()) > total:
        out = dict.fromkeys(counts, 0)
    left = total - sum(out.values())
    while left > 0:
        room = {g: counts[g] - out[g] for g in counts if counts[g] > out[g]}
        weight = sum(counts[g] for g in room)
        share = {g: min(room[g], left * counts[g] / weight) for g in room}
        whole = {g: int(share[g]) for g in room}
        if not any(whole.values()):
            for g in sorted(room, key=lambda g: (-(share[g] - whole[g]), -counts[g], g))[:left]:
                out[g] += 1
            break
        for g, v in whole.items():
            out[g] += v
        left -= sum(whole.values())
    return out


def kcenter(values: np.ndarray, k: int, first: int, masked: bool = True) -> list[int]:
    """Farthest-first selection on squared L2 from a given first row; ties to the smaller index.

    ``masked`` takes chosen rows out; without it exact ties choose the first row again, as the approximate greedy
    selection does.
    """
    values = np.asarray(values, np.float64)
    chosen = [first]
    near = ((values - values[first]) ** 2).sum(1)
    while len(chosen) < min(k, len(values)):
        if masked:
            near[chosen[-1]] = -1
        nxt = int(near.argmax())
        chosen.append(nxt)
        d = ((values - values[nxt]) ** 2).sum(1)
        near = np.where(near < 0, near, np.minimum(near, d)) if masked else np.minimum(near, d)
    return chosen


def kcenter_bank(df: DataFrame, quotas: DataFrame, group: str, seed: int = 42) -> DataFrame:
    """(group, id, place): a farthest-first bank of each group, started at its first row in hash order.

    A group is one task's work and has to fit its memory, as sequential selection needs; merge_reduce first cuts
    larger ones into blocks. ``quotas`` is (group, quota).
    """
    kind = dict(df.dtypes)[group]
    rows = df.join(quotas.select(group, "quota"), group).select(group, "id", "vec", "quota", order_key("id", seed=seed).alias("_o"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        k = int(pdf["quota"].iloc[0])
        if not k:
            return pd.DataFrame({group: [], "id": [], "place": []})
        pick = kcenter(np.stack(pdf["vec"].to_numpy()), k, int(np.argmin(pdf["_o"].rank(method="first").to_numpy())))
        return pd.DataFrame({group: pdf[group].iloc[0], "id": pdf["id"].to_numpy()[pick], "place": range(len(pick))})

    return rows.groupBy(group).applyInPandas(one, f"`{group}` {kind}, id long, place int")


def merge_reduce(df: DataFrame, k: int, blocks: int, oversample: int = 2, seed: int = 42) -> DataFrame:
    """(id, place): farthest-first on blocks, ``oversample`` * k rows in all, then on the rows they kept."""
    b = df.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)).cast("int"))
    each = -(-oversample * k // blocks)
    first = kcenter_bank(b, b.groupBy("block").agg(F.least(F.count("*"), F.lit(each)).alias("quota")), "block", seed)
    kept = df.join(first.select("id"), "id", "left_semi").withColumn("block", F.lit(0))
    return kcenter_bank(kept, kept.groupBy("block").agg(F.least(F.count("*"), F.lit(k)).alias("quota")), "block", seed).select("id", "place")


def stratified(df: DataFrame, cluster: str, budgets: dict[int, int], key: str, seed: int = 42) -> DataFrame:
    """The budgeted number of rows of each cluster, in hash order."""
    quota = F.create_map(*(x for g, n in budgets.items() for x in (F.lit(g), F.lit(n)))) if budgets else F.lit(None).cast("map<int,int>")
    w = Window.partitionBy(cluster).orderBy(order_key(key, seed=seed), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.coalesce(F.element_at(quota, F.col(cluster)), F.lit(0))).drop("_r")
