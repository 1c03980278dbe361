"""Ranking metrics from one count per distinct score: AUROC, average precision, best F1, operating points."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """(by, score, p, n): positives and all rows of each distinct score; the only pass over the rows. -0.0 counts as 0.0."""
    s = F.col(score).cast("double") + F.lit(0.0)
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*by, s.alias("score"), F.col(label).cast("long").alias("_y"))
    return rows.groupBy(*by, "score").agg(F.sum("_y").alias("p"), F.count("*").alias("n"))


def auroc_ap(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """(by, n, positives, auroc, ap); both metrics are null where a class is missing. Ties count half, or as one step."""
    return from_histogram(histogram(df, by, label, score), by)


def running(rows: DataFrame, by: list[str], sums: dict[str, Column], then: list[Column] | None = None, parts: int = 64) -> DataFrame:
    """Adds sums that run from a group's highest score down (of equal ones in the order ``then``), in two levels.

    A group is cut into ``parts`` ranges of scores by approximate percentiles; each range is summed by itself, and the
    ranges' totals, a few rows a group, give what goes before it. No task has to take a whole group.
    """
    same = reduce(and_, (c >= 0 for c in sums.values()))  # reads the sums' columns, else Spark shuffles ``rows`` once more without them
    cut = rows.groupBy(*by).agg(F.percentile_approx(F.when(same, F.col("score")), F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(1000)).alias("_cut"))

    def with_group(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        keys = [*by, *more]
        if not keys:
            return left.crossJoin(F.broadcast(right))  # one row
        named = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        return left.join(named, same).drop(*(f"_k_{k}" for k in keys))

    ranged = with_group(rows, cut).withColumn("_part", F.size(F.filter("_cut", lambda x: x > F.col("score")))).drop("_cut")
    total = ranged.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_t_{k}") for k, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # ``parts`` rows a group
    total = total.select(*by, "_part", *(F.sum(f"_t_{k}").over(before).alias(f"_t_{k}") for k in sums))
    inside = Window.partitionBy(*by, "_part").orderBy(F.desc("score"), *(then or [])).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *(F.sum(c).over(inside).alias(k) for k, c in sums.items()))
    return with_group(local, total, "_part").withColumns({k: F.col(k) + F.coalesce(f"_t_{k}", F.lit(0)) for k in sums}).drop("_part", *(f"_t_{k}" for k in sums))


def from_histogram(h: DataFrame, by: list[str]) -> DataFrame:
    c = running(h, by, {"tp": F.col("p"), "m": F.col("n")})
    neg = F.col("n") - F.col("p")
    c = c.withColumn("above", F.col("m") - F.col("tp") - neg)  # negatives scored higher
    a = c.groupBy(*by).agg(
        F.sum("n").alias("n_"),
        F.sum("p").alias("pos"),
        F.sum((neg * (F.col("tp") - F.col("p")) + neg * F.col("p") / 2.0).cast("double")).alias("won"),
        F.sum(F.col("p").cast("double") * F.col("tp") / F.col("m")).alias("ap_"),
    )
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("n_"))
    return a.select(*by, F.col("n_").alias("n"), F.col("pos").alias("positives"), F.when(both, F.col("won") / (F.col("pos").cast("double") * (F.col("n_") - F.col("pos")))).alias("auroc"), F.when(both, F.col("ap_") / F.col("pos")).alias("ap"))


def quantile_thresholds(df: DataFrame, by: list[str], score: str, most: int) -> DataFrame:
    """(by, threshold): the distinct values of ``most`` evenly spaced linear quantiles."""
    q = F.array(*(F.lit(i / (most - 1)) for i in range(most)))
    return df.groupBy(*by).agg(F.percentile(score, q).alias("_t")).select(*by, F.explode(F.array_distinct("_t")).alias("threshold"))


def linear_thresholds(df: DataFrame, by: list[str], score: str, count: int = 200) -> DataFrame:
    """(by, i, threshold): ``count`` evenly spaced values from the largest score to the smallest."""
    ends = df.groupBy(*by).agg(F.max(score).cast("double").alias("_hi"), F.min(score).cast("double").alias("_lo"))
    return ends.select(*by, "_hi", "_lo", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i")).select(*by, "i", (F.col("_hi") - (F.col("_hi") - F.col("_lo")) * F.col("i") / (count - 1)).alias("threshold"))


def counts_at(h: DataFrame, thresholds: DataFrame, by: list[str], strict: bool = False) -> DataFrame:
    """(by, threshold, tp, fp, positives, negatives): rows scored at or above (or strictly above) each threshold.

    Thresholds and distinct scores meet in one sorted pass of running sums, not in a product.
    """
    t = thresholds.select(*by, F.col("threshold").alias("score"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("_t")).distinct()
    rows = h.select(*by, "score", "p", "n", F.lit(0).alias("_t")).unionByName(t)
    # a threshold comes before rows of its score when strict, else after them
    c = running(rows, by, {"tp": F.col("p"), "fp": F.col("n") - F.col("p")}, [F.desc("_t") if strict else F.asc("_t")]).filter("_t = 1")
    whole = h.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("negatives"))
    c = c.join(whole, by) if by else c.crossJoin(F.broadcast(whole))  # a row a group
    return c.select(*by, F.col("score").alias("threshold"), "tp", "fp", "positives", "negatives")


def best_f1(df: DataFrame, by: list[str], label: str, score: str, most: int = 512) -> DataFrame:
    """(by, f1, threshold): the largest F1 over ``most`` linear quantiles as thresholds, of equal ones the lowest threshold.

    Quantiles and counts come from the same running sums: of the distinct scores only those that a quantile lies at or
    between are kept, at most two a quantile. Rows without a label count for the quantiles alone; a null group has no row.
    """
    s = F.col(score).cast("double") + F.lit(0.0)
    rows = df.filter(F.col(score).isNotNull()).select(*by, s.alias("score"), F.col(label).cast("long").alias("_y"))
    for k in by:
        rows = rows.filter(F.col(k).isNotNull())
    h = rows.groupBy(*by, "score").agg(F.coalesce(F.sum("_y"), F.lit(0)).alias("p"), F.count("_y").alias("n"), F.count("*").alias("m"))
    c = running(h, by, {"tp": F.col("p"), "all": F.col("n"), "reached": F.col("m")})
    whole = h.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("n").alias("labelled"), F.sum("m").alias("_m"))
    c = c.join(F.broadcast(whole), by) if by else c.crossJoin(F.broadcast(whole))  # a row a group
    # a score's ranks from the smallest, and the quantiles (most - 1 steps over the ranks) whose ranks may be among them
    first, last, step = F.col("_m") - F.col("reached"), F.col("_m") - F.col("reached") + F.col("m") - 1, (F.col("_m") - 1) / (most - 1)
    c = c.filter("labelled > 0").withColumns({"_first": first, "_last": last})
    c = c.withColumns({"_from": F.when(F.col("_m") > 1, F.ceil((F.col("_first") - 1) / step) - 1).otherwise(0), "_to": F.when(F.col("_m") > 1, F.floor((F.col("_last") + 1) / step) + 1).otherwise(most - 1)})
    near = c.filter("_from <= _to").withColumn("_i", F.explode(F.sequence(F.greatest("_from", F.lit(0)), F.least("_to", F.lit(most - 1)))))
    q = F.array(*(F.lit(i / (most - 1)) for i in range(most)))
    near = near.withColumn("_at", F.element_at(q, (F.col("_i") + 1).cast("int")) * (F.col("_m") - 1))
    # the scores at the ranks below and above the quantile's place
    x = F.struct("score", "tp", "all")
    inside = lambda r: r.between(F.col("_first"), F.col("_last"))
    both = near.groupBy(*by, "_i", "_at", "positives").agg(F.max(F.when(inside(F.floor("_at")), x)).alias("lo"), F.max(F.when(inside(F.ceil("_at")), x)).alias("hi")).filter("lo is not null")
    part = F.col("_at") - F.floor("_at")
    between = F.when(F.col("lo.score") == F.col("hi.score"), F.col("lo.score")).otherwise((1 - part) * F.col("lo.score") + part * F.col("hi.score"))
    t = both.withColumn("threshold", between).withColumn("x", F.when(F.col("threshold") <= F.col("lo.score"), F.col("lo")).otherwise(F.col("hi")))
    t = t.withColumn("f1", F.try_divide(2.0 * F.col("x.tp"), (F.col("x.all") + F.col("positives")).cast("double")))
    w = Window.partitionBy(*by).orderBy(F.desc("f1"), "threshold")  # ``most`` rows a group
    return t.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*by, "f1", "threshold")


def fixed_fpr(df: DataFrame, by: list[str], label: str, score: str, caps: list[float]) -> DataFrame:
    """(by, cap, boundary, fp, tp, positives, negatives, actual_fpr, recall): predictions are scores above the boundary.

    The boundary is the (floor(cap * negatives) + 1)-th largest negative score, so its whole tie group stays out and
    the actual rate never exceeds the cap.
    """
    h = histogram(df, by, label, score)
    whole = h.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("negatives"))
    c = running(h, by, {"tp": F.col("p"), "fp": F.col("n") - F.col("p")})
    c = c.join(whole, by) if by else c.crossJoin(F.broadcast(whole))  # a row a group
    c = c.withColumn("cap", F.explode(F.array(*map(F.lit, caps)))).withColumn("budget", F.floor(F.col("cap") * F.col("negatives") + 1e-9))
    # the highest score at which more negatives are reached than the budget allows
    at = c.filter("fp > budget").groupBy(*by, "cap", "positives", "negatives").agg(F.max_by(F.struct("score", F.col("tp") - F.col("p"), F.col("fp") - (F.col("n") - F.col("p"))), "score").alias("x"))
    return at.select(*by, "cap", F.col("x.score").alias("boundary"), F.col("x.col3").alias("fp"), F.col("x.col2").alias("tp"), "positives", "negatives", F.try_divide(F.col("x.col3").cast("double"), F.col("negatives").cast("double")).alias("actual_fpr"), F.try_divide(F.col("x.col2").cast("double"), F.col("positives").cast("double")).alias("recall"))


def complementarity(df: DataFrame, label: str, first: str, second: str, cap: float) -> DataFrame:
    """Confusion transitions between two scores, each at its own boundary for the cap."""
    edge = fixed_fpr(df, [], label, first, [cap]).select(F.col("boundary").alias("_a")).join(fixed_fpr(df, [], label, second, [cap]).select(F.col("boundary").alias("_b")), F.lit(True))
    r = df.join(F.broadcast(edge), F.lit(True)).select((F.col(label) == 1).alias("y"), (F.col(first) > F.col("_a")).alias("a"), (F.col(second) > F.col("_b")).alias("b"))
    c = r.agg(*(F.count_if(F.col("y") == y).alias(f"{'defect' if y else 'normal'}") for y in (True, False)), *(F.count_if((F.col("y") == y) & (F.col("a") == a) & (F.col("b") == b)).alias(f"{k}_{n}") for y, k in ((True, "tp"), (False, "fp")) for (a, b), n in (((True, True), "both"), ((True, False), "lost"), ((False, True), "gained"))))
    return c.withColumns({"rescued": F.try_divide(F.col("tp_gained").cast("double"), (F.col("defect") - F.col("tp_both") - F.col("tp_lost")).cast("double")), "kept": F.try_divide(F.col("tp_both").cast("double"), (F.col("tp_both") + F.col("tp_lost")).cast("double"))})


def f1(df: DataFrame, by: list[str], label: str, predicted: str) -> DataFrame:
    """2TP / (2TP + FP + FN); null where nothing is positive or predicted."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    c = df.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    return c.withColumn("f1", F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")))


def partial_area(curve: DataFrame, by: list[str], limit: float = 0.30) -> DataFrame:
    """(by, area): the best y per x, linear in between, from x = 0 to ``limit``, over ``limit``; curve is (by, fpr, pro)."""
    best = curve.groupBy(*by, "fpr").agg(F.max("pro").alias("pro"))
    w = Window.partitionBy(*by).orderBy("fpr")
    s = best.withColumn("x0", F.lag("fpr").over(w)).withColumn("y0", F.lag("pro").over(w)).filter("x0 is not null and x0 < " + str(limit))
    x1 = F.least("fpr", F.lit(limit))
    y1 = F.col("y0") + F.try_divide((F.col("pro") - F.col("y0")) * (x1 - F.col("x0")), F.col("fpr") - F.col("x0"))
    return s.groupBy(*by).agg((F.sum((x1 - F.col("x0")) * (F.col("y0") + y1) / 2) / limit).alias("area"))
