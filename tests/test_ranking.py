import random

import numpy as np
import pytest

from anomalake.operators import ranking

SCHEMA = "g string, y int, s double"


def brute(rows, most):
    out = {}
    for g in {r[0] for r in rows} - {None}:
        s = np.array([r[2] for r in rows if r[0] == g and r[2] is not None])
        told = [(r[1], r[2]) for r in rows if r[0] == g and r[1] is not None and r[2] is not None]
        if not told:
            continue
        y, v = np.array([t[0] for t in told]), np.array([t[1] for t in told])
        best = []
        for t in np.quantile(s, np.linspace(0, 1, most)):
            hit = v >= t - 1e-12
            total = hit.sum() + y.sum()
            best.append((-(2 * (y * hit).sum() / total if total else -1.0), t))
        f1, t = min(best)
        out[g] = (round(-f1, 9), round(t, 9))
    return out


@pytest.mark.parametrize(("n", "values", "most"), [(60, 5, 8), (400, 1 << 20, 64), (4, 3, 8), (300, 9, 100)])
def test_best_f1_equals_brute_force(spark, n, values, most):
    r = random.Random(n)
    rows = [(r.choice("ab"), r.choice([0, 1, 1, None]), r.choice([None, *(r.randint(-values, values) / 8 for _ in range(6))])) for _ in range(n)]
    rows += [("one", 1, 2.0), ("untold", None, 1.0), (None, 1, 1.0)]
    got = {x.g: (round(x.f1, 9), round(x.threshold, 9)) for x in ranking.best_f1(spark.createDataFrame(rows, SCHEMA), ["g"], "y", "s", most).collect()}
    assert got == brute(rows, most)


def test_best_f1_takes_no_group_in_one_task_and_reads_rows_once(spark, tmp_path):
    rows = [("ab"[i % 2], i * 7 % 3 % 2, float(i * 37 % 101)) for i in range(400)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "t"))
    df = ranking.best_f1(spark.read.parquet(str(tmp_path / "t")), ["g"], "y", "s", 16)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "percentile(" not in plan  # it holds all of a group's distinct values
    assert plan.count("FileScan") == 1
