import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from anomalake.llm import graph, minhash
from anomalake.llm.queries import op3_minhash
from anomalake.llm.store import Workspace


def sets(rows, size):
    out = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        out[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def brute(rows, size=4):
    s = sets(rows, size)
    by = {}
    for d, x in s.items():
        for g in x:
            by.setdefault(g, []).append(d)
    parent = {d: d for d in s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for d in ids:
        shared = {}
        for g in s[d]:
            for o in by[g]:
                if o < d:
                    shared[o] = shared.get(o, 0) + 1
        for o, k in shared.items():
            if 100 * k >= 80 * (len(s[d]) + len(s[o]) - k):
                a, b = root(d), root(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s[d]), root(d)) for d in ids}


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    want = brute(duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op3_minhash(spark, d).collect()}
    assert got == want and any(c != d for d, (_, c) in want.items())


def test_chains_groups_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "PARTNERS", 1)
    monkeypatch.setattr(minhash, "SETS", 5)
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows, text = [(0, None), (1, ""), (2, " \t"), (3, "One two"), (4, "one  TWO"), (5, "one two é")], list(base)
    for i in range(6, 60):  # a chain: each a few words off the one before, the ends far apart
        text[r.randrange(len(text))] = f"x{i}"
        rows.append((i, " ".join(text)))
    for i in range(60, 100):  # a group around one text, its members often below the threshold to each other
        t = list(base)
        for _ in range(3):
            t[r.randrange(len(t))] = f"y{i}"
        rows.append((i, " ".join(t)))
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.duplicates(df, Workspace(spark, "t"), 4).collect()}
    assert got == want
    odd = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (8, "A B C D E")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.component_id) for x in minhash.duplicates(odd, Workspace(spark, "t"), 4).collect()) == [(0, None), (7, 7), (7, 7), (8, 7)]
    assert minhash.duplicates(df.limit(0), Workspace(spark, "t")).count() == 0


def test_sketch_estimates_high_similarities():
    r = np.random.default_rng(1)
    for j in (0.8, 0.9, 0.95):
        common, a, b = (r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (int(1000 * j), int(500 * (1 - j)), int(500 * (1 - j))))
        x, y = (np.frombuffer(minhash.odd_sketch(minhash.samples(np.concatenate([common, v]))), np.uint64) for v in (a, b))
        z = int(np.bitwise_count(x ^ y).sum())
        est = 1 + minhash.BITS / (4 * minhash.SAMPLES) * np.log(1 - 2 * z / minhash.BITS)
        assert abs(est - j) < 0.08 and z <= minhash.most_differing(0.8)


@pytest.mark.parametrize("n", [1, 50])
def test_components_of_a_path(spark, n):
    e = spark.range(n).selectExpr("id * 2 + 1 a", "id * 2 + 3 b")
    got = {r.node: r.component for r in graph.components(e, Workspace(spark, "t")).collect()}
    assert got == {2 * i + 1: 1 for i in range(n + 1)}


def test_shared_buckets_of_sorted_rows():
    r = random.Random(9)
    for trial in range(60):
        rows = sorted({(r.randint(0, r.choice((3, 30))), r.randint(0, 9000)) for _ in range(r.choice((0, 1, 5, 40, 9000)))})
        cut = sorted(r.randint(0, len(rows)) for _ in range(r.randint(0, 5)))
        parts = [rows[a:b] for a, b in zip([0, *cut], [*cut, len(rows)], strict=True)]
        batches = [pa.RecordBatch.from_arrays([pa.array([b for b, _ in x], pa.int64()), pa.array([i for _, i in x], pa.int64())], names=["bucket", "id"]) for x in parts]
        got = [tuple(v.values()) for b in minhash._shared(iter(batches)) for v in b.to_pylist()]
        of = {}
        for b, i in rows:
            of.setdefault(b, []).append(i)
        edge = {rows[0][0], rows[-1][0]} if rows else set()
        assert got == [(b, i, of[b][0]) for b, i in rows if len(of[b]) > 1 or b in edge], trial
