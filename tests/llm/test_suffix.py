import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from anomalake.llm import suffix
from anomalake.llm.queries import op8_suffix
from anomalake.llm.store import Workspace


@pytest.mark.parametrize("k", [1, 2, 3, 26, 1 << 40])
def test_suffix_array_equals_sorting(k):
    r = np.random.default_rng(k % 1000)
    for n in [*range(0, 40), 200, 301, 302]:
        s = r.integers(0, k, n)
        assert suffix.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist()), (k, n)
    s = np.array([5, 6, 7] * 70 + [5])
    assert suffix.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        out.append((len(x), sum(gone), bytes(gone).replace(b"\0", b" ").split().__len__(), kept))
    return out


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    want = {doc: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for (doc, _), w in zip(rows, brute([t for _, t in rows], 200), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op8_suffix(spark, d).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 0


@pytest.mark.parametrize(("hot", "pieces"), [(1, 0), (2, 10_000), (6000, 10_000)])
def test_shared_passages_runs_and_ties(spark, monkeypatch, hot, pieces):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "WIDTHS", (9, 3, 1))
    monkeypatch.setattr(suffix, "BROADCAST_PIECES", pieces)
    monkeypatch.setattr(suffix, "CHUNK", 500)
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    passage, line = word(90), "same line of text "
    texts = [None, "", "short", "a" * 300, word(50), passage, "ab" * 100]
    for i in range(25):
        texts.append(word(r.randint(0, 80)) + passage[: r.randint(20, 90)] + word(30) + line * r.randint(0, 3) + word(r.randint(0, 60)))
    texts += [texts[8], texts[8], texts[9] + "x"]
    for length in (30, 60):
        df = spark.createDataFrame([(i % 9 or None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, id string")
        got = Counter((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.deduplicate(df, Workspace(spark, "t"), length).collect())
        assert got == Counter(brute(texts, length))
    assert suffix.deduplicate(df.limit(0), Workspace(spark, "t")).count() == 0


def test_a_piece_has_one_span():
    a, b = b"abcdefghij" * 2 + b"XY", b"abcdefghij" * 2 + b"ZW"
    spans = suffix._flags([(1, a), (1, b), (2, a), (3, b)], np.array([1, 1, 1, 2]), 12)
    assert spans == [(0, 20), (0, 20), None, (0, 22)]


def test_hot_pieces_beyond_the_bound_are_neither_broadcast_nor_multiplied(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 4)
    monkeypatch.setattr(suffix, "BROADCAST_PIECES", -1)
    plans, table = {}, Workspace.table

    def kept(self, df, name):
        plans[name] = df._jdf.queryExecution().simpleString()
        return table(self, df, name)

    monkeypatch.setattr(Workspace, "table", kept)
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = word(400)
    texts = [word(20) + passage[: 150 + i % 7 * 30] + word(40) + passage[200 + i % 5 * 9 :] for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    spans = suffix.repeated_spans(docs, Workspace(spark, "t"), 60)
    assert "SortMergeJoin" in plans["spans"]
    assert "Broadcast" not in plans["spans"] and "arrays_zip" not in plans["spans"]
    seen = Counter(t[i : i + 60] for t in texts for i in range(len(t) - 59))
    got = spans.collect()
    for k, t in enumerate(texts):
        want = suffix.removed(len(t), [(i, i + 60) for i in range(len(t) - 59) if seen[t[i : i + 60]] > 1])
        assert want and suffix.removed(len(t), [(x.a, x.b) for x in got if x.id == k]) == want


def test_keys_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BROADCAST_KEYS", 1)
    plans, table = {}, Workspace.table
    monkeypatch.setattr(Workspace, "table", lambda self, df, name: plans.update({name: df._jdf.queryExecution().simpleString()}) or table(self, df, name))
    r = random.Random(2)
    text = "".join(r.choice("abcdefgh ") for _ in range(900))
    spans = suffix.repeated_spans(spark.createDataFrame([(0, text), (1, text[300:]), (2, "x" + text[:500])], "id long, text string"), Workspace(spark, "t"), 200)
    assert any("SortMergeJoin" in line and "LeftSemi" in line for line in plans["pieces"].splitlines())
    assert {k: suffix.removed(1000, [(x.a, x.b) for x in spans.collect() if x.id == k]) for k in range(3)} == {0: [(0, 900)], 1: [(0, 600)], 2: [(1, 501)]}


def test_repeats_inside_documents_and_copies_do_not_multiply_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 3)
    tables, table = {}, Workspace.table

    def kept(self, df, name):
        tables.setdefault(name, []).append(table(self, df, name))
        return tables[name][-1]

    monkeypatch.setattr(Workspace, "table", kept)
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line = word(50)
    texts = [word(30) + line * 20 + word(30) for _ in range(12)] + [word(25) + line + word(25) for _ in range(12)]
    made = []
    for copies in (4, 8):  # of every text, so that all anchors are hot
        tables.clear()
        docs = spark.createDataFrame(list(enumerate(texts * copies)), "id long, text string")
        got = suffix.repeated_spans(docs, Workspace(spark, "t"), 60).collect()
        pieces = tables["pieces"][0]
        assert pieces.count() == pieces.select("id", "h", "piece").distinct().count()
        for k, t in enumerate(texts * copies):  # whole copies
            assert suffix.removed(len(t), [(x.a, x.b) for x in got if x.id == k]) == [(0, len(t))]
        made.append(([x.count() for x in tables["classes"]], pieces.count(), len(got)))
    (classes, rows, spans), (more_classes, more_rows, more_spans) = made
    assert min(classes) > 0 and more_classes == classes  # copies add none to the levels
    assert (more_rows, more_spans) == (2 * rows, 2 * spans)  # and as many as they are to the rest
