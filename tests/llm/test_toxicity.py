import random

import duckdb
import pytest
from pyspark.sql import functions as F

from anomalake.llm import toxicity
from anomalake.llm.queries import op9_toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_brute_force():
    r = random.Random(5)
    terms = ["".join(r.choice("abc") for _ in range(r.randint(5, 8))) for _ in range(40)]
    trie = toxicity.Trie(terms, ["zzy"])
    for _ in range(3000):
        w = "".join(r.choice("abc") for _ in range(r.randint(4, 9)))
        near = sorted(t for t in terms if distance(t, w) == 1)
        got = trie.match(w)
        want = ("term", w, 0) if w in terms else ("fuzzy", near[0], 1) if near else None
        assert got == want, w
    assert trie.match("zzyx") == ("stem", "zzy", 0) and trie.match("zz") is None


def test_context_parts_quotation_from_abuse():
    quoted = 'he said : " you idiot " yesterday'.split()
    assert toxicity.context(quoted, quoted.index("idiot")) < toxicity.context(["an", "idiot", "here"], 1) < toxicity.context("you are an idiot".split(), 3)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = op9_toxicity(spark, d)
    assert got.count() == 10000 and got.filter("score < 0 or score > 1 or score is null").count() == 0
    y = spark.read.parquet(f"{d}/labels.parquet")
    h = got.filter("held_out").join(y, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    rate = {r.toxic: r.p for r in h}
    assert rate[1] > 0.9 and rate[0] < 0.03
    parts = duckdb.sql(f"select doc_id from '{d}/documents.parquet' limit 50").fetchall()
    import zlib

    flags = {r.doc_id: r.held_out for r in got.select("doc_id", "held_out").collect()}
    assert all(flags[p] == (zlib.crc32(str(p).encode()) % 4 == 2) for (p,) in parts)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(None, 1), (1, None)]])
def test_few_or_no_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, None), (2, "", "y"), (None, "c", "z")], "doc_id long, text string, score string")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, y)).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, y)).count() == 0


def test_misspelled_terms_are_caught(spark):
    clean = [(i, f"plain words {i} of a text that nobody minds at all, row{i}", 0) for i in range(300)]
    bad = [(300 + i, f"row{i} you disgusting worthless person number{i}", 1) for i in range(60)]
    rows = spark.createDataFrame(clean + bad, "doc_id long, text string, toxic int")
    m = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    assert m.score("what a disgustng wothless thing") > 0.3 > m.score("what a nice thing")


def test_more_distinct_tokens_than_the_memo_holds(monkeypatch):
    texts = [" ".join(f"w{j}" for j in range(i, i + 9)) + " idiot w0" for i in range(0, 60, 3)]
    m = toxicity.Model(["idiot"], [], {"idiot": 4.0}, {"idiot": 3.0}, [-1.0, 1.0, 1.0, 1.0])
    want = [m.hits(t) for t in texts]
    monkeypatch.setattr(toxicity, "MEMO", 4)
    m._memo.clear()
    assert [m.hits(t) for t in texts] == want and all(h == [(9, "term", "idiot", 1.0)] for h in want)
    assert len(m._memo) <= 4 + 11


def test_automaton_ends_on_short_terms_and_stems():
    r = random.Random(6)
    made = sorted({"".join(r.choice("abc") for _ in range(n)) for n in (3, 4, 5, 6, 7, 7, 8, 8)})
    terms, stems = made[::2], made[1::2]
    trie = toxicity.Trie(terms, stems)
    kinds = set()
    for _ in range(4000):
        w = "".join(r.choice("abcd") for _ in range(r.randint(2, 10)))
        if w in terms or any(w.startswith(s) and w != s for s in stems):
            continue
        near = sorted(t for t in terms if distance(t, w) == 1)
        opened = sorted(s for s in stems if any(distance(s, w[:k]) == 1 for k in range(1, len(w))))
        want = ("fuzzy", near[0], 1) if near else ("fuzzy", f"{opened[0]}*", 1) if opened else None
        assert trie.match(w) == want, w
        kinds.add(want and want[1][-1] == "*")
    assert kinds == {None, True, False}


def test_misspellings_of_short_terms_stems_and_terms_with_clean_neighbours():
    # 'scum' is short, words open with 'vermi', the bare 'vermi' is a term of its own, and clean rows hold 'oron' and 'vermouth'
    bad = [["scum", "moron", f"vermi{'abcdefgh'[i % 8]}x", "vermi" if i < 20 else f"n{i}"] for i in range(60)]
    good = [["vermouth", "oron", "text", f"k{i}"] for i in range(600)]
    rows = toxicity.Rows(bad + good, [1] * 60 + [0] * 600)
    m = toxicity.mine(rows, list(range(660)))
    m.weights = [-4.0, 3.0, 3.0, 3.0]
    assert "vermi" in m.terms and "vermi" in m.stems
    for w in ("moronn", "mor0n", "morron", "scumm", "skum", "vermmiex", "vrmihx"):
        assert m.score(f"you are a {w}") > 0.3, w
    assert [h[1] for h in m.hits("the vermi and vermiax or vrmiax")] == ["term", "stem", "fuzzy"]
    assert not m.hits("you and oron and vermouth") and not m.hits("the skum here")
    assert m.score("the morron here") > 0.3 > m.score("you and oron")


def test_misspellings_of_weaker_terms_count_by_their_odds():
    rows = toxicity.Rows([["weakling"] if i < 30 else [f"a{i}"] for i in range(60)] + [["weakling"] if i < 25 else [f"b{i}"] for i in range(600)], [1] * 60 + [0] * 600)
    m = toxicity.mine(rows, list(range(660)))
    assert 0 < m.loose["weakling"] < m.odds["weakling"] < 3.4
