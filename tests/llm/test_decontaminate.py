import random

import duckdb
import numpy as np

from anomalake.llm import decontaminate as dc
from anomalake.llm.queries import op2_decontaminate


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{d}/benchmark.parquet'").fetchall()
    want = set()
    w, begin = dc.word_stream([t for _, t in docs])
    for i, text in items:
        item, _ = dc.word_stream([text])
        for k, (doc, _) in enumerate(docs):
            dist, _ = dc.distance(item, w[begin[k] : begin[k + 1]])
            if dist <= 0.2 * len(item):
                want.add((doc, i, dist))
    got = {(r.doc_id, r.item_id, r.distance) for r in op2_decontaminate(spark, d).collect()}
    assert got == want and want


def test_distance():
    f = lambda s: np.array([hash(x) & 0xFFFF for x in s.split()], np.uint64)
    assert dc.distance(f("a b c"), f("x a b c y")) == (0, 4)
    assert dc.distance(f("a b c"), f("x a c y"))[0] == 1 and dc.distance(f("a b"), f(""))[0] == 2


def test_recall_on_edited_items():
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(10, 60)))) for i in range(150)]
    index = dc.Index(items, 0.2)
    found = total = 0
    for i, text in items:
        for share in (0.0, 0.05, 0.1, 0.2):
            w = text.split()
            for _ in range(int(share * len(w))):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], ["edit"], [w[k], "more"]])
            doc = " ".join([*(r.choice(vocabulary) for _ in range(r.randint(0, 300))), *w, *(r.choice(vocabulary) for _ in range(100))])
            found += any(m[1] == i for m in index.matches([doc]))
            total += 1
    assert found / total >= 0.97


def test_nulls_blocks_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Xx the Quick, brown fox%%% jumps over a dog yy", "a"), (None, "the quick brown fox jumps over a dog", "b"), (2, None, "c"), (3, "", "d"), (3, "nothing here", "e")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, "the quick brown fox jumps over a dog"), (8, None), (9, ""), (None, "x"), (10, "here")], "item_id long, text string")
    for block in (1, 100):
        got = sorted((r.doc_id or 0, r.item_id, r.distance, r.first_word) for r in dc.find(docs, items, block=block).collect())
        assert got == [(0, 7, 0, 0), (1, 7, 0, 1), (3, 10, 0, 1)]
    assert sorted(r.item_id for r in dc.clean(docs, items).collect()) == ["c", "d"]
    assert dc.find(docs.limit(0), items).count() == 0 and dc.find(docs, items.limit(0)).count() == 0


def test_clean_judges_each_row_by_its_text_at_any_block_size(spark):
    rows = [
        (None, "well the quick brown fox jumps over a dog", "bad: null id"),
        (1, "one two three four five six seven", "bad: first passage of an id"),
        (1, "a plain text", "good: shares its id with a bad row"),
        (2, "red green blue white black grey pink", "bad: second passage of an id"),
        (2, "red green blue white black grey pink", "bad: repeated row"),
        (3, "north south east west up down left", "bad: item without an id"),
        (None, "another plain text", "good: null id"),
        (4, None, "good: null text"),
        (5, "", "good: empty text"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, what string")
    items = spark.createDataFrame([(7, "the quick brown fox jumps over a dog"), (8, "one two three four five six seven"), (8, "red green blue white black grey pink"), (None, "north south east west up down left"), (9, None), (10, "")], "item_id long, text string")
    want = sorted((r for r in rows if r[2].startswith("good")), key=lambda r: r[2])
    for block in (1, 2, 100):
        got = dc.clean(docs, items, block=block)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=lambda r: r[2]) == want, block
    assert dc.clean(docs, items.limit(0), block=1).count() == len(rows) and dc.clean(docs.limit(0), items, block=1).count() == 0
