import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from anomalake.llm import decontaminate as dc
from anomalake.llm import pii
from anomalake.llm.queries import VOCABULARY, op9_toxicity
from tests.llm.test_minhash import brute

D = "/root/testdata/sf0.001"


def test_stages_are_in_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "encoding"]


def test_run_against_brute_force(spark):
    docs = {d: t for d, t in duckdb.sql(f"select doc_id, text from '{D}/documents.parquet'").fetchall()}
    toxic = {r.doc_id for r in op9_toxicity(spark, D).collect() if r.predicted}
    docs = {d: t for d, t in docs.items() if d not in toxic}
    docs = {d: docs[d] for d, (_, c) in brute(list(docs.items()), 5).items() if c == d}
    items = duckdb.sql(f"select item_id, text from '{D}/benchmark.parquet'").fetchall()
    for d in list(docs):
        w, _ = dc.word_stream([docs[d]])
        if any(dc.distance(x, w)[0] <= 0.2 * len(x) for x in (dc.word_stream([t])[0] for _, t in items)):
            del docs[d]
    got = {r.doc_id: r for r in cp.run(spark, D).collect()}
    assert set(got) == set(docs)
    lib = Tokenizer.from_file(VOCABULARY)
    plain = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    spans = {r.doc_id: r.pii.spans for r in pii.detect(plain, pii.fit(spark)).select("doc_id", "pii").collect()}
    for d, text in docs.items():
        out, at = "", 0
        for s in sorted(spans[d], key=lambda s: (s.start, -s.end, s.kind)):
            if s.start >= at:
                out += text[at : s.start] + f"[{pii.KINDS[s.kind].upper()}]"
            at = max(at, s.end)
        out += text[at:]
        assert got[d].text == out and got[d].n_chars == len(out)
        ids = lib.encode(out, add_special_tokens=False).ids
        assert got[d].token_ids == ids and got[d].n_tokens == len(ids) and got[d].decoded == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_nulls_repeats_and_extra_columns(spark, empty):
    rows = [(None, None, None, None, None, "a"), (1, "Some words of a text to keep, a@b.co", "en", "s", 5, "b"), (1, "Some words of a text to keep, a@b.co", "en", "s", 5, "b"), (2, "", None, None, 0, "c"), (3, "some words of a text to keep, a@b.co", "en", "s", 5, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    df = df.limit(0) if empty else df
    for name, stage in cp.STAGES:
        out = stage(spark, df, D)
        assert set(df.columns) <= set(out.columns), name
        df = out
    got = sorted((r.doc_id or 0, r.text) for r in df.collect())
    assert got == ([] if empty else [(0, None), (1, "Some words of a text to keep, [EMAIL]"), (2, "")])


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a, "x"), (5, b, "y"), (3, f"{a} more", "z"), (5, b, "v"), (4, c, "u"), (4, "", "t"), (4, "", "s"), (6, f"{c} more", "r"), (None, c, "q"), (7, None, "p"), (7, None, "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, what string")
    for x in (df, df.repartition(5), df.select("text", "what", "doc_id").coalesce(1)):
        got = cp.drop_near_duplicates(spark, x, D)
        assert got.columns == x.columns
        # 5's text a goes with 3, 6 with 4; 5's text b is nobody else's
        assert sorted(r.what for r in got.collect()) == ["o", "q", "s", "u", "v", "z"]
