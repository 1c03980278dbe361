import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from anomalake.llm import bpe
from anomalake.llm.queries import VOCABULARY as PATH
from anomalake.llm.queries import op4_bpe

ODD = [
    "", " ", "a", "  two  words ", "ǅ É́é ſ İI ΑΣ ς", "x\x1cy z", "<|endoftext|>hi <|startoftext|> <|EndOfText|> a<|endoftext|>b", "don't WE'LL 're 12345",
    "日本語 テスト　한국́ ", "a" * 5000, "  x​y\u0085z", "🎉👩‍👩‍👧 test'S", "a ́b", "word,%%% (x) x|y| -- A.B.", "é" * 900, "same " * 700,
]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


def test_equals_library_on_odd_texts(lib):
    enc = bpe.ChunkEncoder(PATH)
    assert enc.exact
    for t in ODD + [" ".join(ODD), "".join(ODD)]:
        want = lib.encode(t, add_special_tokens=False).ids
        got = enc.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want, t[:40]
        assert enc.decode(got) == lib.decode(want, skip_special_tokens=False)


def test_shared_chunks_are_encoded_once(lib):
    text = " ".join(f"w{i * 7919 % 9973}" for i in range(8000))
    enc, known = bpe.ChunkEncoder(PATH), bpe.Chunks()
    enc.encode_all([text], known)
    first = enc.encoded
    enc.encode_all(["another start " + text], known)
    assert enc.encoded - first < first / 4 and enc.reused > first / 2 and not enc.whole


def test_the_maps_are_bounded_and_change_nothing(lib, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 500)
    texts = [" ".join(f"w{i * k % 997}" for i in range(900)) for k in range(1, 12)] * 2 + ["<|EndOfText|> <|endoftext|> Word WORD word"]
    enc, known = bpe.ChunkEncoder(PATH), bpe.Chunks(20_000)
    for t in texts:
        assert enc.encode_all([t], known) == [np.asarray(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
        assert known.held <= 20_000 and len(known.words) + len(known.older) <= 2 * (500 + 2 * 900)


def test_a_join_that_disagrees_takes_the_whole_text(lib, monkeypatch):
    enc, text = bpe.ChunkEncoder(PATH), " ".join(f"word{i}" for i in range(900))
    library = enc._library
    monkeypatch.setattr(enc, "_library", lambda strings: {s: x[:-4] if s.count(" ") == 2 else x for s, x in library(strings).items()})
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids and enc.whole == 1


def test_other_tokenizers_take_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, lib = bpe.ChunkEncoder(path), Tokenizer.from_file(path)
    for t in ODD:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == ids and enc.decode(enc.encode(t)) == lib.decode(ids, skip_special_tokens=False)


def test_very_long_texts(lib):
    for t in ("x" * 300_000, "one two " * 60_000):
        assert np.frombuffer(bpe.ChunkEncoder(PATH).encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_query_equals_library_on_whole_table(spark, lib):
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in op4_bpe(spark, d).collect()}
    want = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    assert len(rows) == len(want)
    for doc, text in want:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        r = rows[doc]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_operator_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (1, "a b", None)], "doc_id long, text string, token_ids string")
    got = bpe.encode(df, PATH, decoded="plain").collect()
    assert [len(r.token_ids) for r in got] == [0, 0, 2] and [r.plain for r in got] == ["", "", "a</w> b</w>"]
    assert bpe.encode(df.limit(0), PATH).count() == 0
