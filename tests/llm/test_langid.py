import zlib

import pytest
from pyspark.sql import functions as F

from anomalake.llm import langid
from anomalake.llm.queries import op10_langid


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = op10_langid(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    hidden = docs.withColumn("lang", F.when(langid.held_out("doc_id", 5, 0), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (langid.fit(x.filter(~langid.held_out("doc_id", 5, 0))) for x in (docs, hidden))
    assert a.languages == b.languages and (a.table == b.table).all()


@pytest.mark.parametrize("rows", [[], [(1, None, "en")], [(1, "some text", None)]])
def test_nothing_to_learn(spark, rows):
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "123 !", "c"), (None, "word", None)], "doc_id long, text string, score string")
    got = langid.predict(docs, langid.fit(train)).collect()
    assert [r.lang_pred for r in got] == ["und"] * 4 and not any(r.score for r in got)


def test_texts_without_letters_are_undetermined(spark):
    docs = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)], "doc_id long, text string, lang string")
    m = langid.fit(docs)
    lang, score = m.predict([None, "", "12 %%", "the dog", "die katze", "the dog " * 50_000])
    assert lang == ["und", "und", "und", "en", "de", "en"] and score[:3].tolist() == [0, 0, 0]
    assert langid.predict(docs.limit(0), m).count() == 0
