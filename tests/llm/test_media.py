import hashlib
import zlib

import duckdb
import pytest

from anomalake.llm import media
from anomalake.llm.queries import op1_media
from anomalake.llm.store import Workspace, filesystem


def test_png_round_trip():
    for data in (b"", b"a", b"x" * 192, bytes(range(256)) * 9):
        payload = media.pad(data)
        assert len(payload) % 192 == 0 < len(payload)
        assert media.from_png(media.to_png(payload, len(data))) == (payload, len(data))
    png = bytearray(media.to_png(media.pad(b"abc"), 3))
    png[50] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(png))


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in op1_media(spark, d).collect()}
    want = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    assert len(rows) == len(want)
    for doc, text in want:
        raw, r = (text or "").encode(), rows[doc]
        payload = media.pad(raw)
        png = media.to_png(payload, len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest())
        assert r.feature == media.feature(payload)


def test_ranges_read_each_member_once_and_a_bad_member_alone_fails(spark):
    df = spark.createDataFrame([(None, "a"), (1, None), (1, None), *((i, "é" * i * 9) for i in range(2, 60))], "doc_id long, text string").coalesce(1)
    manifest = media.write(df, Workspace(spark, "t"))
    for width in (700, 1 << 20):
        got = media.read(spark, manifest, width).collect()
        assert len(got) == 61 and sorted(r.key for r in got)[:3] == ["", "1", "1"] and not any(r.error for r in got)
    _, at = filesystem(got[0].archive)
    with open(at, "r+b") as f:
        f.seek(max(r.offset for r in got) + 100)
        f.write(b"????")
    bad = [r for r in media.read(spark, manifest).collect() if r.error]
    assert len(bad) == 1 and bad[0].payload is None
    assert media.read(spark, media.write(df.limit(0), Workspace(spark, "t"))).count() == 0
