import base64
import hashlib
import io
import os

import duckdb

from anomalake.llm import warc
from anomalake.llm.queries import ORACLE, op6_warc
from anomalake.llm.store import Workspace, filesystem


def scan(raw, width):
    return [x for s in range(0, len(raw), width) for x in warc.read_range(io.BytesIO(raw), len(raw), s, min(len(raw), s + width))]


def test_every_record_is_read_once_for_any_range_width():
    recs = [warc.record(i, f"http://x/{i}", os.urandom(i * 37), None) for i in range(40)]
    for raw in (b"".join(map(warc.member, recs)), b"".join(recs)):
        for width in (97, 1000, 1 << 20):
            got = scan(raw, width)
            assert [g[3]["warc-record-id"] for g in got if g[0] == "record"] == [f"<{warc.URN}{i}>" for i in range(40)]


def test_salvage_recovers_later_records_and_logs_gaps():
    recs = [warc.member(warc.record(i, None, bytes([65 + i]) * 500 + os.urandom(200), None)) for i in range(6)]
    hurt = bytearray(recs[2])
    hurt[len(hurt) // 2] ^= 255
    raw = recs[0] + b"junk\x1f\x8b\x08junk" + recs[1] + bytes(hurt) + recs[3] + recs[4][:50] + recs[5] + b"tail"
    for width in (64, 300, 1 << 20):
        got = scan(raw, width)
        assert [g[3]["warc-record-id"][-2] for g in got if g[0] == "record"] == ["0", "1", "3", "5"], width
    gaps = [(a, b) for k, a, b, _ in scan(raw, 1 << 20) if k == "gap"]
    ends = [len(recs[0]), len(recs[0]) + 11]
    assert gaps[0] == tuple(ends) and len(gaps) == 4 and gaps[-1][1] == len(raw)


def test_plain_file_salvage():
    recs = [warc.record(i, None, b"p%d" % i * 30, None) for i in range(4)]
    raw = recs[0] + recs[1][:80] + recs[2] + recs[3]
    got = scan(raw, 1 << 20)
    assert [g[3]["payload"][:2] for g in got if g[0] == "record"] == [b"p0", b"p2", b"p3"]
    assert [(g[1], g[2]) for g in got if g[0] == "gap"] == [(len(recs[0]), len(recs[0]) + 80)]


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.page_id: r for r in op6_warc(spark, d).collect()}
    pages = duckdb.sql(f"select page_id, html from '{d}/pages.parquet'").fetchall()
    first = {}
    for p, h in sorted(pages):
        first.setdefault(h or "", p)
    assert len(rows) == len(pages)
    for p, h in pages:
        raw, r = (h or "").encode(), rows[p]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == p else ("revisit", first[h or ""]))


def test_nulls_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", "x"), (3, "w", "x"), (4, "a\r\nb: c", "é")], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(warc.write(df, Workspace(spark, "t"))).collect())
    assert got == [(0, "revisit", 3, 1), (1, "response", None, 0), (2, "revisit", 1, 0), (2, "revisit", 1, 0), (3, "response", None, 1), (4, "response", None, 2)]
    assert warc.read(warc.write(df.limit(0), Workspace(spark, "t"))).count() == 0


def test_gap_rows_of_a_damaged_archive(spark):
    df = spark.range(30).selectExpr("id page_id", "concat('u', id) url", "repeat(cast(id as string), 50) html").coalesce(1)
    table = warc.write(df, Workspace(spark, "t"))
    _, at = filesystem(table.first().path)
    with open(at, "r+b") as f:
        f.seek(1000)
        f.write(b"\xff" * 30)
    got = warc.read(table, width=512).collect()
    assert sum(r.kind == "record" for r in got) >= 28 and sum(r.kind == "gap" for r in got) == 1


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    got = op6_warc(spark, d)
    cur = con.execute(ORACLE["op6_warc"])
    names = [c[0] for c in cur.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall()) and set(got.columns) == set(names)


def test_gaps_are_logged_once_for_any_range_width():
    plain = [warc.record(i, None, bytes([65 + i]) * 500 + os.urandom(200), None) for i in range(8)]
    for recs in ([warc.member(r) for r in plain], plain):
        hurt = [bytearray(r) for r in recs]
        for i in (2, 5):
            hurt[i][len(hurt[i]) // 2] ^= 255
        if recs is not plain:
            hurt[3] = warc.member(plain[3] + b"more")  # a sound member with bytes after its record
        raw = b"".join([*hurt[:7], hurt[7][:-30]])
        at = [0]
        for r in hurt:
            at.append(at[-1] + len(r))
        for start in (0, at[2], at[5], at[7]):  # also files that begin or end with damage
            part = raw[start:]
            want = sorted((k, a, b) for k, a, b, _ in scan(part, len(part)))
            ends = sorted(b for *_, b in want)
            assert sorted(a for _, a, _ in want) == [0, *ends[:-1]] and ends[-1] == len(part) and any(k == "gap" for k, *_ in want)
            for width in (64, 97, 300, 700, at[2], at[3], at[5], at[7]):
                assert sorted((k, a, b) for k, a, b, _ in scan(part, width)) == want, (start, width)
