"""WARC archives: a writer that points repeated payloads at their first response, and a salvage reader.

The reader works on byte ranges. It takes each record that begins in its range, whatever range it ends in. Where a
check fails (gzip's CRC, the version line, a header, the length, the payload digest), it looks for the next offset
at which a whole valid member (or, in plain files, a version line) begins, goes on from there, and logs the bytes
between as a quarantined gap. The range that a gap's preceding sound record begins in logs the whole gap, wherever it
lies, so records and gaps cover the file once at any width of the ranges.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomalake.llm.store import Workspace, filesystem

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
CRLF = b"\r\n"
#: Bytes after which a task begins another archive, and bytes a reader takes at a time.
ROLL, RANGE, READ = 64 << 20, 16 << 20, 1 << 20
URN = "urn:anomalake:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit with the HTTP header alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head if refers_to is not None else head + payload
    name = URN + ("" if page_id is None else str(page_id))
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(url.split("\r")).replace("\n", "")))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    fields.append(("Content-Length", str(len(body))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + CRLF + body + CRLF + CRLF


def member(raw: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Bad(ValueError):
    pass


def parse(raw: bytes) -> tuple[dict, int]:
    """(the record's fields and payload, its bytes) of the record that raw begins with; Bad if a check fails."""
    if not raw.startswith(VERSION):
        raise Bad("no version line")
    end = raw.find(CRLF + CRLF)
    if end < 0:
        raise Bad("header without end")
    fields = {}
    for line in raw[:end].split(CRLF)[1:]:
        k, sep, v = line.partition(b":")
        if not sep:
            raise Bad("header line without colon")
        fields[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    size = fields.get("content-length", "")
    if not size.isdigit():
        raise Bad("no length")
    body = raw[end + 4 : end + 4 + int(size)]
    stop = end + 4 + int(size) + 4
    if len(body) < int(size) or raw[stop - 4 : stop] != CRLF + CRLF:
        raise Bad("short block")
    http, sep, payload = body.partition(CRLF + CRLF)
    if not sep:
        raise Bad("HTTP header without end")
    length = next((x.partition(b":")[2].strip() for x in http.split(CRLF) if x.lower().startswith(b"content-length:")), b"")
    want = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields.get("warc-type") == "response" and want and digest(payload) != want:
        raise Bad("payload digest")
    fields["payload"] = payload
    fields["payload_bytes"] = int(length) if length.isdigit() else len(payload)
    fields["payload_digest"] = want or digest(payload)
    return fields, stop


class Window:
    """Random access to a file, some bytes at a time."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.data = f, size, 0, b""

    def get(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        if not (self.at <= start and start + n <= self.at + len(self.data)):
            self.f.seek(start)
            self.at, self.data = start, self.f.read(max(n, min(READ, self.size - start)))
        return self.data[start - self.at : start - self.at + n]

    def find(self, what: bytes, start: int, stop: int) -> int:
        """The first offset in [start, stop) at which ``what`` begins, or -1."""
        while start < stop:
            piece = self.get(start, READ + len(what) - 1)
            i = piece.find(what)
            if i >= 0:
                return start + i if start + i < stop else -1
            if start + len(piece) >= self.size:
                return -1
            start += READ
        return -1


def _inflate(w: Window, start: int) -> tuple[bytes, int]:
    """(data, bytes of the file) of the gzip member at start; Bad if it isn't whole and sound."""
    z, out, at = zlib.decompressobj(31), [], start
    while not z.eof:
        piece = w.get(at, 1 << 16)
        if not piece:
            raise Bad("member without end")
        try:
            out.append(z.decompress(piece))
        except zlib.error as e:
            raise Bad(f"gzip: {e}") from None
        at += len(piece)
    return b"".join(out), at - len(z.unused_data) - start


def _plain(w: Window, start: int) -> tuple[dict, int]:
    """The uncompressed record at start; its header and length say how much is read."""
    n = 1 << 16
    while True:
        raw = w.get(start, n)
        if not raw.startswith(VERSION):
            raise Bad("no version line")
        end = raw.find(CRLF + CRLF)
        if end < 0 and len(raw) == n and n < READ:
            n *= 4
            continue
        if end < 0:
            raise Bad("header without end")
        size = next((x.partition(b":")[2].strip() for x in raw[:end].split(CRLF) if x.lower().startswith(b"content-length:")), b"")
        if not size.isdigit() or start + end + 8 + int(size) > w.size:
            raise Bad("no length, or beyond the file's end")
        return parse(w.get(start, end + 8 + int(size)))


def read_range(f, size: int, start: int, end: int) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", offset, end, fields) and ("gap", offset, end, reason) for what begins in [start, end)."""
    w = Window(f, size)
    gz = w.get(0, 3) == MAGIC or w.get(0, len(VERSION)) != VERSION and w.find(MAGIC, 0, size) >= 0
    mark = MAGIC if gz else VERSION
    at, bad, why = start, None, ""
    if start:  # the record that reaches into this range belongs to the one before
        while (at := w.find(mark, at, end)) >= 0 and not _valid(w, at, gz):
            at += 1
        if at < 0:
            return
    while at < size:
        try:
            fields, n = _record(w, at, gz)
        except Bad as e:
            if bad is None:
                bad, why = at, str(e)
            at = w.find(mark, at + 1, size)
            if at < 0:
                at = size
            continue
        if bad is not None:
            yield "gap", bad, at, why
            bad = None
        if at >= end:
            return  # the next range finds this record itself
        yield "record", at, at + n, fields
        at += n
    if bad is not None:
        yield "gap", bad, at, why


def _record(w: Window, at: int, gz: bool) -> tuple[dict, int]:
    """(fields, bytes of the file) of the record at ``at``; Bad if a check fails."""
    if not gz:
        return _plain(w, at)
    raw, n = _inflate(w, at)
    fields, used = parse(raw)
    if used != len(raw):
        raise Bad("bytes after the record in its member")
    return fields, n


def _valid(w: Window, at: int, gz: bool) -> bool:
    try:
        _record(w, at, gz)
    except Bad:
        return False
    return True


def mark_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds payload_bytes, refers_to: for payloads of at least ``least`` bytes that repeat, the smallest page_id with them.

    One small row a payload is grouped, with partial sums before the shuffle; only payloads that repeat are joined
    back, so one hot payload is split by the skew join. Rows with that smallest id are responses, also if repeated;
    null ids rank last and rows with a null id alone stay responses.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.select("page_id", "url", "html", F.sha1(body).alias("_h"))
    first = hashed.filter(F.length(body) >= least).groupBy("_h").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return hashed.join(first, "_h", "left").select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("_first")), F.col("_first")).alias("refers_to"))


def write(pages: DataFrame, ws: Workspace, least: int = 0) -> DataFrame:
    """Writes a record a row into archives below the workspace; returns the written table of (path, size, records).

    A failed attempt's archives aren't in that table, so nothing is read twice. A null html is an empty payload, a
    null url has no target. An empty table writes no archive.
    """
    root = ws.path("warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)
        out, path, size, n = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "size": [size], "records": [n]}, pa.schema([("path", "string"), ("size", "int64"), ("records", "int64")]))

        for batch in batches:
            cols = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                page, url, text, refers = (c[i].as_py() for c in cols)
                raw = member(record(page, url, (text or "").encode("utf-8", "surrogatepass"), refers))
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, size, n, out = f"{root}/{name}", 0, 0, fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= ROLL:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return ws.table(mark_revisits(pages, least).mapInArrow(run, "path string, size long, records long"), "archives")


def read(archives: DataFrame, width: int = RANGE, parallel: int | None = None) -> DataFrame:
    """Reads archives of (path, size), a task a few byte ranges: page_id, url, type, digest, sizes and payload, or a gap.

    Columns: kind (record or gap), path, begin, end, reason, page_id, url, record_type, payload_digest,
    payload_bytes, refers_to, payload.
    """
    schema = "kind string, path string, begin long, end long, reason string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    names = [c.split()[0] for c in schema.split(", ")]
    types = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)])

    def number(urn: str | None) -> int | None:
        tail = (urn or "").strip("<>").removeprefix(URN)
        return int(tail) if tail.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, at = filesystem(path)
                rows, held = [], 0
                with fs.open_input_file(at) as f:
                    for kind, a, b, got in read_range(f, size, start, min(start + width, size)):
                        if kind == "gap":
                            rows.append((kind, path, a, b, got, *[None] * 7))
                        else:
                            rows.append((kind, path, a, b, None, number(got.get("warc-record-id")), got.get("warc-target-uri"), got.get("warc-type"), got["payload_digest"], got["payload_bytes"], number(got.get("warc-refers-to")), got["payload"]))
                            held += len(got["payload"])
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    ranges = archives.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(width).cast("long"))).alias("start"))
    n = parallel or max(1, min(20_000, ranges.count()))
    return ranges.repartition(n, "path", "start").mapInArrow(run, schema)
