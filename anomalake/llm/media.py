"""Media columns: payloads kept losslessly as images in archives, and a data source that reads them back.

A payload is stored as an 8-bit RGB image of 64 pixels a row (192 bytes), as a member of a ZIP archive. The data
source ``media_archive`` plans byte ranges over a directory of archives: a partition holds the members whose
headers begin in its range, which it finds in the archive's own directory. Members are read by offset, each
verified and retried by itself, and leave in Arrow batches of bounded size.
"""

from __future__ import annotations

import math
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from anomalake.llm.bpe import slices
from anomalake.llm.store import Workspace, filesystem

UNIT = 192
ROLL, RANGE, BATCH = 64 << 20, 16 << 20, 4 << 20
ATTEMPTS = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(data: bytes) -> bytes:
    """The bytes with spaces up to a positive multiple of 192."""
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int, level: int = 1) -> bytes:
    """An RGB image of 64 x len/192 pixels whose samples are the payload; the unpadded length is in a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    data = np.zeros((len(rows), UNIT + 1), np.uint8)  # filter 0 before each row
    data[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT // 3, len(rows), 8, 2, 0, 0, 0)) + _chunk(b"tEXt", b"Bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(data, level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of an image that to_png made; ValueError for any other."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, size, packed, n = 8, None, [], None
    while at < len(media):
        (k,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + k]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + k)[0]:
            raise ValueError("chunk's CRC")
        at += 12 + k
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data)
        elif kind == b"tEXt" and data.startswith(b"Bytes\0"):
            n = int(data[6:])
        elif kind == b"IDAT":
            packed.append(data)
    if size is None or size[0] != UNIT // 3 or size[2:] != (8, 2, 0, 0, 0) or n is None:
        raise ValueError("not an image of this store")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(size[1], UNIT + 1)
    if rows[:, 0].any():
        raise ValueError("row filter")
    return rows[:, 1:].tobytes(), n


def feature(payload: bytes) -> str:
    """Rows, mean, deviation and entropy of the samples, and the shares of eight value bands."""
    x = np.frombuffer(payload, np.uint8)
    count = np.bincount(x, minlength=256)
    p = count[count > 0] / len(x)
    bands = count.reshape(8, 32).sum(1) / len(x)
    total = int(count @ np.arange(256))
    square = int(count @ (np.arange(256, dtype=np.int64) ** 2))
    mean = total / len(x)
    return f"{len(x) // UNIT};{mean:.4f};{math.sqrt(max(0.0, square / len(x) - mean * mean)):.4f};{float(-(p * np.log2(p)).sum()):.4f};" + ",".join(f"{b:.4f}" for b in bands)


def write(docs: DataFrame, ws: Workspace, text: str = "text", key: str = "doc_id") -> str:
    """Stores every row's text as an image; returns the path of the manifest, a table of the archives' (path, size, members).

    A null text is empty; each row, repeated ones too, is a member of its own, named by its key (empty if null). A
    failed attempt's archives aren't in the table.
    """
    root = ws.path("media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)
        state: dict = {}

        def close() -> pa.RecordBatch:
            state["zip"].close()
            state["out"].close()
            return pa.RecordBatch.from_pydict({"path": [state["path"]], "size": [fs.get_file_info(state["at"]).size], "members": [state["n"]]}, pa.schema([("path", "string"), ("size", "int64"), ("members", "int64")]))

        for batch in batches:
            for b in slices(batch, "text"):
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if not state:
                        fs.create_dir(base, recursive=True)
                        name = f"{uuid.uuid4().hex}.zip"
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                        state = {"path": f"{root}/{name}", "at": f"{base}/{name}", "out": out, "zip": zipfile.ZipFile(out, "w", zipfile.ZIP_STORED), "n": 0, "bytes": 0}
                    data = (t or "").encode("utf-8", "surrogatepass")
                    png = to_png(pad(data), len(data))
                    state["zip"].writestr(zipfile.ZipInfo(f"{state['n']:09d}-{'' if k is None else k}.png"), png)
                    state["n"] += 1
                    state["bytes"] += len(png)
                    if state["bytes"] >= ROLL:
                        yield close()
                        state = {}
        if state:
            yield close()

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return ws.save(rows.mapInArrow(run, "path string, size long, members long"), "archives")


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start))
        self.path, self.start, self.end = path, start, end


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").option("manifest", table).load()``; the table is write()'s."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, key string, media binary, payload binary, n_bytes long, feature string, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.manifest, self.width = options["manifest"], int(options.get("width", RANGE))

    def partitions(self) -> list[Range]:
        """Byte ranges of the archives in the manifest; a row an archive reaches the driver, none a member."""
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector

        fs, base = filesystem(self.manifest)
        files = [f.path for f in fs.get_file_info(FileSelector(base)) if f.path.endswith(".parquet")]
        rows = [r for f in files for r in pq.read_table(f, filesystem=fs, columns=["path", "size"]).to_pylist()]
        return [Range(r["path"], s, min(s + self.width, r["size"])) for r in rows for s in range(0, r["size"], self.width)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, at = filesystem(part.path)
        with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            members = [m for m in z.infolist() if part.start <= m.header_offset < part.end]
        rows, held = [], 0
        for m in members:
            rows.append((part.path, m.header_offset, m.filename.partition("-")[2].removesuffix(".png"), *member(fs, at, m)))
            held += len(rows[-1][3] or b"") + len(rows[-1][4] or b"")
            if held >= BATCH:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["archive", "offset", "key", "media", "payload", "n_bytes", "feature", "error"])


def member(fs, path: str, m: zipfile.ZipInfo) -> tuple:
    """(media, payload, length, feature, error): one member by its offset, tried again by itself; a lasting fault is its own row's error."""
    why = ""
    for _ in range(ATTEMPTS):
        try:
            with fs.open_input_file(path) as f:
                f.seek(m.header_offset)
                head = f.read(30)
                if head[:4] != b"PK\3\4":
                    raise ValueError("no member begins here")
                f.seek(m.header_offset + 30 + sum(struct.unpack("<HH", head[26:30])))
                media = f.read(m.compress_size)
            if len(media) != m.file_size or zlib.crc32(media) != m.CRC:
                raise ValueError("member's CRC")
            payload, n = from_png(media)
            return media, payload, n, feature(payload), None
        except (OSError, ValueError, zlib.error, struct.error) as e:
            why = f"{type(e).__name__}: {e}"
    return None, None, None, None, why


def read(spark, manifest: str, width: int = RANGE) -> DataFrame:
    """Every member of the archives in a manifest: archive, offset, key, media, payload, n_bytes, feature, error."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("manifest", manifest).option("width", width).load()
