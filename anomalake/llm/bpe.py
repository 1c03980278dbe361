"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its last bytes hits a pattern, so documents that share a passage share its
chunks whatever stands before it. A chunk is encoded once, from its first white space to its last, and kept with the
parts of words at its ends. Each join of two chunks is then repaired: the word across it is encoded by itself, and
the library encodes it again between the neighbouring words of both chunks, as one string; the join holds only where
both encodings, and the ids at the chunks' ends, agree exactly. Where they don't, the window grows to the whole text.

Memory is bounded: a worker keeps the chunks used last, up to ``CHUNK_BYTES``, and the ids of two generations of words,
from which new chunks are put together (the library alone takes twice the time), some 100 MB at most. There is no shuffle: each input partition is encoded where it is read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: A cut after a byte where the 8-byte rolling hash has these bits zero: chunks of 1,024 bytes on average.
CUT_BITS = 10
#: Bytes of chunks that a task keeps, and characters given to the library at a time.
CHUNK_BYTES, BATCH = 8 << 20, 1 << 17
#: Words of a generation, some 200 bytes each; two are kept, and words that are met again move on to the newer one.
WORDS = 220_000
#: Bytes of text that are encoded, and go back to Spark, at a time.
SLICE = 2 << 20
#: Characters that Python counts as white space but the tokenizer's pattern doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]
SPACE = re.compile(r"\s")
#: Marks that may follow a word's letters.
MARKS = ".,;:!?%$#&*()[]\"/|-"


def cut_points(data: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Offsets after which the bytes are cut: a Gear-like rolling hash over 8 bytes, never inside a UTF-8 character."""
    if len(data) < 16:
        return np.zeros(0, np.int64)
    h = data.astype(np.uint32) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    for step in (1, 2, 4):  # by doubling: h covers 2, 4, 8 bytes
        h[step:] = h[step:] + (h[:-step] * np.uint32(pow(5, step)))
    h ^= h >> np.uint32(13)
    h *= np.uint32(2246822519)
    at = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    at = at[at < len(data)]
    return at[data[at] & 0xC0 != 0x80]


@dataclass(slots=True)
class Chunk:
    """What a chunk gives wherever it stands: ids of its whole words, and the parts of words at its ends."""

    head: str  # up to the first white space
    tail: str  # after the last one
    spaced: bool  # whether there is any
    ids: bytes
    first: str  # the whole words at the ends, and their ids
    last: str
    first_ids: bytes
    last_ids: bytes


def parted(text: str) -> tuple[str, str, str, bool]:
    """(head, what stands between the first and the last white space, tail, whether there is white space)."""
    m = SPACE.search(text)
    if not m:
        return text, "", "", False
    tail = "" if text[-1].isspace() else text.rsplit(None, 1)[-1]
    return text[: m.start()], text[m.start() : len(text) - len(tail)], tail, True


class Chunks:
    """A worker's memory: chunks by their bytes, of which those used longest ago go first, and words."""

    def __init__(self, most: int = CHUNK_BYTES):
        self.most, self.held, self._map = most, 0, OrderedDict()
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def get(self, raw: bytes) -> Chunk | None:
        got = self._map.get(raw)
        if got is not None:
            self._map.move_to_end(raw)
        return got

    def put(self, raw: bytes, chunk: Chunk) -> None:
        self._map[raw] = chunk
        self.held += self._size(raw, chunk)
        while self.held > self.most:
            self.held -= self._size(*self._map.popitem(last=False))

    @staticmethod
    def _size(raw: bytes, chunk: Chunk) -> int:
        return 800 + len(raw) + len(chunk.ids) + len(chunk.first_ids) + len(chunk.last_ids)  # with about 800 bytes of objects


class ChunkEncoder:
    """Encodes and decodes as tokenizers' encode(add_special_tokens=False) and decode(skip_special_tokens=False) do.

    Chunks are used for tokenizers that split on white space before merging, lower-case and have no decoder, which
    ``exact`` checks; for others whole texts go to the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = next((x for x in steps if x["type"] == "Split"), None)
        by_space = split is not None and split["behavior"] == "Removed" and split["invert"] and r"[^\s" in split["pattern"].get("Regex", "")
        self.exact = by_space and "Lowercase" in str(spec.get("normalizer")) and spec.get("decoder") is None and spec.get("post_processor") is None and not any(
            t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"]
        )
        vocab = self.lib.get_vocab(with_added_tokens=True)
        # letters and the marks after them are matched apart, and the marks listed belong to no other alternative or added token
        self.apart = self.exact and all(x in split["pattern"]["Regex"] for x in (r"|[\p{L}]+|", r"|[^\s\p{L}\p{N}]+")) and not any(t["content"][-1] in MARKS or t["content"].isalpha() for t in spec["added_tokens"])
        self.names = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.names[i] = token
        self.known = Chunks()
        self.reused = self.encoded = self.repaired = self.whole = 0

    def _library(self, strings: Iterable[str]) -> dict[str, bytes]:
        """The library's ids of each distinct string, some at a time as its encodings are large."""
        out: dict[str, bytes] = {}
        held: list[str] = []
        size = 0

        def give() -> None:
            for s, e in zip(held, self.lib.encode_batch_fast(held, add_special_tokens=False), strict=True):
                ids = e.ids
                out[s] = PACK[len(ids)](*ids) if len(ids) < 16 else struct.pack(f"<{len(ids)}I", *ids)

        for s in set(strings):
            held.append(s)
            size += len(s) + 16
            if size >= BATCH:
                give()
                held, size = [], 0
        if held:
            give()
        return out

    def _pieces(self, word: str) -> tuple[str, ...]:
        """A word's lower-cased letters and the marks after them, where the tokenizer surely encodes them apart; else the word."""
        core = word.rstrip(MARKS)
        if core and self.apart and core.isalpha() and (core.isascii() or "\u03a3" not in core and unicodedata.is_normalized("NFC", core)):
            return (core.lower(), word[len(core) :]) if len(core) < len(word) else (core.lower(),)
        return (word,)

    def _words(self, wanted: set[str], known: Chunks) -> dict[str, bytes]:
        """A map that has the ids of all the words."""
        if len(known.words) > WORDS:  # words of the generation before last are forgotten
            known.older, known.words = known.words, {}
        have, older = known.words, known.older
        wanted -= have.keys()
        have |= {w: older[w] for w in wanted & older.keys()}
        of = {w: self._pieces(w) for w in wanted - have.keys()}
        parts = {p for ps in of.values() for p in ps} - have.keys()
        have |= {p: older[p] for p in parts & older.keys()}
        have |= self._library(parts - have.keys())
        for w, ps in of.items():
            have[w] = have[ps[0]] + have[ps[1]] if len(ps) == 2 else have[ps[0]]
        return have

    def _chunks(self, wanted: list[bytes], known: Chunks) -> dict[bytes, Chunk]:
        """The chunk of each of the byte strings; the new ones are encoded together."""
        out: dict[bytes, Chunk] = {}
        new: dict[bytes, tuple] = {}
        for raw in wanted:
            if raw in out or raw in new:
                self.reused += 1
            elif (got := known.get(raw)) is not None:
                out[raw] = got
                self.reused += 1
            else:
                head, inner, tail, spaced = parted(raw.decode("utf-8", "surrogatepass"))
                new[raw] = head, inner.split(), tail, spaced
                self.encoded += 1
        ids = self._words(set().union(*(words for _, words, _, _ in new.values())), known)
        for raw, (head, words, tail, spaced) in new.items():
            first, last = (words[0], words[-1]) if words else ("", "")
            out[raw] = Chunk(head, tail, spaced, b"".join([ids[w] for w in words]), first, last, ids[first] if words else b"", ids[last] if words else b"")
            known.put(raw, out[raw])
        return out

    def encode_all(self, texts: list[str], known: Chunks) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut: list[list[bytes] | None] = []
        for text in texts:
            if not self.exact or ODD_SPACE.search(text):
                cut.append(None)
                continue
            raw = f" {text} ".encode("utf-8", "surrogatepass")  # so that the words at the text's ends are whole
            at = cut_points(np.frombuffer(raw, np.uint8)).tolist()
            cut.append([raw[a:b] for a, b in zip([0, *at], [*at, len(raw)], strict=True)])
        chunk = self._chunks([raw for parts in cut if parts for raw in parts], known)
        joins: list[list[tuple[Chunk | None, str, str, Chunk]] | None] = []
        for parts in cut:
            if parts is None:
                joins.append(None)
                continue
            own, left, window = [], None, ""
            for c in (chunk[raw] for raw in parts):
                window += c.head
                if c.spaced:
                    around = " ".join(x for x in (left.last if left else "", window, c.first) if x)
                    own.append((left, window, around, c))
                    left, window = c, c.tail
            joins.append(own)
        spans = [(window, around) for own in joins if own for left, window, around, _ in own if left]
        words = self._words({w for w, _ in spans if w}, known)
        whole = self._library(x for _, x in spans if x)
        words[""] = whole[""] = b""
        out = []
        for text, own in zip(texts, joins, strict=True):
            found = [] if own is not None else None
            for left, window, around, c in own or ():
                if left is not None:
                    self.repaired += 1
                    if whole[around] != left.last_ids + words[window] + c.first_ids or not left.ids.endswith(left.last_ids) or not c.ids.startswith(c.first_ids):
                        found = None
                        break
                    found.append(words[window])
                found.append(c.ids)
            if found is None:
                self.whole += 1
                out.append(self._library([text])[text])
            else:
                out.append(b"".join(found))
        return out

    def encode(self, text: str) -> bytes:
        """One text's ids."""
        return self.encode_all([text], Chunks())[0]

    def decode(self, ids: bytes) -> str:
        names = self.names
        if not self.exact:
            return self.lib.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file, with what it keeps between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Adds ``ids`` (array of int) and, if a name is given, the decoded text, to every row.

    A null or empty text has no ids. Repeated rows and ties are encoded alike; an empty table stays empty. Columns
    of those names are replaced, all others are kept.
    """
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).schema.add(ids, ArrayType(IntegerType()))
    if decoded:
        schema = schema.add(decoded, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for b in slices(batch, text, SLICE):
                got = enc.encode_all([t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()], enc.known)
                ends = np.cumsum([0, *(len(g) // 4 for g in got)]).astype(np.int32)
                cols = [*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32)))]
                if decoded:
                    cols.append(pa.array([enc.decode(g) for g in got], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, ids, *([decoded] if decoded else [])])

    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text, one row at least, to bound memory."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, through the same encoder; only these leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                got = enc.encode_all([t or "" for t in b.column(1).to_pylist()], enc.known)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array([len(g) // 4 for g in got], pa.int64()),
                        pa.array([hashlib.sha256(g).hexdigest() for g in got], pa.string()),
                        pa.array([hashlib.sha256(enc.decode(g).encode()).hexdigest() for g in got], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
