"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of words (runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased). A
document holds a benchmark item where a window of its words is within ``tolerance`` times the item's length of it in
edit distance. The CGK random walk turns that into a Hamming distance: at each step a walk writes the word it stands
on and goes on to the next one if a random bit of (step, word) says so, so two walks that an edit has parted meet
again. Repetitions with different bits sample a few steps each; equal samples propose a pair, and a semi-global
edit distance decides it.

Walks start only where a match is possible at all: an edit destroys at most q of a sequence's q-grams, so a window
with too few of the items' q-grams holds none of them. That filter is exact and costs a table look-up a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomalake.llm import textvec
from anomalake.llm.bpe import slices

_U = np.uint64
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True
#: Repetitions, and steps sampled in each.
REPEATS, SAMPLED = 40, 3
#: Items that go with the tasks in one pass; a larger benchmark takes a pass over the documents for each such block.
ITEMS = 20_000
#: A filter has 64 places for each q-gram, up to this many bits of hash; and bytes of text that are matched at a time.
FILTER_BITS, SLICE = 22, 2 << 20


def word_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' words, for each text where its words begin, and the end)."""
    raw = [textvec.utf8(t) for t in texts]
    sep = np.full(1, 32, np.uint8)
    data = textvec.LOWER[np.concatenate([x for r in raw for x in (r, sep)] or [sep])]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = IN_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return textvec.span_hash(textvec.prefix_hash(data), start, end), np.searchsorted(start, begin)


def grams(w: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q words from each place on; shorter by q - 1."""
    if len(w) < q:
        return w[:0]
    acc = np.full(len(w) - q + 1, q, _U)
    for j in range(q):
        acc = textvec.mix(acc + w[j : len(w) - q + 1 + j])
    return acc


@dataclass
class Group:
    """Items of like length: they share windows, walks and a filter."""

    q: int
    need: int  # q-grams of the items that a window with a match has at least
    span: int  # its longest possible match, in words
    steps: int
    shift: int  # of a q-gram's hash, to its place in the filter
    table: np.ndarray  # filter
    keys: list[tuple[np.ndarray, np.ndarray]]  # per repetition: sorted keys, items


def allowed(n: int, tolerance: float) -> int:
    return int(tolerance * n + 1e-9)


def plan(n: int, tolerance: float) -> tuple[int, int]:
    """(q, q-grams that survive the allowed edits) for an item of n words, with the longest q of 1 to 3 that leaves some."""
    d = allowed(n, tolerance)
    for q in (3, 2, 1):
        if (need := n - q + 1 - q * d) >= max(1, n // 8):
            return q, need
    return 1, max(1, n - d)


def _bits(sym: np.ndarray, repeat: int, block: int) -> np.ndarray:
    """64 steps' random bits for each word."""
    return textvec.mix(sym + _U(repeat * 1_000_003 + block * 7919 + 1))


def cgk_keys(w: np.ndarray, at: np.ndarray, stop: np.ndarray, steps: int, repeat: int) -> np.ndarray:
    """A key a start: the words that the walk from there writes at the repetition's sampled steps; walks end at ``stop``."""
    pick = np.random.Generator(np.random.PCG64(1000 + repeat)).choice(steps, min(SAMPLED, steps), replace=False)
    chosen, i, acc = set(pick.tolist()), at.copy(), np.full(len(at), repeat + 1, _U)
    for j in range(max(chosen) + 1):
        sym = np.where(i < stop, w[np.minimum(i, len(w) - 1)], _U(0))
        if j in chosen:
            acc = textvec.mix(acc + sym * _U(2 * j + 1))
        i = i + ((_bits(sym, repeat, j // 64) >> _U(j % 64)) & _U(1)).astype(np.int64)
    return acc


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of the item to any window of the text, that window's end); rows of the table are vectors."""
    row = np.zeros(len(text) + 1, np.int64)
    step = np.arange(len(text) + 1)
    for k, x in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = k
        np.minimum(row[:-1] + (text != x), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - step) + step
    end = int(row.argmin())
    return int(row[end]), end


class Index:
    """The items' keys, filters and words."""

    def __init__(self, items: list[tuple[int, str | None]], tolerance: float):
        self.tolerance = tolerance
        stream, begin = word_stream([t for _, t in items])
        self.words = {i: stream[a:b] for (i, _), a, b in zip(items, begin[:-1], begin[1:], strict=True) if b > a}
        by: dict[tuple, list[int]] = {}
        for i, w in self.words.items():
            by.setdefault((plan(len(w), tolerance)[0], int(np.log(len(w)) / np.log(1.3))), []).append(i)
        self.groups = []
        for (q, _), ids in sorted(by.items()):
            size = [len(self.words[i]) for i in ids]
            bits = min(FILTER_BITS, 6 + sum(size).bit_length())
            table = np.zeros(1 << bits, bool)
            for i in ids:
                table[grams(self.words[i], q) >> _U(64 - bits)] = True
            steps = max(1, int(1.5 * min(size)))
            all_words = np.concatenate([self.words[i] for i in ids])
            ends = np.cumsum(size)
            keys = []
            for r in range(REPEATS):
                k = cgk_keys(all_words, ends - size, ends, steps, r)
                order = np.argsort(k, kind="stable")
                keys.append((k[order], np.array(ids)[order]))
            need = min(max(1, n - q + 1 - q * allowed(n, tolerance)) for n in size)
            self.groups.append(Group(q, need, max(n + allowed(n, tolerance) for n in size), steps, 64 - bits, table, keys))

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text's number, item, distance, first and last word's place in the text): the nearest window for each text and item."""
        w, begin = word_stream(texts)
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not len(w):
            return []
        owner = np.repeat(np.arange(len(texts)), np.diff(begin))
        hashed: dict[int, np.ndarray] = {}
        for g in self.groups:
            if g.q not in hashed:
                hashed[g.q] = grams(w, g.q)
            hit = np.concatenate([g.table[hashed[g.q] >> _U(g.shift)], np.zeros(g.q - 1 if len(w) >= g.q else len(w), bool)])
            total = np.concatenate([[0], np.cumsum(hit)])
            n = len(w)
            ahead = total[np.minimum(np.arange(n) + max(1, g.span - g.q + 1), n)] - total[:n]
            at = np.flatnonzero(ahead >= g.need)
            if not len(at):
                continue
            stop = begin[owner[at] + 1]
            pairs: set[tuple[int, int, int]] = set()
            for r, (keys, ids) in enumerate(g.keys):
                k = cgk_keys(w, at, stop, g.steps, r)
                lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
                for x in np.flatnonzero(hi > lo).tolist():
                    for i in ids[lo[x] : hi[x]].tolist():
                        pairs.add((int(owner[at[x]]), i, int(at[x]) // g.span))
            for t, i, place in sorted(pairs):
                item = self.words[i]
                best = out.get((t, i))
                if best and best[0] == 0:
                    continue
                a, b = max(int(begin[t]), (place - 1) * g.span), min(int(begin[t + 1]), (place + 3) * g.span)
                d, end = distance(item, w[a:b])
                if d <= allowed(len(item), self.tolerance) and (best is None or (d, a + end) < (best[0], best[2])):
                    out[t, i] = (d, max(a, a + end - len(item)), a + end)
        return [(t, i, d, a - int(begin[t]), b - int(begin[t])) for (t, i), (d, a, b) in sorted(out.items())]


def find(docs: DataFrame, benchmark: DataFrame, tolerance: float = 0.2, key: str = "doc_id", text: str = "text", item: str = "item_id", block: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, distance, n_words, first_word, last_word): a row for each document row and item it holds.

    Null and empty texts and items match nothing; items with a null id are left out, of items with one id the
    smallest text counts. Document rows with a null id give matches with a null id; repeated rows give theirs each.
    Items go with the tasks ``block`` at a time; a larger benchmark is matched in several passes.
    """
    items = benchmark.select(F.col(f"`{item}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).filter("i is not null and t is not null").groupBy("i").agg(F.min("t").alias("t"))
    n = items.count()
    passes = max(1, -(-n // block))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = "doc_id long, item_id long, distance int, n_words int, first_word int, last_word int"
    out = None
    for p in range(passes):
        own = items.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == p).orderBy("i").collect() if n else []
        index = Index([(r.i, r.t) for r in own], tolerance)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch, "text", SLICE):
                    ids = b.column(0).to_pylist()
                    got = index.matches(b.column(1).to_pylist())
                    if got:
                        cols = list(zip(*((ids[t], i, d, len(index.words[i]), a, e) for t, i, d, a, e in got), strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 2 + [pa.int32()] * 4, strict=True)], names=["doc_id", "item_id", "distance", "n_words", "first_word", "last_word"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, tolerance: float = 0.2, text: str = "text", block: int = ITEMS) -> DataFrame:
    """The rows that hold no item, with their columns as they are; null texts stay.

    Every distinct text of the benchmark is an item, whatever its id, and a row is judged by its text alone. Items
    go with the tasks ``block`` at a time; a larger benchmark marks the texts that hold an item in several passes.
    """
    items = benchmark.select(F.col(f"`{text}`").alias("t")).filter("t is not null").distinct()
    passes = max(1, -(-items.count() // block))

    def index_of(p: int) -> Index:
        own = items.filter(F.pmod(F.xxhash64("t"), F.lit(passes)) == p).orderBy("t").collect()
        return Index([(i, r.t) for i, r in enumerate(own)], tolerance)

    def holding(rows: DataFrame, index: Index, bad: bool) -> DataFrame:
        """The rows that hold an item of the index, or those that don't."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in slices(batch, text, SLICE):
                    found = {t for t, *_ in index.matches(b.column(b.schema.get_field_index(text)).to_pylist())}
                    yield b.filter(pa.array([(i in found) == bad for i in range(b.num_rows)], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    if passes == 1:
        return holding(docs, index_of(0), False)
    digest = F.sha2(F.col(f"`{text}`").cast("binary"), 256).alias("_text_sha256")
    texts, gone = docs.select(F.col(f"`{text}`")), None
    for p in range(passes):
        part = holding(texts, index_of(p), True).select(digest)
        gone = part if gone is None else gone.unionByName(part)
    return docs.withColumn("_text_sha256", digest).join(gone.distinct(), "_text_sha256", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
