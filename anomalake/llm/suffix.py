"""Exact substring deduplication over suffix arrays built with a difference cover, distributed by anchors.

Every byte covered by a string of ``length`` bytes that starts more than once goes. One suffix array of the whole
corpus would have to be sorted through the shuffle level by level; here the suffixes are dealt out first, so that
equal strings always meet: a string's anchor is its smallest k-gram hash (winnowing), equal strings have equal
anchors at the same place, and an anchor that occurs once in the corpus needs no look at all. For anchors that
repeat, the bytes around them, the strings they are the anchor of, are grouped by anchor. Each group's suffix array
is built by the difference-cover algorithm (the triples at two of three places are sorted and named, names that
repeat are sorted by recursion, the remaining suffixes are merged in), and neighbours in it whose ``length``-byte
prefixes agree, byte by byte, mark each other. Pieces that are equal as a whole mark each other before any sorting.

A document has one row for all places of a piece, so text that repeats itself does not multiply rows. An anchor with
more occurrences than a group holds is hot. Its equal pieces are counted first, with partial counts before the shuffle;
where more distinct ones are left than a group holds, the strings of those are dealt out again by more of what equal
ones have in common: those whose anchor stands at nearly the same place share the bytes around it. Classes get narrower
level by level, down to single strings, and every level sorts its groups in the same way. Only distinct pieces go through
the levels; their documents meet them once, at the end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomalake.llm import textvec
from anomalake.llm.bpe import slices
from anomalake.llm.store import Workspace

_U = np.uint64
#: Bytes of an anchor's k-gram; pieces of an anchor up to which it is one group; bytes sorted at a time.
GRAM, HOT, CHUNK = 48, 1000, 1 << 18
#: Places of the anchor that a hot anchor's strings have in common, level by level; the last is one string.
WIDTHS = (77, 20, 1)
#: Hot keys, and rows of their flagged pieces, up to which they are broadcast (8 and some 400 bytes each); parts that a hot key is salted into beyond.
BROADCAST_KEYS, BROADCAST_PIECES, SALT = 200_000, 10_000, 16
#: Rows up to which the spans found are broadcast to the documents (some 100 bytes each, and that held several times over); beyond, they are joined by shuffle.
BROADCAST_SPANS = 200_000


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of non-negative integers, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 6, np.int32 if n < 1 << 31 and s.max() < (1 << 31) - 2 else np.int64)
    t[:n] = s
    t[:n] += 1
    width = int(t.max()) + 1
    if width >= 1 << 21:  # so that three symbols fit one key
        values, t[:n] = np.unique(t[:n], return_inverse=True)
        t[:n] += 1
        width = len(values) + 1
    at = np.concatenate([np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)])  # one place beyond the end keeps the merge uniform
    at = at[at < n + (n % 3 == 1)]
    w = _U(width)
    key = (t[at].astype(_U) * w + t[at + 1].astype(_U)) * w + t[at + 2].astype(_U)
    order = np.argsort(key, kind="stable")
    key = key[order]
    name = np.empty(len(at), np.int32 if len(at) < 1 << 31 else np.int64)
    name[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    del key
    if name.max() + 1 < len(at):  # names repeat: sort the string of names
        del order
        order = suffix_array(name)
    del name
    sampled = at[order]
    del at, order
    m = len(sampled)
    rank = np.zeros(n + 4, np.int64)
    rank[sampled] = np.arange(1, m + 1)
    sampled = sampled[sampled < n]
    # the others, by (symbol, rank of the next suffix)
    pad, r = t.astype(_U), rank.astype(_U)
    del t, rank
    zero = np.arange(0, n, 3)
    big = _U(m + 2)
    k0 = pad[zero] * big + r[zero + 1]
    zero, k0 = (x[np.argsort(k0, kind="stable")] for x in (zero, k0))
    # merge: where each sampled suffix stands among the others, by keys that compare the two
    is_one = sampled % 3 == 1
    s1, s2 = sampled[is_one], sampled[~is_one]
    before = np.empty(len(sampled), np.int64)
    before[is_one] = np.searchsorted(k0, pad[s1] * big + r[s1 + 1], "left")
    two_key = _pair(pad[zero], pad[zero + 1], r[zero + 2], w, big)
    before[~is_one] = np.searchsorted(two_key, _pair(pad[s2], pad[s2 + 1], r[s2 + 2], w, big), "left")
    out = np.empty(n, np.int64)
    place = before + np.arange(len(sampled))
    out[place] = sampled
    free = np.ones(n, bool)
    free[place] = False
    out[free] = zero
    return out


def _pair(a: np.ndarray, b: np.ndarray, r: np.ndarray, w: np.uint64, big: np.uint64) -> np.ndarray:
    """(a, b, r) as one comparable key: an integer where it fits, else bytes in comparing order."""
    if int(w) * int(w) * int(big) < 1 << 64:
        return (a * w + b) * big + r
    cells = np.empty((len(a), 3), ">u8")
    cells[:, 0], cells[:, 1], cells[:, 2] = a + _U(1), b + _U(1), r + _U(1)  # never zero, as trailing zero bytes don't count
    cells[:, 2] = cells[:, 2] * _U(2) + _U(1)
    return np.ascontiguousarray(cells).view("S24").ravel()


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first, last start) of every anchor: the strings of ``length`` bytes of a text starting in [first, last] have it."""
    none = np.zeros(0, np.int64)
    ok = end - begin >= length
    if not ok.any():
        return none.astype(_U), none, none, none
    k = min(GRAM, length)
    prefix = textvec.prefix_hash(data)
    n = len(data) - k + 1
    place = np.arange(n)
    h = textvec.span_hash(prefix, place, place + k)
    bits = max(8, int(n).bit_length())
    # the smallest hash, the last of equal ones: the place in the low bits, reversed
    low = (h >> _U(bits) << _U(bits)) | ((1 << bits) - 1 - place).astype(_U)
    span = length - k + 1  # k-grams of a string
    have = 1
    while have < span:  # the minimum over 2, 4, 8, .. and at last ``span`` places
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    at = ((1 << bits) - 1) - (low & _U((1 << bits) - 1)).astype(np.int64)
    # string starts inside one text
    count = np.where(ok, end - begin - length + 1, 0)
    text = np.repeat(np.arange(len(begin)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[text]
    own = at[start]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:] - 1, [len(own) - 1]])
    return h[own[new]], text[new], start[new] - begin[text[new]], start[last] - begin[text[new]]


def _laid(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [textvec.utf8(t) for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    end = np.cumsum(size)
    return (np.concatenate(raw) if raw else np.zeros(0, np.uint8)), end - size, end


def find_anchors(docs: DataFrame, length: int) -> DataFrame:
    """(h, id, first, last) of all documents' anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                ids = b.column(0).to_numpy(zero_copy_only=False)
                h, t, a, z = anchors(*_laid(b.column(1).to_pylist()), length)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[t]), pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))], names=["h", "id", "first", "last"])

    return docs.mapInArrow(run, "h long, id long, first int, last int")


def repeated_starts(data: np.ndarray, begin: np.ndarray, count: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Of the strings that start at begin, begin + 1, .. (count of them), whether another of its group equals it; in that order.

    ``data`` holds the pieces one after another, each of count + length - 1 bytes.
    """
    which = np.repeat(np.arange(len(begin)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[which]
    valid = np.full(len(data), -1, np.int64)
    valid[start] = np.arange(len(start))
    order = valid[suffix_array(data)]
    order = order[order >= 0]
    at = start[order]
    # neighbours of one group: a hash of their prefixes says which to compare
    prefix = textvec.prefix_hash(data)
    h = textvec.span_hash(prefix, at, at + length)
    near = np.flatnonzero((h[1:] == h[:-1]) & (group[which[order[1:]]] == group[which[order[:-1]]]))
    near = near[equal(data, at[near], at[near + 1], length)]
    out = np.zeros(len(start), bool)
    out[order[near + 1]] = True
    out[order[near]] = True
    return out


def equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from a are those from b, place by place."""
    out = np.zeros(len(a), bool)
    if len(a):
        view = np.lib.stride_tricks.sliding_window_view(data, length)
        for i in range(0, len(a), 8192):
            out[i : i + 8192] = (view[a[i : i + 8192]] == view[b[i : i + 8192]]).all(1)
    return out


def _flags(pieces: list[tuple[int, bytes]], times: np.ndarray, length: int) -> list[tuple[int, int] | None]:
    """The bytes (from, to) of each distinct piece (group, bytes) that repeated strings cover, where it occurs ``times`` times in its group.

    They are one span: a piece's strings share an anchor, so they start within ``length`` bytes and overlap or touch.
    """
    group = np.array([h for h, _ in pieces], np.int64)
    _, at, size = np.unique(group, return_inverse=True, return_counts=True)
    out = [(0, len(p)) if n > 1 else None for (_, p), n in zip(pieces, times.tolist(), strict=True)]  # equal pieces repeat as a whole
    todo = np.flatnonzero(size[at] > 1)
    if len(todo):
        n = np.array([len(pieces[i][1]) for i in todo], np.int64)
        count = n - length + 1
        flag = repeated_starts(np.frombuffer(b"".join(pieces[i][1] for i in todo), np.uint8), np.cumsum(n) - n, count, group[todo], length)
        for i, f in zip(todo.tolist(), np.split(flag, np.cumsum(count)[:-1]), strict=True):
            starts = np.flatnonzero(f)
            if out[i] is None and len(starts):
                out[i] = int(starts[0]), int(starts[-1]) + length
    return out


def _by_group(solve):
    """Hands rows (h first, piece last) sorted by h to solve, whole groups at a time of about CHUNK bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, key = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key and size >= CHUNK:  # groups are never parted
                    yield solve(held)
                    held, size = [], 0
                key = row[0]
                held.append(row)
                size += len(row[-1])
        if held:
            yield solve(held)

    return run


def _sorted_groups(length: int):
    """Takes pieces (h, id, firsts, piece) sorted by h; yields the spans (id, a, b) that repeat within whole groups of one h."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        which: dict[tuple[int, bytes], int] = {}
        of = [which.setdefault((r[0], r[3]), len(which)) for r in rows]
        times = np.bincount(of, [len(r[2]) for r in rows], len(which)).astype(np.int64)
        spans = _flags(list(which), times, length)
        return _spans((row[1], row[2], *spans[i]) for row, i in zip(rows, of, strict=True) if spans[i])

    return _by_group(solve)


def _spans(found: Iterable[tuple[int, list[int], int, int]]) -> pa.RecordBatch:
    """The spans (id, a, b) of (id, firsts, from, to), those of one row as maximal runs."""
    out = [(i, *x) for i, firsts, a, b in found for x in runs([(f + a, f + b) for f in firsts])]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["id", "a", "b"])


def _counted_groups(length: int):
    """Takes distinct pieces (h, n, piece) sorted by h; yields those with a span that repeats, and its places."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        spans = _flags([(r[0], r[2]) for r in rows], np.array([r[1] for r in rows]), length)
        out = [(r[0], r[2], *x) for r, x in zip(rows, spans, strict=True) if x]
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["h", "piece", "a", "b"])

    return _by_group(solve)


def repeated_spans(docs: DataFrame, ws: Workspace, length: int) -> DataFrame:
    """(id, a, b): spans that cover exactly the bytes of every string that starts more than once; spans may overlap."""
    found = ws.table(find_anchors(docs, length), "anchors")
    often = ws.table(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    hot = often.filter(F.col("n") > HOT).select("h")
    n_hot = hot.count()
    # hot anchors keep out of the join by anchor: none of its keys has more than HOT rows
    rest, some = found, None
    if n_hot:
        few = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot.hint("merge")
        rest, some = found.join(few, "h", "left_anti"), found.join(few, "h", "left_semi").withColumn("hot", F.lit(True))
    keys = often.filter(F.col("n") <= HOT).select("h")
    keys = F.broadcast(keys) if often.count() - n_hot <= BROADCAST_KEYS else keys.hint("merge")  # a million keys hold hundreds of MB of the driver
    cold = rest.join(keys, "h", "left_semi").withColumn("hot", F.lit(False))
    marks = cold if some is None else cold.unionByName(some)
    by_doc = marks.groupBy("id").agg(F.collect_list(F.struct("h", "first", "last", "hot")).alias("marks"))  # as many as the document is long
    k = min(GRAM, length)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for i, t, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    raw = t.encode("utf-8", "surrogatepass")
                    hashed = textvec.prefix_hash(np.frombuffer(raw, np.uint8)) if any(m["hot"] for m in marks) else None
                    places: dict[tuple[int, bytes], list[int]] = {}
                    for m in marks:
                        piece = raw[m["first"] : m["last"] + length]
                        if (firsts := places.get((m["h"], piece))) is not None:
                            firsts.append(m["first"])
                            continue
                        places[m["h"], piece] = firsts = [m["first"]]
                        at = None
                        if m["hot"]:  # the anchor's place in the piece: the last of its k-gram in the first string
                            s = np.arange(m["last"], m["first"] + length - k + 1)
                            at = int(s[textvec.span_hash(hashed, s, s + k).view(np.int64) == m["h"]][-1]) - m["first"]
                        for c, v in zip(out, (m["h"], i, firsts, at, m["hot"], piece), strict=True):
                            c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["h", "id", "firsts", "at", "hot", "piece"])

    cut = docs.join(by_doc, "id").select("id", "text", "marks").mapInArrow(pieces, "h long, id long, firsts array<int>, at int, hot boolean, piece binary")
    cut = ws.table(cut, "pieces")
    dealt = cut.filter("not hot").select("h", "id", "firsts", "piece").repartition("h").sortWithinPartitions("h")
    spans = dealt.mapInArrow(_sorted_groups(length), "id long, a int, b int")
    if n_hot:
        spans = spans.unionByName(_hot_spans(cut.filter("hot").drop("hot"), ws, length))
    return ws.table(spans, "spans")


def _hot_spans(rows: DataFrame, ws: Workspace, length: int) -> DataFrame:
    """(id, a, b) of hot anchors' pieces (h, id, firsts, at, piece)."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _spans(zip(*(c.to_pylist() for c in batch.columns), strict=True))

    pieces = rows.groupBy("h", "piece").agg(F.sum(F.size("firsts")).alias("n"), F.min("at").alias("at"))  # equal pieces have it at one place
    pieces = ws.table(pieces.withColumn("top", F.monotonically_increasing_id()), "distinct")  # written once, so the ids hold
    spans = _levels(pieces.withColumn("off", F.lit(0)), ws, length).groupBy("top").agg(F.min("a").alias("a"), F.max("b").alias("b"))  # one span a piece
    spans = ws.table(pieces.join(spans.hint("merge"), "top").select("h", "piece", "a", "b"), "flagged")
    return _meet(rows, spans, "id").select("id", "firsts", "a", "b").mapInArrow(placed, "id long, a int, b int")


def _meet(rows: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """The rows whose piece is one of spans (h, piece, a, b; each piece once), with its span: at most one row a row."""
    if spans.count() <= BROADCAST_PIECES:
        return rows.join(F.broadcast(spans), ["h", "piece"])
    # a piece may be that of a third of all rows: its rows are dealt out, its span copied to each part
    salted = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    # by shuffle whatever the planner makes of its size: files of like pieces are small, and a broadcast goes through the driver
    return rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int")).join(salted.hint("merge"), ["h", "piece", "salt"])


def _levels(parts: DataFrame, ws: Workspace, length: int) -> DataFrame:
    """(top, a, b): spans of the distinct pieces that parts (h, piece, n, at, top, off) are of, level by level; all of one piece overlap or touch.

    A part stands at off in its piece top, which occurs n times; its anchor stands at at there.
    """
    found = None
    for width in (*(w for w in WIDTHS if w <= length), 0):  # wider classes' strings need not hold a byte in common
        distinct = parts.select("h", "n", "piece")
        if found is not None:  # strings of several pieces can be equal
            distinct = ws.table(distinct.groupBy("h", "piece").agg(F.sum("n").alias("n")).select("h", "n", "piece"), "counted")
        large = distinct.groupBy("h").agg(F.count("*").alias("d")).filter(F.col("d") > HOT).select("h")
        n_large = large.count() if width else 0  # of one string there is one piece
        few = F.broadcast(large) if n_large <= BROADCAST_KEYS else large.hint("merge")
        small = distinct.join(few, "h", "left_anti") if n_large else distinct
        solved = small.repartition("h").sortWithinPartitions("h").mapInArrow(_counted_groups(length), "h long, piece binary, a int, b int")
        met = _meet(parts, ws.table(solved, "solved"), "top").select("top", (F.col("off") + F.col("a")).alias("a"), (F.col("off") + F.col("b")).alias("b"))
        found = met if found is None else found.unionByName(met)
        if not n_large:
            break
        parts = parts.join(few, "h", "left_semi").select("h", "n", "top", "off", "at", "piece").mapInArrow(_classes(width, length), "h long, n long, top long, off int, at int, piece binary")
        parts = ws.table(parts, "classes")
    return found


def _classes(width: int, length: int):
    """Parts pieces into strings whose anchor stands at one of ``width`` places, keyed by what all such strings hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for h, n, top, first, at, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashed = textvec.prefix_hash(np.frombuffer(piece, np.uint8))
                last = first + len(piece) - length
                for r in range((at - last) // width, (at - first) // width + 1):
                    x, y = max(first, at - r * width - width + 1), min(last, at - r * width)  # the class's strings in this piece
                    common = np.array([at - r * width - first]), np.array([at - r * width - width + 1 + length - first])
                    key = textvec.mix(textvec.span_hash(hashed, *common) + _U(h % (1 << 64)) * _U(31) + _U(r * 1000 + width))
                    for c, v in zip(out, (int(key.view(np.int64)[0]), n, top, x, at, piece[x - first : y - first + length]), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["h", "n", "top", "off", "at", "piece"])

    return run


def runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans merged into maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed(n: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of spans in n bytes."""
    return [(a, min(b, n)) for a, b in runs(spans)]


def deduplicate(docs: DataFrame, ws: Workspace, length: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every row's bytes without those covered by a repeated string.

    Null texts are empty. Repeated rows, null ids and ids that several rows share are fine: rows are told apart by an
    id of their own then. Strings never cross documents; texts shorter than ``length`` lose nothing.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    shared = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").limit(1).count()
    if shared:
        rows = ws.table(rows.withColumn("id", F.monotonically_increasing_id()), "rows")  # written once, so the ids hold
    else:
        rows = rows.withColumn("id", F.col("doc_id"))
    spans = repeated_spans(rows.select("id", "text"), ws, length)
    n = spans.count()
    by = spans.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                out: tuple[list, ...] = ([], [], [], [])
                for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    raw = t.encode("utf-8", "surrogatepass")
                    gone = removed(len(raw), [(s["a"], s["b"]) for s in spans or []])
                    kept, at = [], 0
                    for x, y in gone:
                        kept.append(raw[at:x])
                        at = y
                    kept.append(raw[at:])
                    for c, v in zip(out, (len(raw), sum(y - x for x, y in gone), len(gone), b"".join(kept)), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    with_spans = rows.join(F.broadcast(by) if n <= BROADCAST_SPANS else by, "id", "left").select("doc_id", "text", "spans")
    return with_spans.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
