"""Near-duplicate documents: MinHash bands propose pairs, odd sketches screen them, full sets confirm them.

240 MinHash samples of a document's shingle set are cut into 40 bands of 6; sets of similarity 0.8 share a band but
for 5 in a million cases. The samples are also folded into an odd sketch: a parity bitmap of 1024 bits, where a
sample flips one bit. The population count of two sketches' XOR estimates how many samples differ, precisely where
few do, so one comparison of 128 bytes stands for 240. What passes is confirmed on the full sets.

No bucket is expanded into its pairs. Equal sets become one class first. Each class is linked with one leader of its
buckets; only then, and only between different components, are the rest of a bucket's members compared, in blocks
of bounded size. A block proposes the nearest few pairs of two components, as one link joins them; where it had more
than those, the two components, if they are still apart, are compared in full on their sets, in blocks again, so no
link is lost to a limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomalake.llm import textvec
from anomalake.llm.bpe import slices
from anomalake.llm.graph import components
from anomalake.llm.store import Workspace

ROWS, BANDS, BITS = 6, 40, 1024
SAMPLES = ROWS * BANDS
#: Members of a bucket or component that one block holds of each side, and pairs of two components that a block proposes.
BLOCK, PARTNERS = 500, 4
#: The same for blocks that hold full sets.
SETS = 500
#: Node ids up to which the list of documents to confirm is broadcast (8 bytes each); beyond, it is joined by shuffle.
BROADCAST_IDS = 2_000_000

_rng = np.random.Generator(np.random.PCG64(97))
_MUL = (_rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_XOR = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]


def most_differing(similarity: float) -> int:
    """The XOR population count that sketches of sets this similar exceed almost never: that of a similarity lower by 0.12."""
    differ = 2 * SAMPLES * (1 - similarity + 0.12)
    return int(BITS / 2 * (1 - np.exp(-2 * differ / BITS)))


def samples(sh: np.ndarray) -> np.ndarray:
    """The set's minimum under each of the hash functions."""
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    h = (sh >> np.uint64(32)).astype(np.uint32) ^ sh.astype(np.uint32)
    for i in range(0, len(h), 512):  # a block that stays in the processor's cache
        x = (h[None, i : i + 512] ^ _XOR) * _MUL
        np.minimum(low, x.min(1), out=low)
    return low


def odd_sketch(low: np.ndarray) -> bytes:
    at = textvec.mix(low.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def band_keys(low: np.ndarray) -> np.ndarray:
    m = low.reshape(BANDS, ROWS).astype(np.uint64)
    acc = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        acc = textvec.mix(acc + m[:, j] * np.uint64(0x9E3779B97F4A7C15))
    return acc.view(np.int64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return textvec.shingles(textvec.word_hashes(textvec.utf8(text)), size)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """id, n, key (of the whole set), bands and odd sketch of every row (id, text); no bands where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                n, key, bands, odd = [], [], [], []
                for t in b.column(1).to_pylist():
                    s = shingle_set(t, size)
                    n.append(len(s))
                    if not len(s):
                        key.append(None), bands.append(None), odd.append(None)
                        continue
                    low = samples(s)
                    key.append(s.sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(textvec.mix(s)).tobytes())
                    bands.append(band_keys(low))
                    odd.append(odd_sketch(low))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.binary())], names=["id", "n", "key", "bands", "odd"])

    return docs.mapInArrow(run, "id long, n long, key binary, bands array<long>, odd binary")


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    some = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), size)
    left = pairs.join(some.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")
    return left.join(some.select(F.col("id").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, id, lead) of the members that sorted (bucket, id) shows not to be alone; the lead is the first of its run.

    The first and last run of a partition are passed on whatever their length, as they may go on in another one, where
    they have another lead; a bucket's leads meet where components are compared.
    """
    own, ids, lead, begun, opening = None, np.zeros(0, np.int64), 0, False, True  # the last run: its rows not passed on yet, whether some were, whether it opens the partition

    def rows(bucket: np.ndarray, ident: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(ident), pa.array(lead)], names=["bucket", "id", "lead"])

    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, ident = (batch.column(i).to_numpy() for i in range(2))
        if own is not None:
            bucket, ident = np.concatenate([np.full(len(ids), own), bucket]), np.concatenate([ids, ident])
        at = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
        size = np.diff(np.append(at, len(bucket)))
        leads, many = ident[at].copy(), size > 1
        if own is not None and bucket[0] == own:
            leads[0], many[0] = lead, many[0] | begun | opening
        else:
            begun, opening = False, own is None
            many[0] |= opening
        keep = np.repeat(many & (np.arange(len(at)) < len(at) - 1), size)
        if keep.any():
            yield rows(bucket[keep], ident[keep], np.repeat(leads, size)[keep])
        if len(at) > 1:
            begun = opening = False
        own, lead, ids = int(bucket[-1]), int(leads[-1]), ident[at[-1] :]
        if len(ids) > 4096:  # a long run is passed on as it comes
            yield rows(np.full(len(ids), own), ids, np.full(len(ids), lead))
            ids, begun = ids[:0], True
    if len(ids):
        yield rows(np.full(len(ids), own), ids, np.full(len(ids), lead))


def _by_group(solve, keys: tuple[str, ...]):
    """Hands whole groups of rows (sorted by the keys) to solve, and passes on the batches that it yields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
            at = np.stack([t.column(c).to_numpy() for c in keys], 1)
            edge = (np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist()
            yield from solve([t.slice(x, y - x) for x, y in zip([0, *edge], [*edge, len(at)], strict=True)])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, t]) if held is not None else t
            last = [held.column(c)[-1].as_py() for c in keys]
            other = np.flatnonzero(np.logical_or.reduce([held.column(c).to_numpy() != k for c, k in zip(keys, last, strict=True)]))
            if len(other):
                yield from emit(held.slice(0, int(other[-1]) + 1))
                held = held.slice(int(other[-1]) + 1).combine_chunks()
        if held is not None:
            yield from emit(held)

    return run


def _odd(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("odd").to_pylist()), np.uint64).reshape(rows.num_rows, BITS // 64)


def _nearest(rows: pa.Table, most: int, percent: int) -> tuple[np.ndarray, ...] | None:
    """(a, b, lower component, higher, cut) of a block: the nearest PARTNERS pairs of each two components, and whether there were more."""
    ids, comp, n, side = (rows.column(c).to_numpy() for c in ("id", "comp", "n", "side"))
    odd, left, right = _odd(rows), np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    out = []
    for i in left:  # one row against a block at a time: memory is a block's
        z = np.bitwise_count(odd[right] ^ odd[i]).sum(1, dtype=np.int32)
        lo, hi = np.minimum(n[right], n[i]), np.maximum(n[right], n[i])
        j = np.flatnonzero((z <= most) & (comp[right] != comp[i]) & (100 * lo >= percent * hi) & ((side[i] == 0) | (ids[right] > ids[i])))
        if len(j):
            j = j[np.lexsort((z[j], comp[right][j]))]
            c = comp[right][j]
            new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            rank = np.arange(len(j)) - np.repeat(new, np.diff([*new, len(j)]))
            keep = rank <= PARTNERS  # one more than is proposed, so that a cut shows
            out.append(np.stack([np.full(keep.sum(), ids[i]), ids[right][j[keep]], z[j[keep]], np.minimum(c[keep], comp[i]), np.maximum(c[keep], comp[i])]))
    if not out:
        return None
    a, b, z, c, d = np.concatenate(out, 1)
    a, b, z, c, d = (v[np.lexsort((b, a, z, d, c))] for v in (a, b, z, c, d))
    new = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])]))
    size = np.diff([*new, len(a)])
    rank = np.arange(len(a)) - np.repeat(new, size)
    keep = rank < PARTNERS
    return np.minimum(a, b)[keep], np.maximum(a, b)[keep], c[keep], d[keep], np.repeat(size > PARTNERS, size)[keep]


def _proposals(most: int, percent: int):
    def solve(groups: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        got = [x for x in (_nearest(g, most, percent) for g in groups) if x is not None]
        if got:
            a, b, c, d, cut = (np.concatenate(v) for v in zip(*got, strict=True))
            _, one = np.unique(np.stack([a, b]), axis=1, return_index=True)  # a pair that shares several of the task's buckets
            cut = np.isin(c * np.int64(1_000_003) + d, (c * np.int64(1_000_003) + d)[cut])  # at worst one pair of components more
            yield pa.RecordBatch.from_arrays([pa.array(v[one]) for v in (a, b, c, d, cut)], names=["a", "b", "c", "d", "cut"])

    return _by_group(solve, ("bucket", "i", "j"))


def _in_full(most: int, percent: int):
    """Compares a block of a component (side 0) with the members of others (side 1) on their sets; yields a link for each two components."""

    def solve(groups: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in groups:
            ids, comp, n, side = (rows.column(c).to_numpy() for c in ("id", "comp", "n", "side"))
            odd, sets = _odd(rows), [np.frombuffer(v.as_buffer(), np.uint64) for v in rows.column("s").combine_chunks()]
            left, right, done = np.flatnonzero(side == 0), np.flatnonzero(side == 1), set()
            for i in right:
                if comp[i] in done:
                    continue
                z = np.bitwise_count(odd[left] ^ odd[i]).sum(1, dtype=np.int32)
                for j in left[np.argsort(z, kind="stable")][: int((z <= most).sum())]:
                    if 100 * min(n[i], n[j]) >= percent * max(n[i], n[j]):
                        both = len(sets[i]) + len(sets[j]) - len(np.union1d(sets[i], sets[j]))
                        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                            out.append((ids[i], ids[j]))
                            done.add(comp[i])
                            break
        if out:
            a, b = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return _by_group(solve, ("whole", "i", "j"))


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, s): the full sets of the documents whose ids are listed."""
    n = ids.count()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, size).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "s"])

    return docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "id", "left_semi").mapInArrow(sets, "id long, s binary")


def duplicates(docs: DataFrame, ws: Workspace, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs, with links where sets of ``size``-word shingles reach ``percent``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a shorter text is one shingle. Null and empty
    texts have an empty set and are linked with nothing. Rows that share an id are one document. A row whose id is
    null is linked with nothing and its component is null.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sk = ws.table(sketches(rows, size), "sketches")
    # one class for each set: its smallest id stands for it
    cls = sk.filter("n > 0 and id is not null").groupBy("key").agg(F.min(F.struct("id", "n", "odd", "bands")).alias("x"))
    cls = ws.table(cls.select("key", "x.*"), "classes")
    node = cls.select("id", "n", "odd")
    # members of a bucket stand next to each other, a bucket of many of them in several partitions: no key has to fit one task
    band = cls.select(F.explode("bands").alias("bucket"), "id")
    by = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = band.repartitionByRange(by, "bucket", "id").sortWithinPartitions("bucket", "id")
    shared = ws.table(dealt.mapInArrow(_shared, "bucket long, id long, lead long"), "buckets")
    most = most_differing(percent / 100)

    # each class with its nearest leader
    star = shared.filter("id <> lead").select("id", F.col("lead").alias("b")).distinct()
    star = star.join(node, "id").withColumnsRenamed({"id": "a", "n": "na", "odd": "oa"}).join(node.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob")), "b")
    z = F.lit(0)
    for i in range(BITS // 64):
        word = lambda c, i=i: F.conv(F.hex(F.substring(c, 8 * i + 1, 8)), 16, -10).cast("long")
        z = z + F.bit_count(word("oa").bitwiseXOR(word("ob")))
    star = star.withColumn("z", z).filter((F.col("z") <= most) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    nearest = star.groupBy("a").agg(F.min(F.struct("z", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    tested = ws.table(nearest, "pairs")
    links = ws.table(confirm(tested, rows, size, percent), "links")

    reached = components(links, ws)
    comp = node.join(reached.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "n", "odd", F.coalesce("component", "id").alias("comp"))
    inside = shared.select("id", "bucket").join(comp, "id")
    open_ = inside.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size")).filter("c0 < c1")
    rest = inside.join(open_, "bucket").withColumn("major", F.col("comp") == F.col("c0"))
    # the rows of one component of a bucket are never compared with each other: minor rows meet blocks of major ones, and minor ones
    minor = rest.filter("not major").groupBy("bucket").agg(F.count("*").alias("minors"))
    rest = rest.join(minor, "bucket")
    wide = F.ceil((F.col("size") - F.col("minors")) / BLOCK).cast("int")
    deep = F.ceil(F.col("minors") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("major"), wide).otherwise(deep)).cast("int")
    rest = rest.withColumn("wide", wide).withColumn("deep", deep).withColumn("mine", mine)
    small = F.col("size") <= BLOCK
    cells = (
        F.when(small, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"))))
        .when(F.col("major"), F.transform(F.sequence(F.lit(0), F.col("deep") - 1), lambda d: F.struct(F.col("mine").alias("i"), d.alias("j"), F.lit(1).alias("side"))))
        .otherwise(
            F.concat(
                F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda w: F.struct(w.alias("i"), F.col("mine").alias("j"), F.lit(0).alias("side"))),
                # minors among themselves: block i against block j, i <= j, in cells of their own
                F.transform(
                    F.sequence(F.lit(0), F.col("deep") - 1),
                    lambda d: F.struct((-1 - F.least(F.col("mine"), d)).alias("i"), F.greatest(F.col("mine"), d).alias("j"), F.when(d == F.col("mine"), 2).when(F.col("mine") < d, 0).otherwise(1).alias("side")),
                ),
            )
        )
    )
    cell = rest.select("bucket", "id", "comp", "n", "odd", F.explode(cells).alias("x")).select("bucket", "x.i", "x.j", F.col("x.side").cast("long").alias("side"), "id", "comp", "n", "odd")
    dealt = cell.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = ws.table(dealt.mapInArrow(_proposals(most, percent), "a long, b long, c long, d long, cut boolean"), "proposals")
    fresh = found.select("a", "b").distinct().join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = ws.table(confirm(ws.table(fresh, "fresh"), rows, size, percent), "links")
    if not more.isEmpty():  # components so far are stars: new links join them
        links = reached.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        reached = components(links, ws)
    apart = _still_apart(found.filter("cut").select("c", "d").distinct(), reached)
    apart = ws.table(apart, "apart")
    if not apart.isEmpty():
        more = ws.table(_compare(apart, node, reached, rows, size, percent, most), "links")
        links = reached.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        reached = components(links, ws)
    final = reached.select(F.col("node").alias("rep"), "component")
    whole = sk.select("id", "n", "key").join(cls.select("key", F.col("id").alias("rep")), "key", "left").join(final, "rep", "left")
    own = F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.coalesce("component", "rep"))
    return whole.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"))


def _still_apart(pairs: DataFrame, reached: DataFrame) -> DataFrame:
    """(c, d): the pairs of components as they are now, where they differ."""
    to = reached.select(F.col("node"), F.col("component"))
    p = pairs.join(to.withColumnsRenamed({"node": "c", "component": "x"}), "c", "left").join(to.withColumnsRenamed({"node": "d", "component": "y"}), "d", "left")
    p = p.select(F.coalesce("x", "c").alias("c"), F.coalesce("y", "d").alias("d")).filter("c <> d")
    return p.select(F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).distinct()


def _compare(apart: DataFrame, node: DataFrame, reached: DataFrame, rows: DataFrame, size: int, percent: int, most: int) -> DataFrame:
    """Links between components that proposals didn't settle: the larger one's blocks meet blocks of all the others', on full sets."""
    member = node.join(reached.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "n", "odd", F.coalesce("component", "id").alias("comp"))
    weight = member.groupBy("comp").agg(F.count("*").alias("w"))
    p = apart.join(weight.withColumnsRenamed({"comp": "c", "w": "wc"}), "c").join(weight.withColumnsRenamed({"comp": "d", "w": "wd"}), "d")
    first = F.col("wc") >= F.col("wd")
    p = p.select(F.when(first, F.col("c")).otherwise(F.col("d")).alias("whole"), F.when(first, F.col("d")).otherwise(F.col("c")).alias("part"), F.greatest("wc", "wd").alias("w"), F.least("wc", "wd").alias("v"))
    cells = p.groupBy("whole").agg(F.max("w").alias("w"), F.sum("v").alias("v")).select("whole", F.ceil(F.col("w") / SETS).cast("int").alias("wide"), F.ceil(F.col("v") / SETS).cast("int").alias("deep"))
    used = p.select(F.col("whole").alias("comp")).unionByName(p.select(F.col("part").alias("comp"))).distinct()
    held = member.join(used, "comp", "left_semi")
    held = held.join(_sets(rows, held.select("id"), size), "id")
    pick = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    majors = held.join(cells, F.col("comp") == F.col("whole")).withColumn("i", pick("wide")).withColumn("j", every("deep")).withColumn("side", F.lit(0).cast("long"))
    minors = held.join(p.select("whole", "part"), F.col("comp") == F.col("part")).join(cells, "whole").withColumn("j", pick("deep")).withColumn("i", every("wide")).withColumn("side", F.lit(1).cast("long"))
    names = ["whole", "i", "j", "side", "id", "comp", "n", "odd", "s"]
    dealt = majors.select(*names).unionByName(minors.select(*names)).repartition("whole", "i", "j").sortWithinPartitions("whole", "i", "j")
    return dealt.mapInArrow(_in_full(most, percent), "a long, b long")
