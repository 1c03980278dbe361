"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters (lower case; anything but letters counts as a space) are hashed into 2**15
buckets. A text's vector is each bucket's share of its n-grams times the bucket's inverse document frequency, so a
score is a mean of table rows over the n-grams and needs no sort. Document frequencies are counted over every
training row; the weights are fitted with follow-the-regularised-leader (elastic net: L1 and L2) on at most
``max_train_rows`` of them, and a temperature is fitted on rows that were kept out of that fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anomalake.llm.bpe import slices

BITS = 15
SIZE = 1 << BITS
_alpha: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def grams(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(buckets of all texts' n-grams for n = 1, 2, 3; where each text starts; its letters). Texts are parted by two spaces."""
    joined = "  ".join((t or "").lower() for t in texts) + "  "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = _letters()[code]
    size = np.fromiter((len((t or "").lower()) + 2 for t in texts), np.int64, len(texts))
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    c = np.where(alpha, code, np.uint32(32)) * np.uint32(0x9E3779B1)
    pad = np.concatenate([c, np.zeros(2, np.uint32)])
    out, h = [], c
    for n in range(3):
        if n:
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + pad[n : len(c) + n]
        g = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out.append((g >> np.uint32(32 - BITS)).astype(np.int32))
    return out, start, np.add.reduceat(alpha, start, dtype=np.int64) if len(texts) else np.zeros(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # SIZE x languages: idf times weight
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not texts or not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        buckets, start, letters = grams(texts)
        total = np.diff(np.concatenate([start, [len(buckets[0])]])) * 3.0
        z = np.empty((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            column = np.ascontiguousarray(self.table[:, k])
            z[:, k] = sum(np.add.reduceat(column[b], start, dtype=np.float64) for b in buckets) / total + self.bias[k]
        z = z / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        known = letters > 0
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, p.max(1), 0.0)


@dataclass
class Ftrl:
    """FTRL-Proximal for softmax regression, one row at a time."""

    classes: int
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.002
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z, self.n = np.zeros((SIZE + 1, self.classes)), np.zeros((SIZE + 1, self.classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        s = x @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _tf(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    buckets, _, _ = grams([text])
    count = np.bincount(np.concatenate(buckets), minlength=SIZE)
    at = np.flatnonzero(count)
    return at.astype(np.int32), (count[at] / count.sum()).astype(np.float32)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """(rows, rows that hold each bucket) over all rows; one row a bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros(SIZE + 1, np.int64), np.zeros(SIZE, np.uint8)
        for batch in batches:
            for b in slices(batch, text):
                texts = b.column(0).to_pylist()
                buckets, start, _ = grams(texts)
                ends = [*start[1:].tolist(), len(buckets[0])]
                for s, e in zip(start.tolist(), ends, strict=True):
                    seen[:] = 0
                    for g in buckets:
                        seen[g[s:e]] = 1
                    df[:SIZE] += seen
                df[SIZE] += len(texts)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["bucket", "df"])

    rows = docs.select(text).mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(SIZE + 1, np.int64)
    for r in rows:  # at most SIZE + 1
        out[r.bucket] = r.df
    return int(out[SIZE]), out[:SIZE]


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_train_rows: int = 6000, steps: int = 20_000) -> Model:
    """Fits on rows with a language.

    ``max_train_rows`` bounds the rows whose vectors reach the driver (those with the smallest hash of the key);
    document frequencies cover all rows. The fit goes over its rows until it has taken ``steps`` steps, three times at
    least: FTRL's rates fall with the steps taken, so few rows need more rounds (its settings come from four-fold
    cross-validation inside the training rows). Rows without a language or text teach nothing; with no rows at all the
    model knows no language and predicts ``und``.
    """
    train = train.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows, df = document_frequencies(train)
    if not rows:
        return Model([], np.zeros((SIZE, 0), np.float32), np.zeros(0))
    idf = np.log((1 + rows) / (1.0 + df)) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tf = [_tf(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([t[0].tobytes() for t in tf], pa.binary()), pa.array([t[1].tobytes() for t in tf], pa.binary())], names=["h", "key", "lang", "at", "tf"])

    # the share of the hash range that holds about twice the bound, then the bound itself
    share = min(1.0, 2.0 * max_train_rows / rows)
    h = F.pmod(F.xxhash64(F.col("key"), F.lit(17)), F.lit(1 << 30))
    picked = train.withColumn("h", h).filter(F.col("h") <= int(share * (1 << 30))).select("h", "key", "text", "lang")
    sample = picked.mapInArrow(vectors, f"h long, key {dict(train.dtypes)['key']}, lang string, at binary, tf binary").orderBy("h", "key").limit(max_train_rows).collect()
    languages = sorted({r.lang for r in sample})
    data = []
    for r in sample:
        at = np.frombuffer(r.at, np.int32)
        data.append((np.append(at, SIZE), np.append(np.frombuffer(r.tf, np.float32) * idf[at], 1.0), languages.index(r.lang)))
    kept = data[::10] if len(data) >= 50 else []
    model = Ftrl(len(languages))
    order = np.random.Generator(np.random.PCG64(5))
    used = [x for i, x in enumerate(data) if not kept or i % 10]
    for _ in range(max(3, -(-steps // max(1, len(used))))):
        for i in order.permutation(len(used)):
            model.step(*used[i])
    w = model.weights(slice(None))
    t = temperature([(x @ w[at], y) for at, x, y in kept])
    return Model(languages, (w[:SIZE] * idf[:, None]).astype(np.float32), w[SIZE], t)


def temperature(scored: list[tuple[np.ndarray, int]]) -> float:
    """The temperature with the least log loss on scored rows (1 without any)."""
    if not scored:
        return 1.0
    z, y = np.array([s for s, _ in scored]), np.array([k for _, k in scored])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    return float(min(np.geomspace(0.05, 5, 60), key=loss))


def predict(docs: DataFrame, model: Model, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and its calibrated probability to every row.

    A null text or one without letters is ``und`` with score 0. Columns named as ``out`` are replaced; the rest is
    kept. The model (buckets times languages, some MB at most) goes with the tasks.
    """
    keep = [c for c in docs.columns if c not in out]
    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).schema.add(out[0], "string").add(out[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text):
                lang, score = model.predict(b.column(b.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*keep, *out])

    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)


def held_out(key: Column | str, modulus: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves ``part``; a null key counts as held out, as nothing may be learned from it."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus)) == part, F.lit(True))
