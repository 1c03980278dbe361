"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored in context windows.

The lexicon (whole terms, and stems that open a term) is mined from labelled rows and kept in a trie. A word is
matched by walking the trie and a Levenshtein automaton of the word together, so misspellings within one edit are
found without listing them. Each hit gets a weight from the words around it: inside quotation marks next to a
reporting verb it counts as a quotation, addressed to someone it counts in full. A logistic regression over the
hits' weights gives the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomalake.llm.bpe import slices
from anomalake.llm.textvec import mix

WORD = re.compile(r"[^\W_]+")
#: Misspellings of shorter entries count only where someone is addressed: at one edit they meet many words.
FUZZY_FROM = 5
#: Misspellings are expected in this share of a term's toxic rows, besides those that the rows hold.
MISSPELLED = 0.3
#: Words on each side of a hit that its weight depends on.
WINDOW = 6
#: Tokens whose matches a task keeps; beyond, it starts anew with the next text.
MEMO = 250_000
# Words that report speech, and words that address someone.
REPORTS = frozenset("said says say wrote writes called calls quote quoted quoting told asked claimed dit disait sagte schrieb dijo escribió".split())
ADDRESS = frozenset("you your youre u ur tu vous te toi du dich ihr sie usted ustedes".split())
QUOTES = "\"“”„«»‘’'"


class Trie:
    """Nodes are maps from a character to a node; an end is ("term" or "stem", entry)."""

    def __init__(self, terms: Iterable[str], stems: Iterable[str]):
        self.terms, self.stems = sorted(set(terms)), sorted(set(stems))
        self.root: dict = {}
        for kind, entries in (("term", self.terms), ("stem", self.stems)):
            for e in entries:
                node = self.root
                for ch in e:
                    node = node.setdefault(ch, {})
                node.setdefault("", {})[kind] = e
        # one edit leaves the first two or the last two characters of a longer term as they are, a shorter one its first or last
        self.heads, self.tails = {e[: 1 + (len(e) > 3)] for e in self.terms}, {e[-1 - (len(e) > 3) :] for e in self.terms}
        self.shortest, self.longest = min(map(len, self.terms), default=0), max(map(len, self.terms), default=-2)
        # of a stem it leaves the first character, or the next two, which are then moved by one place at most
        self.stem_heads, self.stem_next = {e[:1] for e in self.stems}, {e[1:3] for e in self.stems}
        self.stem_shortest = min(map(len, self.stems), default=1 << 30)

    def exact(self, word: str) -> tuple[str, str, int] | None:
        node, stem = self.root, None
        for i, ch in enumerate(word, 1):
            node = node.get(ch)
            if node is None:
                return stem and ("stem", stem, 0)
            if i < len(word) and "" in node and "stem" in node[""]:  # something has to follow a stem
                stem = node[""]["stem"]
        if "" in node and "term" in node[""]:
            return ("term", node[""]["term"], 0)
        return stem and ("stem", stem, 0)

    def fuzzy(self, word: str) -> tuple[str, str, int] | None:
        """The smallest term one edit off, else the smallest stem (marked by a ``*``) one edit off what opens the word.

        The trie and the states of the word's Levenshtein automaton are walked at once. A state is (characters read,
        edits made). Before the edit the only trie path is the word itself; from each state on it the automaton may
        drop, replace or insert a character, and after that nothing but the word's rest leads on, so the walk visits
        few nodes whatever the lexicon's size.
        """
        n = len(word)
        whole = self.shortest - 1 <= n <= self.longest + 1 and not (self.heads.isdisjoint((word[:1], word[:2])) and self.tails.isdisjoint((word[-1:], word[-2:])))
        opens = n >= self.stem_shortest and (word[:1] in self.stem_heads or not self.stem_next.isdisjoint((word[:2], word[1:3], word[2:4])))
        if not whole and not opens:
            return None
        best, stem, node = None, None, self.root
        for i in range(n + 1):
            ways = [(node, i + 1)] if i < n else []
            for ch, child in node.items():
                if ch:
                    ways.append((child, i))
                    if i < n and ch != word[i]:
                        ways.append((child, i + 1))
            for at, k in ways:
                while at:
                    end = at.get("")
                    if end and k < n and "stem" in end and (stem is None or end["stem"] < stem):  # something has to follow a stem
                        stem = end["stem"]
                    if k == n:
                        if end and "term" in end and end["term"] != word and (best is None or end["term"] < best):
                            best = end["term"]
                        break
                    at = at.get(word[k])
                    k += 1
            node = node.get(word[i]) if i < n else None
            if node is None:
                break
        return ("fuzzy", best, 1) if best else stem and ("fuzzy", f"{stem}*", 1)

    def match(self, word: str) -> tuple[str, str, int] | None:
        return self.exact(word) or self.fuzzy(word)


@dataclass
class Model:
    terms: list[str]
    stems: list[str]
    odds: dict[str, float]  # an entry's log odds for the label; a stem's key ends with ``*``
    loose: dict[str, float]  # an entry's log odds when it is met misspelled
    weights: list[float]  # bias, term, stem, fuzzy
    clean: frozenset[str] = frozenset()  # words one edit off an entry that clean texts hold: no misspellings
    _trie: Trie | None = field(default=None, repr=False)
    _memo: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"terms": self.terms, "stems": self.stems, "odds": self.odds, "loose": self.loose, "weights": self.weights, "clean": self.clean, "_trie": None, "_memo": {}}

    def look(self, token: str) -> tuple[str, str, int] | None:
        """The best match among the words of a white-space token; kept for the next time."""
        got = None
        for w in WORD.findall(token):
            m = self._trie.match(w)
            if m and (got is None or m[2] < got[2]) and not (m[2] and w in self.clean):
                got = m
        self._memo[token] = got
        return got

    def hits(self, text: str | None) -> list[tuple[int, str, str, float]]:
        """(token's number, kind, lexicon entry, weight in context) of every hit in the whole text."""
        if self._trie is None:
            self._trie = Trie(self.terms, self.stems)
        tokens = (text or "").lower().split()
        if len(self._memo) > MEMO:  # between texts only: the lines below read it for every token of this one
            self._memo.clear()
        memo = self._memo
        for t in set(tokens):
            if t not in memo:
                self.look(t)
        found = [(i, memo[t]) for i, t in enumerate(tokens) if memo[t] is not None] if any(memo[t] is not None for t in set(tokens)) else []
        weighed = ((i, kind, entry, context(tokens, i)) for i, (kind, entry, _) in found)
        return [h for h in weighed if h[1] != "fuzzy" or h[3] > 1 or len(h[2].rstrip("*")) >= FUZZY_FROM]

    def features(self, text: str | None) -> list[float]:
        total = {"term": 0.0, "stem": 0.0, "fuzzy": 0.0}
        for _, kind, entry, weight in self.hits(text):
            total[kind] += weight * (self.loose if kind == "fuzzy" else self.odds).get(f"{entry}*" if kind == "stem" else entry, 0.0)
        return [1.0, *(min(total[k], 24.0) / 4 for k in ("term", "stem", "fuzzy"))]

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))))))


def context(tokens: list[str], i: int) -> float:
    """A hit's weight: 0.25 as a reported quotation, 0.6 in quotation marks alone, 1.25 if someone is addressed, else 1."""
    before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
    around = {w for t in (*before, *after) for w in WORD.findall(t)}
    opened = any(t[0] in QUOTES for t in (*before[-3:], tokens[i])) and any(t.rstrip(".,;:!?")[-1:] in tuple(QUOTES) for t in (tokens[i], *after[:3]))
    if opened:
        return 0.25 if around & REPORTS else 0.6
    return 1.25 if around & ADDRESS else 1.0


def signature(words: set[str]) -> str:
    """Three min-hashes of a word set: copies and most near copies share them, so a copied text teaches once."""
    if not words:
        return ""
    h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) | len(w) << 40 for w in words), np.uint64, len(words))
    return "-".join(f"{int(mix(h ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))).min()):x}" for k in (1, 2, 3))


class Rows:
    """Labelled word sets, held as arrays of word numbers."""

    def __init__(self, words: list[list[str]], labels: list[int]):
        number: dict[str, int] = {}
        self.sets = [np.fromiter((number.setdefault(w, len(number)) for w in dict.fromkeys(ws)), np.int32) for ws in words]
        self.labels, self.vocabulary = np.array(labels, np.int32), list(number)

    def text(self, i: int) -> str:
        return " ".join(sorted(self.vocabulary[k] for k in self.sets[i]))


def mine(rows: Rows, use: list[int], least_odds: float = 6.0, least_docs: int = 6, most: int = 4000) -> Model:
    """The lexicon of some of the rows: terms and stems in at least ``least_docs`` rows of label 1, ``least_odds`` times likelier there.

    Stems are the proper prefixes of 3 to 8 characters.
    """
    vocabulary = rows.vocabulary
    pos, neg = ([i for i in use if rows.labels[i] == y] for y in (1, 0))
    least = max(least_docs, len(pos) // 100)

    def odds(a: float, b: float) -> float:
        return (a + 0.5) / (len(pos) + 1) * (len(neg) + 1) / (b + 0.5)

    number: dict[str, int] = {}
    prefix = np.full((len(vocabulary), 7), -1, np.int32)  # of 3 to 9 characters
    for k in {int(k) for i in pos for k in rows.sets[i]}:  # a stem of no such row is never chosen
        for n in range(3, min(len(vocabulary[k]), 9) + 1):
            prefix[k, n - 3] = number.setdefault(vocabulary[k][:n], len(number))
    for k, w in enumerate(vocabulary):
        for n in range(3, min(len(w), 9) + 1):
            if prefix[k, n - 3] < 0:
                prefix[k, n - 3] = number.get(w[:n], -1)
    length = np.array([len(w) for w in vocabulary] or [0])
    proper = prefix[:, :6].copy()
    for n in range(3, 9):
        proper[length[: len(proper)] <= n, n - 3] = -1
    term, term0 = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    stem, stem0, top = (np.zeros(len(number) + 1, np.int64) for _ in range(3))  # the last is for no prefix
    for part, words, stems in ((pos, term, stem), (neg, term0, stem0)):
        for i in part:
            words[rows.sets[i]] += 1
            stems[np.unique(proper[rows.sets[i]])] += 1
    for column in prefix.T:
        np.maximum.at(top, column, term)
    names = list(number)
    opened = [int(p) for p in np.flatnonzero(stem[:-1] >= least)]
    chosen: list[str] = []
    weight: dict[str, float] = {}
    for p in sorted(opened, key=lambda p: (-(stem[p] * math.log(odds(stem[p], stem0[p]))), names[p])):  # evidence first
        w = names[p]
        # a stem must add rows to what its commonest word has alone
        if odds(stem[p], stem0[p]) >= least_odds and stem[p] >= 1.5 * top[p] and len(chosen) < most and not any(w.startswith(q) or q.startswith(w) for q in chosen):
            chosen.append(w)
            weight[f"{w}*"] = math.log(odds(stem[p], stem0[p]))
    seen = [int(k) for k in np.flatnonzero(term >= least) if length[k] >= 3 and odds(term[k], term0[k]) >= least_odds and not any(vocabulary[k].startswith(q) and vocabulary[k] != q for q in chosen)]
    seen = sorted(seen, key=lambda k: (-term[k], vocabulary[k]))[:most]
    weight |= {vocabulary[k]: math.log(odds(term[k], term0[k])) for k in seen}
    terms = [vocabulary[k] for k in seen]
    trie, clean = Trie(terms, chosen), set()
    rows1 = Counter(dict(zip(terms, (int(term[k]) for k in seen), strict=True))) + Counter({f"{names[p]}*": int(stem[p]) for p in opened if f"{names[p]}*" in weight})
    near: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for k in np.flatnonzero(term + term0).tolist():
        m = trie.match(vocabulary[k])
        if m is None or m[0] != "fuzzy":
            continue
        a, b = int(term[k]), int(term0[k])
        if b and (a < least or odds(a, b) < least_odds):
            clean.add(vocabulary[k])
            near[0][m[1]] += b == 1  # without its one row the word would count: so often do clean rows bring new words
        else:
            near[1][m[1]] += a
            near[0][m[1]] += b
    loose = {e: max(0.0, min(0.8 * v, math.log(odds(near[1][e] + MISSPELLED * rows1[e], near[0][e])))) for e, v in weight.items()}
    model = Model(terms, chosen, weight, loose, [0.0] * 4, frozenset(clean))
    return model


def regress(x: np.ndarray, y: np.ndarray, l2: float = 0.2, steps: int = 40) -> list[float]:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + (l2 + 1e-9) * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - l2 * w), -2, 2)
    return [float(v) for v in w]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", max_train_rows: int = 6000) -> Model:
    """Fits on the labelled rows; at most ``max_train_rows`` of them (the smallest hashes of the key) reach the driver, as word sets.

    Rows with a null key, label or text teach nothing; repeated rows and copies teach once. Without rows of both
    labels the model scores every text as its prior.
    """
    h = F.xxhash64(F.col("key"), F.lit(29))
    picked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).filter(F.col("key").isNotNull() & F.col("y").isNotNull()).groupBy("key").agg(F.max("y").alias("y")).orderBy(h, "key").limit(max_train_rows)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [sorted(set(WORD.findall((t or "").lower()))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signature(set(w)) for w in words]), pa.array([" ".join(w) for w in words], pa.string())], names=["y", "sig", "words"])

    joined = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null").join(F.broadcast(picked), "key").select("y", "text")
    got = joined.mapInArrow(sets, "y int, sig string, words string").groupBy("sig", "y").agg(F.min("words").alias("words")).orderBy("sig", "y").collect()
    rows = Rows([r.words.split() for r in got], [r.y for r in got])
    every = list(range(len(got)))
    share = (int(rows.labels.sum()) + 0.5) / (len(got) + 1)
    del got
    model = mine(rows, every)
    model.weights = [math.log(share / (1 - share)), 0.0, 0.0, 0.0]
    if 0 < rows.labels.sum() < len(every):
        # each row's features come from the lexicon of the other rows, so a chance entry doesn't vouch for itself
        x: list[list[float]] = [[]] * len(every)
        for part in (0, 1):
            other = mine(rows, [i for i in every if i % 2 != part])
            for i in every[part::2]:
                x[i] = other.features(rows.text(i))
        fitted = regress(np.array(x), rows.labels.astype(float))
        # loose odds are bounded already: a misspelling counts as much as they say even where the sample has none
        model.weights = [fitted[0], *(max(0.0, w) for w in fitted[1:3]), max(0.0, fitted[3], fitted[1])]
    model._memo.clear()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score, from 0 to 1, to every row; a null or empty text gets the prior. A column of that name is replaced."""
    keep = [c for c in docs.columns if c != out]
    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).schema.add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text):
                got = [model.score(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*keep, out])

    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)
