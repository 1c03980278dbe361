"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

All of the main path is DataFrame expressions. Base spans follow fixed formats and checks and always stay.
Further generators propose candidates, overlapping ones too: bare phone and account numbers, social security
numbers, IBANs, written-out addresses and secrets. Gradient-boosted trees over small integer features score them;
the trees are fitted on the driver on synthetic labelled lines (``examples``) whose features come from the same
expressions, are compiled to CASE expressions, and are calibrated on lines kept out of the fit. A candidate is kept
where its probability reaches its kind's threshold, it overlaps no base span, and no better candidate overlaps it.

Matches are found by putting private-use marks around them (regexp_replace) and splitting at the marks, which gives
code-point positions without Python. Patterns are possessive, so long runs of one character take linear time.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "\ue000", "\ue001"
BASE = ("email", "ip", "card", "phone")
MORE = ("account", "iban", "secret", "ssn")
KINDS = BASE + MORE
# The contract's patterns, leftmost and not overlapping, in a possessive form with the same matches.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators of candidates by name; what kind a candidate is follows from its format.
GENERATORS = {
    "number": r"(?<![0-9A-Za-z.+@])\(?[0-9](?:[ ().-]{0,2}+[0-9]){6,}+",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",
    "written": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[({] ?at ?[\])}] ?| at )[A-Za-z0-9-]++(?:(?:\.| ?[\[({] ?dot ?[\])}] ?| dot )[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
}
#: Characters before a candidate that its context features see.
CONTEXT = 24
FEATURES = ("generator", "digits", "letters", "groups", "marks", "luhn", "hex", "mixed", "word", "assigned", "bracketed", "dots")


def clean(text: Column) -> Column:
    """Null as empty, and the marks' own characters replaced one for one, so positions hold."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains(OPEN) | text.contains(CLOSE), F.translate(text, OPEN + CLOSE, "\ufffd\ufffd")).otherwise(text)


#: Parts of a text that are put in place one after another; longer lists go in runs of so many, whose lengths are summed after.
RUN = 64


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, before>> of the pattern's matches in a clean text, by code point.

    Every second part of the split text is a match. A list that grows by one match at a time would be copied each
    time, so runs of parts are placed by themselves and then moved by what stands before them.
    """
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]", -1)
    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string,before:string>>)")

    def step(a: Column, x: Column) -> Column:
        end = a["pos"] + F.char_length(x)
        new = F.struct(a["pos"].alias("start"), end.alias("end"), x.alias("match"), a["last"].alias("before"))
        out = F.when(a["inside"], F.concat(a["out"], F.array(new))).otherwise(a["out"])
        return F.struct(end.alias("pos"), (~a["inside"]).alias("inside"), out.alias("out"), F.right(x, F.lit(CONTEXT)).alias("last"))

    def placed(run: Column) -> Column:
        return F.aggregate(run, F.struct(F.lit(0).alias("pos"), F.lit(False).alias("inside"), none.alias("out"), F.lit("").alias("last")), step)

    def moved(runs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<int>)").alias("out"))
        starts = F.aggregate(runs, zero, lambda a, x: F.struct((a["pos"] + x["pos"]).alias("pos"), F.concat(a["out"], F.array(a["pos"])).alias("out")), lambda a: a["out"])
        put = lambda m, by: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["match"].alias("match"), m["before"].alias("before"))
        return F.flatten(F.zip_with(runs, starts, lambda x, by: F.transform(x["out"], lambda m: put(m, by))))

    def whole(p: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), lambda i: placed(F.slice(p, i * RUN + 1, F.lit(RUN))))
        return F.when(F.size(p) < 2, none).when(F.size(p) <= RUN, placed(p)["out"]).otherwise(_let(runs, moved))

    return _let(parts, whole)


def valid(kind: str, m: Column) -> Column:
    """The base kinds' checks."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
        return m.rlike(rf"^(?:{part}\.){{3}}{part}$")
    if kind == "card":
        return F.char_length(digits).between(13, 19) & F.call_function("luhn_check", F.when(F.char_length(digits) <= 19, digits).otherwise(F.lit("1")))
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end>> of a base kind."""
    return F.transform(F.filter(found(text, PATTERNS[kind]), lambda x: valid(kind, x["match"])), lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def features(name: str, x: Column) -> dict[str, Column]:
    """A candidate's features, small integers, from its format and from the characters before it."""
    m, before = x["match"], F.lower(x["before"])
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.char_length(digits)
    words = {
        1: r"(?:token|key|secret|passw(?:or)?d|pwd|credential|bearer|auth)[\"' ]*$|(?:token|key|secret|passw(?:or)?d|pwd|credential|bearer|auth)[\"' ]*[:=][\"' ]*$",
        2: r"(?:card|visa|mastercard|credit|debit|account|acct|konto|compte|cuenta)[a-z]*[ .:#]*(?:no|nr|number|num)?[ .:#]*$",
        3: r"(?:phone|tel|call|mobile|cell|fax|t\u00e9l|telefon|tel\u00e9fono)[a-z]*[ .:#]*(?:me|us|at|no|nr)?[ .:#]*$",
        4: r"(?:ssn|social security|iban|e-?mail|mail|contact|write to|reach)[a-z]*[ .:#]*(?:no|me|us|at|to)?[ .:#]*$",
        5: r"(?:version|isbn|issn|order|invoice|date|commit|sha1?|md5|hash|build|serial|page|pages|pp|id|vol|time)[a-z]*[ .:#]*$",
    }
    word = F.lit(0)
    for k, pattern in reversed(words.items()):
        word = F.when(before.rlike(pattern), k).otherwise(word)
    one = lambda c: F.when(c, 1).otherwise(0)
    return {
        "generator": F.lit(list(GENERATORS).index(name)),
        "digits": F.least(n, F.lit(24)),
        "letters": F.least(F.char_length(F.regexp_replace(m, "[^A-Za-z]", "")), F.lit(24)),
        "groups": F.least(F.size(F.split(F.regexp_replace(m, "^[^0-9]+", ""), "[^0-9A-Za-z]+")), F.lit(8)),
        "marks": F.when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 1).when(m.rlike(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$"), 2).when(m.rlike(r"^(?:19|20)?[0-9]{2}-[01]?[0-9]-[0-3]?[0-9]"), 3).when(m.rlike(r"^0[0-9]([ .-]?[0-9]{2}){4}$"), 4).when(m.rlike(r"^[0-9]+$"), 5).otherwise(0),
        "luhn": one(n.between(13, 19) & F.call_function("luhn_check", F.when(n.between(1, 19), digits).otherwise(F.lit("1")))),
        "hex": one(m.rlike("^[0-9a-fA-F]+$")),
        "mixed": one(m.rlike("[0-9]") & m.rlike("[A-Za-z]")) + one(m.rlike("[A-Z]") & m.rlike("[a-z]")),
        "word": word,
        "assigned": one(before.rlike("[:=] ?[\"']?$")),
        "bracketed": one(m.rlike(r"[\[({] ?(?:at|dot) ?[\])}]")),
        "dots": F.least(F.size(F.split(m, r"\.| dot |[\[({] ?dot ?[\])}]")), F.lit(6)),
    }


def kind_of(name: str, f: dict[str, Column]) -> Column:
    """The candidate's kind, as its place in KINDS."""
    at = KINDS.index
    if name == "number":
        return F.when(f["marks"] == 1, at("ssn")).when(f["digits"] >= 12, at("account")).otherwise(at("phone"))
    return F.lit(at({"secret": "secret", "written": "email", "iban": "iban"}[name]))


def candidates(text: Column, name: str, score) -> Column:
    """array<struct<kind, start, end, score>> of a generator's candidates; score maps features to a column."""

    def described(x: Column) -> Column:
        f = features(name, x)
        return F.struct(kind_of(name, f).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), *(f[k].alias(k) for k in FEATURES))

    def scored(x: Column) -> Column:  # over features that are computed once
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score({k: x[k] for k in FEATURES}).alias("score"))

    return F.transform(F.transform(found(text, GENERATORS[name]), described), scored)


# The synthetic lines


def luhn(prefix: str) -> str:
    """The prefix with its check digit."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(prefix)))
    return prefix + str(-total % 10)


def examples(n: int = 30, seed: int = 11) -> list[tuple[str, int]]:
    """(line, whether its candidates are personal data): formats drawn at random around both meanings."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    h = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    w = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(3, 9)))
    mixed = lambda k: "".join(r.choice("ABCDEFGHabcdefghijk0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        yes = [
            f'{w()} token = "{h(40)}" {w()}', f"{w()} api_key={mixed(32)}", f"password: {mixed(24)}", f"Bearer {mixed(36)}", f"secret '{h(32)}'", f"AKIA{d(4)}{mixed(24).upper()} key {mixed(40)}",
            f"{w()} {luhn(d(15))} {w()}", f"card {d(4)} {d(4)} {d(4)} {d(4)}", f"{w()} {d(16)} {w()}", f"account no {d(14)}", f"{w()} {d(4)}-{d(4)}-{d(4)}-{d(4)}",
            f"call {d(3)}-{d(3)}-{d(4)}", f"tel ({d(3)}) {d(3)}-{d(4)}", f"{w()} ({d(3)}) {d(3)}-{d(4)} {w()}", f"phone: 0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{w()} {d(3)}.{d(3)}.{d(4)}",
            f"ssn {d(3)}-{d(2)}-{d(4)}", f"{w()} {d(3)}-{d(2)}-{d(4)} {w()}", f"iban DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", f"{w()} FR{d(2)}{d(20)}",
            f"{w()}.{w()} [at] {w()} [dot] com", f"mail {w()} (at) {w()}.org", f"contact {w()} at {w()} dot com", f"{w()}(at){w()}(dot){w()}.net",
        ]
        no = [
            f"commit {h(40)}", f"{w()} sha1 {h(40)}", f"md5 {h(32)}", f"{w()} {'-' * r.randint(20, 60)} {w()}", "_" * 40, f"{w()}/{w()}/{w()}/{w()}/{w()}", f"{w()}-{w()}-{w()}-{w()}-{w()}{w()}", "=" * 30, f"{w()}{w()}{w()}{w()}{w()}{w()}",
            f"version {d(1)}.{d(2)}.{d(4)}", f"{r.randint(1900, 2099)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {w()}", f"date {r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1900, 2099)}", f"isbn 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
            f"{w()} {d(2)}.{d(3)}.{d(3)} {w()}", f"order {d(8)}", f"{w()} {d(7)} {w()}", f"pages {d(3)}-{d(4)}", f"{d(1)} {d(2)} {d(1)} {d(2)} {d(1)} {d(2)} {d(1)}", f"{w()} at {w()}.{w().title()}", f"{w()} at home.Then", f"invoice {d(10)}", f"time {d(10)}",
        ]
        out += [(x, 1) for x in yes] + [(x, 0) for x in no]
    return out


# Boosted trees


@dataclass
class Trees:
    """Trees of depth two, [(feature, at most, leaf or split, leaf or split)], a bias, and a calibration of their sum."""

    bias: float
    trees: list[tuple]
    scale: float
    shift: float
    thresholds: dict[int, float]

    def margin(self, row: dict[str, int]) -> float:
        total = self.bias
        for t in self.trees:
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            total += t
        return total

    def probability(self, f: dict[str, Column]) -> Column:
        """The calibrated probability as an expression over feature columns."""

        def grow(t) -> Column:
            return F.when(f[t[0]] <= t[1], grow(t[2])).otherwise(grow(t[3])) if isinstance(t, tuple) else F.lit(float(t))

        total = F.lit(self.bias)
        for t in self.trees:
            total = total + grow(t)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(total * self.scale + self.shift)))


def _best(rows: list[tuple[dict, float, float]], depth: int, l2: float = 1.0):
    """A regression tree on (features, gradient, curvature)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = round(0.3 * g / (h + l2), 6)
    if not depth or len(rows) < 8:
        return leaf
    top = None
    for name in FEATURES:
        by: dict[int, list[float]] = {}
        for f, gi, hi in rows:
            s = by.setdefault(f[name], [0.0, 0.0])
            s[0] += gi
            s[1] += hi
        gl = hl = 0.0
        for v in sorted(by)[:-1]:
            gl, hl = gl + by[v][0], hl + by[v][1]
            gain = gl * gl / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g * g / (h + l2)
            if gain > 1e-9 and (top is None or gain > top[0]):
                top = (gain, name, v)
    if top is None:
        return leaf
    _, name, v = top
    return (name, v, _best([r for r in rows if r[0][name] <= v], depth - 1, l2), _best([r for r in rows if r[0][name] > v], depth - 1, l2))


def boost(rows: list[tuple[dict, int, int]], rounds: int = 24, depth: int = 3, precision: float = 0.9) -> Trees:
    """Fits on (features, label, kind): two thirds grow the trees, the others calibrate them and set the thresholds."""
    grow, check = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    share = sum(y for _, y, _ in grow) / max(1, len(grow))
    share = min(max(share, 0.01), 0.99)
    model = Trees(math.log(share / (1 - share)), [], 1.0, 0.0, {})
    margins = [model.bias] * len(grow)
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margins]
        tree = _best([(f, y - q, q * (1 - q)) for (f, y, _), q in zip(grow, p, strict=True)], depth)
        model.trees.append(tree)
        for i, (f, _, _) in enumerate(grow):
            t = tree
            while isinstance(t, tuple):
                t = t[2] if f[t[0]] <= t[1] else t[3]
            margins[i] += t
    scored = [(model.margin(f), y, k) for f, y, k in check]
    for _ in range(200):  # Platt's scaling, with smoothed targets, by gradient steps
        ga = gb = 0.0
        for m, y, _ in scored:
            e = 1 / (1 + math.exp(-(model.scale * m + model.shift))) - (0.98 if y else 0.02)
            ga, gb = ga + e * m, gb + e
        model.scale -= 0.5 * ga / max(1, len(scored)) / 10
        model.shift -= 0.5 * gb / max(1, len(scored))
    for kind in range(len(KINDS)):
        own = sorted(((1 / (1 + math.exp(-(model.scale * m + model.shift))), y) for m, y, k in scored if k == kind), reverse=True)
        good, best = 0, 0.5
        for i, (p, y) in enumerate(own, 1):
            good += y
            if good / i >= precision:
                best = min(best, p)
        model.thresholds[kind] = max(0.3, min(best, 0.9))
    return model


_FITTED: dict[tuple, Trees] = {}


def fit(spark: SparkSession, n: int = 30, seed: int = 11) -> Trees:
    """The trees, fitted on n rounds of synthetic lines (a fixed, small number whatever the corpus); kept in the process."""
    if (n, seed) not in _FITTED:
        lines = json.dumps([{"i": i, "t": t, "y": y} for i, (t, y) in enumerate(examples(n, seed))])
        lines = spark.range(1).select(F.explode(F.from_json(F.lit(lines), "array<struct<i:int,t:string,y:int>>")).alias("x")).select("x.*")
        rows = []
        for name in GENERATORS:
            x = F.col("c")
            f = features(name, x)
            got = lines.select("i", "y", F.explode(found(F.col("t"), GENERATORS[name])).alias("c")).select("i", "y", kind_of(name, f).alias("kind"), *(f[k].alias(k) for k in FEATURES)).collect()
            rows += [(r.i, r) for r in got]
        rows.sort(key=lambda r: (r[0], r[1].generator))
        _FITTED[n, seed] = boost([({k: r[k] for k in FEATURES}, r.y, r.kind) for _, r in rows])
    return _FITTED[n, seed]


def detect(docs: DataFrame, model: Trees, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds ``out``: struct<base, spans>, both array<struct<kind, start, end>> sorted by kind (its place in KINDS) and start.

    A null or empty text has none. Repeated rows are alike; a column of that name is replaced, all others stay.
    """
    t = F.col("_clean")
    keep = [c for c in docs.columns if c != out]
    with_base = docs.select(*(F.col(f"`{c}`") for c in keep), clean(F.col(f"`{text}`")).alias("_clean")).withColumn("_base", F.concat(*(base_spans(t, k) for k in BASE)))
    more = with_base.withColumn("_more", F.concat(*(candidates(t, name, model.probability) for name in GENERATORS)))
    def passes(x: Column) -> Column:
        limit = F.lit(1.0)
        for k, v in model.thresholds.items():
            limit = F.when(x["kind"] == k, v).otherwise(limit)
        return x["score"] >= limit

    over = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    rank = lambda x: F.struct(x["score"], x["end"] - x["start"], -x["start"], -x["kind"])
    more = more.withColumn("_more", F.filter("_more", passes)).withColumn("_more", F.filter("_more", lambda x: ~F.exists("_base", lambda b: over(x, b))))
    more = more.withColumn("_best", F.filter("_more", lambda x: ~F.exists("_more", lambda o: over(x, o) & (rank(o) > rank(x)))))
    spans = F.array_sort(F.concat("_base", F.transform("_best", lambda x: F.struct(x["kind"], x["start"], x["end"]))))
    return more.select(*(F.col(f"`{c}`") for c in keep), F.struct(F.col("_base").alias("base"), spans.alias("spans")).alias(out))


def listed(spans: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """The rows with each span's text replaced by its kind in brackets; overlapping spans become one. A null text stays null."""
    name = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    t = F.col(f"`{text}`")
    by_start = F.array_sort(F.transform("_pii.spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind"))))

    def step(a: Column, x: Column) -> Column:
        end = -x["end"]
        piece = F.concat(a["out"], F.substring(t, a["pos"] + 1, x["start"] - a["pos"]), F.element_at(name, x["kind"] + 1))
        return F.struct(F.greatest(a["pos"], end).alias("pos"), F.when(x["start"] >= a["pos"], piece).otherwise(a["out"]).alias("out"))

    joined = F.aggregate(by_start, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(t, a["pos"] + 1, F.char_length(t))))
    found_ = detect(docs, model, text, "_pii")
    return found_.select(*((F.when(F.size("_pii.spans") > 0, joined).otherwise(t).alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns))
