"""Main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass labels each block from its zone (article, or
boilerplate by tag, class or id), its length, its link density and its density of stop words; in scripts whose stop
words aren't listed, sentence marks stand for them. Blocks too short or too mixed to decide are ambiguous; the second
pass gives each of them the label of the nearest decided neighbour, found by one sweep in each direction.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomalake.llm.bpe import slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# HTML's elements by what they mean for the text.
RAW = frozenset("script style noscript template textarea select option iframe object svg math canvas audio video title head button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav footer aside form menu dialog fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
# Words of a class or id that mark what stands around an article.
MARKED = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice banner popup modal overlay "
    "ad ads advert adverts advertisement sponsored promo newsletter subscribe subscription signup login comment comments reply replies respond disqus share sharing social related recommended trending pagination pager toolbar widget tags copyright".split()
)
# Frequent function words of languages in Latin script.
STOP = frozenset(
    "the of and to in a is that it for on as with was are be by this at from or an not but have he they we you his her which had has were their all one can will if there what "
    "der die das und in zu den von mit ist des im für auf ein eine nicht sich dem als auch es an werden aus er hat dass sie nach bei um noch wie über so zum war haben nur oder aber vor zur bis "
    "le la les de des du et à un une en est que qui dans pour par sur pas au avec ce il sont ne se plus son leur ou mais nous vous cette aux "
    "el los las del y que un una por con no para se su al lo como más o pero sus este entre ha si sobre "
    "il di che è per non una sono della con del si dei da o os as dos um uma não em na no mais het een van voor op niet met zijn".split()
)
# Words that may follow a marked one in a class name, as in footer-links.
PARTS = frozenset("area bar block body bottom box button buttons container content form inner item items left link links list panel post posts right section stories text top wrap wrapper".split())
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
SENTENCE = re.compile(r"[.!?\u3002\uff01\uff1f\u0964\u06d4\u061f\u0589\u104b\u17d4]")
#: Blocks shorter than this, in characters, can't be decided by themselves; above LONG a low density of stop words is enough.
SHORT, LONG = 70, 200
LINKS, STOP_LOW, STOP_HIGH = 0.33, 0.08, 0.22
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    zone: int  # 1 in an article, -1 in boilerplate, else 0
    linked: int  # characters inside links
    heading: bool
    label: str = ""


def _marks(name: str) -> bool:
    """Whether a class or id names what stands around an article: a marked word at its end, or before words for parts."""
    words = [w.lower() for w in NAME.findall(name)]
    while len(words) > 1 and words[-1] in PARTS:
        words.pop()
    return bool(words) and words[-1] in MARKED


def _zone(parent: int, commented: bool, tag: str, attributes: str) -> tuple[int, bool]:
    names: list[str] = []
    role = ""
    for name, value in ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        value = value.strip("\"'")
        if name.lower() == "role":
            role = value.lower()
        else:
            names += value.split()
    words = {w.lower() for n in names for w in NAME.findall(n)}
    if tag in ("article", "main"):  # its class says what kind of article it is; only a reader's comment is none
        return (1, False) if not commented and not words & COMMENTS else (-1, True)
    if tag not in ("html", "body", *HEADING) and (any(map(_marks, names)) or role in ROLES) or tag in BOILER or tag == "header" and parent != 1:
        return -1, commented or bool(words & COMMENTS)
    return parent, commented


def blocks(page: str | None) -> list[Block]:
    """The page's blocks in order; never the text of scripts, styles, comments or form controls."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # open elements: tag, zone, in comments
    parts: list[str] = []
    linked, in_link, heading, zone, commented, at = 0, 0, False, 0, False, 0

    def flush() -> None:
        nonlocal linked, heading
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, zone, min(linked, len(text)), heading))
            parts.clear()
        linked, heading = 0, False

    while True:
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "br" or tag == "hr":
            parts.append(" ")
            if tag == "hr":
                flush()
            continue
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BLOCK:
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                zone, commented = stack[-1][1:] if stack else (0, False)
                in_link = 0
            continue
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag == "head" and not end:
                end = re.compile(r"(?=<body\b)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "a":
            in_link += 1
        elif tag in BLOCK:
            flush()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                stack.pop()
            elif stack and stack[-1][0] == "p":  # a block ends an open paragraph
                stack.pop()
            heading = tag in HEADING
            zone, commented = _zone(*(stack[-1][1:] if stack else (0, False)), tag, attributes)
            if tag not in VOID:
                stack.append((tag, zone, commented))
    flush()
    return out


def classify(found: list[Block]) -> list[Block]:
    """Both passes; every block ends as ``good`` or ``bad``."""
    article = any(b.zone == 1 for b in found)
    for b in found:
        n = len(b.text)
        links = b.linked / n
        if b.zone == -1:
            b.label = "bad"
        elif links > LINKS:
            b.label = "bad" if b.zone != 1 or n < SHORT and links > 0.9 else "short"
        elif b.zone == 1:
            b.label = "good" if n >= SHORT else "short"
        elif article:
            b.label = "bad"  # what stands outside the article of a page that marks one
        elif "©" in b.text and n < LONG:
            b.label = "bad"  # the line of a footer; a paragraph may name the sign
        elif n < SHORT:
            b.label = "short"
        else:
            density = _density(b.text)
            b.label = "good" if density >= STOP_HIGH or n >= LONG and density >= STOP_LOW else "bad" if density < STOP_LOW else "short"
    # the nearest decided block of the same zone before and behind each place, and the next block that is no heading
    decided = [b.label in ("good", "bad") for b in found]
    before: list[tuple[int, str] | None] = []
    last: dict[int, tuple[int, str]] = {}
    for i, b in enumerate(found):
        before.append(last.get(b.zone))
        if decided[i]:
            last[b.zone] = (i, b.label)
    last, text = {}, None
    for i in range(len(found) - 1, -1, -1):
        b, behind = found[i], last.get(found[i].zone)
        if decided[i]:
            last[b.zone] = (i, b.label)
        elif b.heading and text is not None and text[1] == b.zone and text[2]:
            b.label = text[2]  # a heading goes with its text
        else:
            near = [(abs(j - i), label != "good", label) for j, label in (x for x in (before[i], behind) if x)]
            b.label = min(near)[2] if near else "good" if b.zone == 1 else "bad"
        if not b.heading:
            text = (i, b.zone, b.label if decided[i] else "")
    return found


def _density(text: str) -> float:
    """The share of stop words. Where most letters aren't Latin: whether there are sentences, which stand for them."""
    words = WORD.findall(text.lower())
    letters = "".join(words)
    if sum(c < "\u0250" for c in letters) * 2 < len(letters):
        return 1.0 if SENTENCE.search(text) else 0.0
    return sum(w in STOP for w in words) / max(1, len(words))


def extract(page: str | None) -> str:
    """The main text: good blocks in page order, parted by one space; empty for a null, empty or article-less page."""
    return " ".join(b.text for b in classify(blocks(page)) if b.label == "good")


def main_text(pages: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text to every row. Null and empty pages give an empty text; a column of that name is replaced."""
    keep = [c for c in pages.columns if c != out or c == source]
    if out == source:
        raise ValueError("the text needs a column of its own")
    schema = pages.select(*(F.col(f"`{c}`") for c in keep)).schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, source):
                texts = [extract(t) for t in b.column(b.schema.get_field_index(source)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*keep, out])

    return pages.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)
