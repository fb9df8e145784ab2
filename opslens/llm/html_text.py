"""Main text of web pages by two passes of block rules.

Sections set apart (navigation, forms, comments and the like) are left out. The first pass
decides every other block by its link density, its length and its share of stop words, or
leaves it open. Standing in an article is one more feature there: it leaves open what would
else be boilerplate. The second pass gives an open block the label of the nearest decided
block of the same article, or of the blocks outside articles for a block outside. Where none
of these is decided, it is text unless the page has text elsewhere (as with teaser cards).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import map_arrow, texts_of

# Common stop words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
a an and are as at be but by for from had has have he his in is it its not of on or she that the their they this to
was were which will with you
aber als am auch auf aus bei das dem den der des die durch ein eine einen einer er es für hat ich im in ist mit nach
nicht oder sich sie sind um und von war wie wird zu zum zur
au aux avec ce cette dans de des du elle en est et il je la le les leur mais ne nous ou par pas pour qu que qui sa se
ses son sont sur un une vous
al como con de del el ella en entre es esta este fue la las lo los más no para pero por que se ser si sin sobre son su
sus un una y ya
""".split())
# Tags that start a new block, tags whose content is no text, tags without content.
BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main nav noscript ol option p pre
section select summary table tbody td tfoot th thead tr ul""".split())
RAW_TAGS = frozenset("script style title textarea template noscript iframe svg math object select".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Sections that are never part of an article, by tag, role, and words of class or id.
APART_TAGS = frozenset("nav footer aside form button dialog head".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu".split())
APART_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
consent cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter
notice notices pagination popup promo promotion promoted related reply respond replies share sharing sidebar signup
social sponsor sponsored subscribe tags toolbar widget""".split())
#: What may stand beside such a word in a class or id; with any other word the name means something else.
FRAME_WORDS = frozenset("""area article bar block body bottom box button buttons card cards center col column container content
div entry fixed footer form global group head header home icons inner item items js left link links list local main meta nav
outer page panel post posts primary right row secondary section site slot space sticky sub text top unit user view wrap
wrapper""".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?", re.S)
_HINTS = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rules:
    short: int = 70
    long: int = 200
    stop_low: float = 0.15
    stop_high: float = 0.25
    link_density: float = 0.3


@dataclass
class Block:
    text: str
    linked: int
    apart: bool
    article: int


def _names_apart(name: str) -> bool:
    """Whether a class or id names a section set apart: by its words, and no word of another meaning."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return any(p in APART_WORDS for p in parts) and all(p in APART_WORDS or p in FRAME_WORDS or len(p) < 3 for p in parts)


def _apart(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in APART_TAGS or (tag == "header" and not in_article):
        return True
    for name, *values in _HINTS.findall(attributes) if "=" in attributes else ():
        value = "".join(values)
        if name.lower() == "role":
            if value.lower().strip() in APART_ROLES:
                return True
        elif tag not in ("html", "body", "article", "main") and any(map(_names_apart, value.split())):
            if not (in_article and tag[0] == "h" and tag[1:].isdigit()):
                return True
    return False


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order. Tags that stay open, and what is cut off at the end, are taken as they come."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # tag, apart, article number (0: none)
    text: list[str] = []
    linked: list[str] = []
    anchors, articles, at, size = 0, 0, 0, len(html)

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                apart, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
                out.append(Block(joined, len(" ".join("".join(linked).split())), apart, article))
            text.clear()
            linked.clear()

    while at < size:
        m = _TOKEN.search(html, at)
        chunk = html[at:m.start()] if m else html[at:]
        if chunk:
            decoded = unescape(chunk)
            text.append(decoded)
            if anchors:
                linked.append(decoded)
        if not m:
            break
        at = m.end()
        closing, tag = m.group(1), (m.group(2) or "").lower()
        if not tag:
            continue
        if tag == "a":
            anchors = max(0, anchors - 1) if closing else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if closing:
            if tag in BLOCK_TAGS:
                flush()
            if any(tag == s[0] for s in stack):
                flush()
                while stack.pop()[0] != tag:
                    pass
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
            anchors = 0
            if tag in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == tag:
                stack.pop()  # the end tag is optional
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            if not m.group(0).endswith("/>"):
                at = end.end() if end else size
            continue
        if tag in VOID_TAGS:
            continue
        apart, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        hinted = _apart(tag, m.group(3) or "", article > 0)
        if tag in ("article", "main") and not apart and not article:
            articles += 1
            article = articles
        if hinted and not block:
            flush()
        if hinted or (block and tag not in ("p", "li", "dt", "dd", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6")):
            stack.append((tag, apart or hinted, article))
    flush()
    return out


def stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def decide(b: Block, rules: Rules, known: bool = True, last: bool = False) -> bool | None:
    """True for text, False for boilerplate, None where the block is too short to tell.

    Where no block of the page has stop words enough to be of a ``known`` language, they tell
    nothing: length and link density decide alone. A short ``last`` block with a copyright sign is boilerplate.
    """
    size = len(b.text)
    against = None if b.article else False
    if b.linked > rules.link_density * size:
        return against  # a list of references, or a paragraph that is one link
    if last and size <= rules.long and "\xa9" in b.text:
        return against
    if size < rules.short and (known or b.linked):
        return against if b.linked else None
    if not known:  # scripts without spaces say more in fewer characters
        return True if size >= rules.short else None
    stops = stop_share(b.text)
    if stops >= rules.stop_high:
        return True if size > rules.long else None
    return None if stops >= rules.stop_low else against


def main_text(html: str, rules: Rules = Rules()) -> str:
    blocks = [b for b in blocks_of(html) if not b.apart]  # sections set apart say nothing about their neighbours
    known = any(stop_share(b.text) >= rules.stop_low for b in blocks if b.linked <= rules.link_density * len(b.text))
    first = [decide(b, rules, known, b is blocks[-1]) for b in blocks]
    before, after = _nearest(first, blocks, 1), _nearest(first, blocks, -1)
    elsewhere = any(first)
    kept = []
    for i, (b, label) in enumerate(zip(blocks, first, strict=True)):
        if label is None:
            (d1, l1), (d2, l2) = before[i], after[i]
            if l1 is None and l2 is None:
                label = not elsewhere
            elif d1 == d2:
                label = bool(l1 or l2) if b.article else bool(l1 and l2)
            else:
                label = l1 if d1 < d2 else l2
        if label:
            kept.append(b.text)
    return "\n".join(kept)


def _nearest(first: list[bool | None], blocks: list[Block], step: int) -> list[tuple[int, bool | None]]:
    """For each block, distance and label of the nearest decided one on one side, in the same article."""
    out: list[tuple[int, bool | None]] = [(1 << 30, None)] * len(blocks)
    last: dict[int, tuple[int, bool]] = {}
    for i in range(len(blocks))[::step]:
        article = blocks[i].article
        if article in last:
            out[i] = (abs(i - last[article][0]), last[article][1])
        if first[i] is not None:
            last[article] = (i, first[i])
    return out


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per page: page_id, url, text and n_chars. Null html counts as empty and gives an empty text;
    null ids and urls are carried along, repeated rows give a row each; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                got = [main_text(h, rules) for h in texts_of(part.column(2))]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(got), pa.array(
                    [len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                                  "html"), run, "page_id long, url string, text string, n_chars long")
