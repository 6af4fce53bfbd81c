"""Main text of web pages by the maximum-scoring subsequence (operator 9).

A page becomes a sequence of words and tags. A word scores the log-odds, learned from labelled pages,
that a word in its surroundings (zone, block, link) is content; a tag scores below zero. One linear
scan finds the contiguous region of the greatest sum; inside it, blocks whose surroundings are
themselves noise (a comment list or an advert in the middle of an article) are left out.

The labelled pages are the hand-marked examples of html_labelled.py and, up to a bounded sample
(`sample` pages, by hash of page_id), pages of the table that mark their article by an element.

Defined results: null and empty html give an empty text. A page cut off in the middle ends there; open
elements end with it. Repeated pages get equal texts. Ties between regions go to the first. An empty
table gives an empty result. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as html_module
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table
from .html_labelled import PAGES

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title|head|select|object|canvas|audio|video|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:\b(?:class|id|role|aria-label|itemprop|data-role|data-component))\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?(?:false|until))|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PART = re.compile(r"[a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the same kind.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Zones by element, and by the parts of class, id and role names.
ELEMENT_ZONE = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "fieldset": "form", "dialog": "notice", "article": "article", "main": "article"}
NAME_ZONE = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar pagination pager tabs toc skip sitemap",
    "header": "header masthead banner hero branding logo",
    "footer": "footer colophon copyright legal bottom",
    "aside": "sidebar aside related recommended recommendations trending popular widget widgets complementary rail more also",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall toast disclaimer",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense dfp banner_ad",
    "form": "form login search searchbox signin register",
    "comment": "comment comments commentlist reply replies respond disqus discussion responses",
    "share": "share sharing social tags tag byline meta author",
    "article": "article content post entry story main body text articlebody postbody maincontent",
}
#: Endings of run-together names such as topnav or siteheader.
ENDINGS = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "comments": "comment", "comment": "comment", "banner": "ad", "advert": "ad", "adslot": "ad", "adbox": "ad", "adunit": "ad", "notice": "notice", "popup": "notice"}
ZONE_OF = {part: zone for zone, parts in NAME_ZONE.items() for part in parts.split()}
NOISE = frozenset("nav header footer aside notice ad form comment share hidden".split())
BLOCKS = frozenset("p li td h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption div".split())


def zone_of(tag: str, attributes: str) -> str | None:
    """The zone that an element opens, if any. Noise by name wins over content by name."""
    if HIDDEN.search(attributes):
        return "hidden"
    by_tag = ELEMENT_ZONE.get(tag)
    if by_tag and by_tag != "article":
        return by_tag
    if tag in ("body", "html"):
        return None
    found = []
    for m in ATTRIBUTE.finditer(attributes):
        name = (m[1] or m[2] or m[3] or "").lower()
        parts = PART.findall(name)
        found += [ZONE_OF[x] for x in parts if x in ZONE_OF]
        found += [ZONE_OF[x] for x in ("".join(parts),) if x in ZONE_OF]
        found += [z for x in parts if x not in ZONE_OF for e, z in ENDINGS.items() if x.endswith(e)]
    noise = [z for z in found if z in NOISE]
    if by_tag == "article":
        return "comment" if "comment" in noise else "article"
    if noise:
        # an element named after both is noise, unless its last name is content and the others say who wrote it or where it is shared (post-author-content)
        return "article" if found[-1] == "article" and set(noise) == {"share"} else noise[-1]
    return "article" if found else None


class Block:
    __slots__ = ("zone", "tag", "link", "text", "before", "inside")

    def __init__(self, zone: str, tag: str, inside: bool) -> None:
        self.zone, self.tag, self.link, self.text, self.before, self.inside = zone, tag, False, [], 0, inside


def blocks(page: str) -> list[Block]:
    """The page's blocks in order: zone, enclosing block tag, whether all words are links, text pieces, tags since the last block."""
    out: list[Block] = []
    stack: list[tuple[str, str | None]] = []
    zones: list[str] = []
    now: Block | None = None
    tags = links = linked = words = 0

    def close() -> None:
        nonlocal now, linked, words
        if now is not None:
            now.link = words > 0 and linked * 2 > words
            out.append(now)
        now, linked, words = None, 0, 0

    def pop(upto: int) -> None:
        nonlocal links
        for name, zone in reversed(stack[upto:]):
            if zone:
                zones.pop()
            if name == "a":
                links -= 1
        del stack[upto:]

    def add(piece: str) -> None:
        nonlocal now, tags, linked, words
        if now is None:
            if not piece.strip():
                return
            inside = next((n for n, _ in reversed(stack) if n in BLOCKS), "div")
            now = Block(next((z for z in reversed(zones) if z in NOISE), "article" if zones else "other"), inside, "article" in zones)
            now.before, tags = tags, 0
        now.text.append(piece)
        n = len(piece.split())
        words += n
        if links:
            linked += n

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(html_module.unescape(page[at : m.start()]))
        at = m.end()
        if m[3] is None:
            if m[1] is not None:
                tags += 1
                close()
            continue
        name, attributes = m[3].lower(), m[4]
        tags += 1
        if name not in INLINE:
            close()
        if m[2]:
            open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if open_at is not None:
                pop(open_at)
            continue
        if name in VOID or attributes.endswith("/"):
            if name == "br":
                close()
            continue
        if name in ENDS_P and stack and any(n == "p" for n, _ in stack[-4:]):
            pop(max(i for i, (n, _) in enumerate(stack) if n == "p"))
        elif name in SELF_CLOSING and stack and stack[-1][0] in SELF_CLOSING[name]:
            pop(len(stack) - 1)
        zone = zone_of(name, attributes)
        if name in ("article", "main") and zone == "article" and not any(z == "comment" for z in zones):
            pop(0)  # an article does not lie in a menu or advert that was left open
        if name == "a":
            links += 1
        stack.append((name, zone))
        if zone:
            zones.append(zone)
    if at < len(page):
        add(html_module.unescape(page[at:]))
    close()
    return out


def words_of(b: Block) -> str:
    return " ".join("".join(b.text).split())


def counts(page: str, content: set[int] | None = None) -> Counter:
    """(kind, value, is content) counts of a labelled page. content: numbers of its content blocks; None: the blocks inside article elements."""
    n: Counter = Counter()
    for i, b in enumerate(blocks(page)):
        good = i in content if content is not None else b.zone == "article"
        k = len(words_of(b).split())
        n["zone", b.zone, good] += k
        n["block", b.tag, good] += k
        n["link", str(b.link), good] += k
        n["words", "", good] += k
        n["tags", "", good] += b.before
    return n


def weights(n: Counter, smooth: float = 20.0) -> dict[tuple[str, str], float]:
    """Log-odds of content by zone, block and link, and the score of a tag."""
    good, bad = n["words", "", True] + smooth, n["words", "", False] + smooth
    out = {}
    for kind, value, _ in list(n):
        if kind in ("zone", "block", "link"):
            out[kind, value] = max(-4.0, min(4.0, math.log((n[kind, value, True] + smooth * good / (good + bad)) / good) - math.log((n[kind, value, False] + smooth * bad / (good + bad)) / bad)))
    out["tag", ""] = -max(0.1, math.log((n["tags", "", False] / bad + 0.02) / (n["tags", "", True] / good + 0.02)))
    return out


def labelled_counts() -> Counter:
    """Counts of the hand-marked pages, whose content blocks are those that hold a marked text."""
    n: Counter = Counter()
    for page, content in PAGES:
        n += counts(page, {i for i, b in enumerate(blocks(page)) if words_of(b) in content})
    return n


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the first contiguous run of the greatest positive sum; (0, 0) if none is positive."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def extract(page: str | None, w: dict[tuple[str, str], float]) -> str:
    bs = blocks(page or "")
    texts = [words_of(b) for b in bs]
    tag = w.get(("tag", ""), -1.0)
    each = [w.get(("zone", b.zone), -4.0 if b.zone in NOISE else 0.5) + w.get(("block", b.tag), 0.0) * (0.5 if b.zone == "article" else 1) + w.get(("link", str(b.link)), 0.0) for b in bs]
    # a scan over words and tags; equal scores inside a block let it step block by block
    # where an article is marked and holds most of the words, words outside it count against
    held = {z: sum(len(t.split()) for b, t in zip(bs, texts, strict=True) if b.zone == z) for z in ("article", "other")}
    if held["article"] > held["other"]:
        each = [min(s, -1.0) if b.zone == "other" else s for b, s in zip(bs, each, strict=True)]
    # a tag inside an article costs a tenth, as a short heading there must not be lost, and noise inside it costs nothing, as it is left out below
    start, end = best_region([0.0 if b.inside and b.zone in NOISE else len(t.split()) * s + b.before * tag * (0.1 if b.inside else 1) for b, t, s in zip(bs, texts, each, strict=True)])
    return " ".join(t for b, t, s in zip(bs[start:end], texts[start:end], each[start:end], strict=True) if t and (s > 0 or (b.zone == "article" and not (b.link and s < -4))) and b.zone not in NOISE)


COUNTS = "kind string, value string, good boolean, n long"


def fit(pages: DataFrame, sample: int = 2000) -> dict[tuple[str, str], float]:
    """Weights from the hand-marked pages and at most `sample` pages that mark their article."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        n: Counter = Counter()
        for (page,) in rows:
            if page and re.search(r"<(?:article|main)\b", page, re.I):
                n += counts(page)
        yield from ((*k, v) for k, v in n.items())

    # the sample is chosen by ids alone, so that no html meets in one task
    ids = pages.select("page_id").filter("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    some = pages.select("page_id", "html").join(F.broadcast(ids), "page_id", "left_semi").select("html")
    got = map_rows(some, run, COUNTS).groupBy("kind", "value", "good").agg(F.sum("n").alias("n")).collect()
    n = labelled_counts()
    total = sum(r["n"] for r in got if r["kind"] == "words")
    own = sum(v for k, v in n.items() if k[0] == "words")
    for r in got:  # the table's pages weigh as much as the hand-marked ones: their templates are few
        n[r["kind"], r["value"], r["good"]] += r["n"] * own / max(total, 1)
    return weights(n)


def main_text(pages: DataFrame, sample: int = 2000) -> DataFrame:
    w = fit(pages, sample)

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for page_id, url, page in rows:
            text = extract(page, w)
            yield page_id, url, text, len(text)

    return map_rows(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, "page_id long, url string, text string, n_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
