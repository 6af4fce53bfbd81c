"""The main content of pages by an element table (K9), and what kind of page it is.

A parser gives every page a table of its elements as an array: each element's place in document order and the
place where its subtree ends, its tag and names; and of its pieces of text, likewise placed. Whether a piece
lies in an element, and whether an element lies in noise, are comparisons of places. Candidates are the
elements that a selector names; each scores the length of its text less a penalty per phrase of navigation,
and the best is the content. All but the parsing are expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NAVIGATION, let, navigation_text, service_url, squash

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = ("script", "style", "noscript", "svg")
PLACED = "elements array<struct<at:int,stop:int,tag:string,id:string,classes:array<string>,names:string>>, pieces array<struct<at:int,text:string>>"


@dataclass(frozen=True)
class Profile:
    """How a site's content is found: tags and parts of names that are noise, selectors of content, what ends a text. Fixed values."""

    noise_tags: tuple[str, ...] = (*RAW, "header", "footer", "nav", "aside", "form")
    noise_names: tuple[str, ...] = ()
    selectors: tuple[str, ...] = ("article", "main", ".content", "#content")
    tails: tuple[str, ...] = ()
    phrases: tuple[str, ...] = NAVIGATION
    penalty: int = 2000
    weak: int = 200
    service_urls: bool = False
    service_text: str = "SERVICE_PAGE navigation page"


GOVERNMENT = Profile(
    noise_names=("nav", "menu", "footer", "header", "share", "social", "archive", "search", "rugovclassifier", "sidebar", "related"),
    selectors=("article", "main", ".news", ".news-item", ".document", ".page-content", ".content", "#content"),
    tails=("поделиться в социальных сетях", "код для вставки в блог", "выделить фрагмент"), service_urls=True, service_text="SERVICE_PAGE government.ru navigation page",
)
MARKET = Profile(
    noise_names=("nav", "menu", "footer", "header", "sidebar", "banner", "advert", "reklam", "comment", "catalog", "price", "analytics", "similar", "related", "subscribe", "forum"),
    selectors=("article", "main", ".content", ".news", ".news-item", "#content", "td", "body"),
    tails=("комментарии", "похожие новости", "подписка", "реклама на сайте", "маркетплейс", "каталог предприятий апк", "телеграм-канал", "мессенджер", "читайте новости", "новости по этой теме", "перейти к списку новостей", "установите мобильное приложение"),
    service_text="SERVICE_PAGE zol.ru navigation page",
)


class _Table(HTMLParser):
    """Elements [at, stop, tag, id, classes, names] and pieces (at, text); an end tag closes what was left open inside it, one without a start is ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self.pieces: list[tuple[int, str]] = []
        self.open: list[int] = []
        self.at = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k: v or "" for k, v in reversed(attrs)}
        names = " ".join(x for x in (own.get("id", ""), " ".join(own.get("class", "").split()), own.get("role", ""), own.get("aria-label", "")) if x).lower()
        self.elements.append([self.at, self.at + 1, tag, own.get("id"), own.get("class", "").split(), names])
        self.at += 1
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if any(self.elements[i][2] == tag for i in self.open):
            while self.open:
                i = self.open.pop()
                self.elements[i][1] = self.at
                if self.elements[i][2] == tag:
                    return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.pieces.append((self.at, data.strip()))
            self.at += 1

    def finish(self) -> _Table:
        self.close()
        for i in self.open:
            self.elements[i][1] = self.at
        return self


def table_of(html: str | None) -> _Table:
    t = _Table()
    t.feed(html or "")
    return t.finish()


def placed(pages: DataFrame) -> DataFrame:
    """page_id, url and the page's elements and pieces. A null html has none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(f"page_id long, url string, {PLACED}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                p = b.slice(at, 64)
                tables = [table_of(h) for h in p.column(2).to_pylist()]
                elements = [[dict(zip(("at", "stop", "tag", "id", "classes", "names"), e, strict=True)) for e in t.elements] for t in tables]
                pieces = [[{"at": i, "text": x} for i, x in t.pieces] for t in tables]
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(elements, schema.field("elements").type), pa.array(pieces, schema.field("pieces").type)], schema=schema)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id long, url string, {PLACED}")


def selected(e: Column, selector: str) -> Column:
    if selector.startswith("."):
        return F.array_contains(e["classes"], selector[1:])
    return F.coalesce(e["id"] == selector[1:], F.lit(False)) if selector.startswith("#") else e["tag"] == selector


def picked(elements: Column, pieces: Column, profile: Profile) -> Column:
    """The text of the best candidate; of equal ones that of the earlier selector, then of the earlier element. Without candidates the whole page's."""
    name = lambda e: F.coalesce(e["names"].rlike("|".join(profile.noise_names)), F.lit(False)) if profile.noise_names else F.lit(False)
    place = lambda e: F.struct(e["at"].alias("at"), e["stop"].alias("stop"))
    inside = lambda at, zones: F.exists(zones, lambda z: (z["at"] <= at) & (at < z["stop"]))

    def rank(e: Column) -> Column:
        out = None
        for i, s in enumerate(profile.selectors):
            out = F.when(selected(e, s), i) if out is None else out.when(selected(e, s), i)
        return out

    def scored(x: Column) -> Column:
        kept = F.filter(pieces, lambda p: ~inside(p["at"], x["noise"]))

        def with_text(kept: Column) -> Column:
            own = F.transform(F.filter(elements, lambda e: rank(e).isNotNull() & ~inside(e["at"], x["noise"])), lambda e: F.struct(rank(e).alias("rank"), e["at"].alias("at"), e["stop"].alias("stop")))
            found = F.when(F.size(own) > 0, own).otherwise(F.array(F.struct(F.lit(0).alias("rank"), F.lit(0).alias("at"), F.lit(2**31 - 1).alias("stop"))))
            texts = F.transform(found, lambda c: F.struct(c["rank"].alias("rank"), c["at"].alias("at"), squash(F.array_join(F.transform(F.filter(kept, lambda p: (c["at"] <= p["at"]) & (p["at"] < c["stop"])), lambda p: p["text"]), " ")).alias("text")))

            def points(c: Column) -> Column:
                out = F.length(c["text"])
                for phrase in profile.phrases:
                    out = out - F.when(F.contains(F.lower(c["text"]), F.lit(phrase)), profile.penalty).otherwise(0)
                return F.struct(out.alias("points"), (-c["rank"]).alias("rank"), (-c["at"]).alias("at"), c["text"].alias("text"))

            return F.array_max(F.transform(F.filter(texts, lambda c: c["text"] != ""), points))["text"]

        return let(kept, with_text)

    noise = F.transform(F.filter(elements, lambda e: e["tag"].isin(*profile.noise_tags) | name(e)), place)
    return F.coalesce(let(F.struct(noise.alias("noise")), scored), F.lit(""))


def trimmed(text: Column, tails: tuple[str, ...]) -> Column:
    """Up to the first of the phrases that end a text."""
    if not tails:
        return text
    return F.trim(F.split(text, "(?iu)" + "|".join(rf"\Q{t}\E" for t in tails), 2)[0])


def content(pages: DataFrame, profile: Profile = GOVERNMENT) -> DataFrame:
    """page_id, url, text, quality (good, weak, empty or navigation) and is_service_page of pages (page_id, url, html)."""
    found = placed(pages).select("page_id", "url", trimmed(picked(F.col("elements"), F.col("pieces"), profile), profile.tails).alias("text"))
    service = navigation_text(F.col("text"), profile.phrases)
    if profile.service_urls:
        service = service | F.coalesce(service_url(F.col("url")), F.lit(False))
    found = found.withColumn("is_service_page", service)
    quality = F.when(F.col("is_service_page"), "navigation").when(F.col("text") == "", "empty").when(F.length("text") < profile.weak, "weak").otherwise("good")
    return found.select("page_id", "url", F.when(F.col("is_service_page"), profile.service_text).otherwise(F.col("text")).alias("text"), quality.alias("quality"), "is_service_page")
