"""Links and text of HTML pages, by a parser of the standard library inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

NOISE = frozenset("script style noscript nav header footer aside form svg".split())


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.href: str | None = None
        self.text: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.end()
            self.href, self.text = dict(attrs).get("href"), []

    def handle_data(self, data: str) -> None:
        if self.href is not None:
            self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.end()

    def end(self) -> None:
        if self.href is not None:
            self.found.append((self.href, " ".join("".join(self.text).split())))
        self.href = None


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in NOISE:
            self.inside.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.inside:
            del self.inside[self.inside.index(tag) :]

    def handle_data(self, data: str) -> None:
        if not self.inside and data.strip():
            self.parts.append(" ".join(data.split()))


def parse_links(html: str | None) -> list[tuple[str, str]]:
    """(href, title) of the anchors in order."""
    p = _Links()
    p.feed(html or "")
    p.close()
    p.end()
    return p.found


def parse_text(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    p.close()
    return "\n".join(p.parts)


def links(pages: DataFrame) -> DataFrame:
    """page_id, url in; a row per anchor: page_id, url, ordinal, href, title, absolute (href joined to the url)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("ordinal", pa.int32()), ("href", pa.string()), ("title", pa.string()), ("absolute", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                p = b.slice(at, 256)
                rows = [(i, u, n, h, t, _join(u, h)) for i, u, page in zip(*(c.to_pylist() for c in p.columns), strict=True) for n, (h, t) in enumerate(parse_links(page))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, ordinal int, href string, title string, absolute string")


def _join(url: str | None, href: str) -> str | None:
    try:
        return urljoin(url or "", href)
    except ValueError:
        return None


def texts(pages: DataFrame, most: int | None = None) -> DataFrame:
    """page_id, url and the text of a page without noise elements, a line per text node; most: characters kept."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                p = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array([parse_text(h)[:most] for h in p.column(2).to_pylist()], pa.string())], schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
