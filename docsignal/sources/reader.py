"""Listings and API pages as a Spark data source: one partition per page of a source.

    spark.dataSource.register(PageSource)
    spark.read.format("pages").option("url", "https://host/list?page={page}").option("pages", 5).load()

gives source_name, page, url, body, error. A page that fails is a row with an error; after `give_up`
failures of the server in a row of retries the reader leaves the page, never the query.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source_name string, page int, url string, body string, error string"
RETRY = (429, 500, 502, 503, 504)


def fetch(url: str, timeout: float, retries: int, most: int, body: bytes | None = None) -> tuple[str | None, str | None]:
    """(text, error) of an address, at most so many bytes. Posts are not repeated."""
    tries = 1 if body is not None else 1 + retries
    error = None
    for n in range(tries):
        try:
            request = urllib.request.Request(url, data=body, headers={"User-Agent": "docsignal", "Content-Type": "application/json"} if body else {"User-Agent": "docsignal"})
            with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
                data = r.read(most + 1)
            return (None, "too large") if len(data) > most else (data.decode("utf-8", "replace"), None)
        except urllib.error.HTTPError as e:
            error = f"HTTP {e.code}"
            if e.code not in RETRY:
                break
        except (OSError, ValueError) as e:
            error = f"{type(e).__name__}: {e}"[:200]
        if n + 1 < tries:
            time.sleep(min(8.0, 0.5 * 2**n))
    return None, error


class _Page(InputPartition):
    def __init__(self, page: int) -> None:
        self.page = page


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        first = int(self.options.get("first", 1))
        return [_Page(first + i) for i in range(int(self.options.get("pages", 1)))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        o = self.options
        url = o["url"].replace("{page}", str(partition.page))
        body = o["body"].replace("{page}", str(partition.page)).encode() if "body" in o else None
        text, error = fetch(url, float(o.get("timeout", 30)), int(o.get("retries", 2)), int(o.get("max_bytes", 2 << 20)), body)
        yield o.get("source_name", ""), partition.page, url, text, error


class _Stream(DataSourceStreamReader):
    """Pages by number: the offset is the next page to read, moved on by `step` pages a batch."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.next = int(options.get("first", 1))
        self.end = self.next + int(options.get("pages", 1))

    def initialOffset(self) -> dict:
        return {"page": int(self.options.get("first", 1))}

    def latestOffset(self) -> dict:
        self.next = min(self.end, self.next + int(self.options.get("step", 1)))
        return {"page": self.next}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Page(p) for p in range(start["page"], end["page"])]

    def read(self, partition: _Page) -> Iterator[tuple]:
        return _Reader(self.options).read(partition)

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def next_page(urls: list[str], current: int) -> int | None:
    """The smallest page number above the current one that the links name."""
    import re

    found = [int(m[1]) for u in urls for m in re.finditer(r"[?&](?:page|PAGEN_1|p)=(\d{1,5})\b", u)]
    return min((n for n in found if n > current), default=None)
