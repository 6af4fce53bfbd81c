"""Url expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = {"pdf": "pdf", "docx": "docx", "doc": "doc", "xlsx": "xlsx", "xls": "xls", "zip": "zip", "rar": "archive", "xml": "xml", "html": "html", "htm": "html"}


def host(url: Column) -> Column:
    """Host in lower case, with a port if there is one; empty without ://."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_label(url: Column, fallback: Column) -> Column:
    """Host without www., else the fallback."""
    return F.coalesce(F.nullif(F.regexp_replace(host(url), r"^www\.", ""), F.lit("")), fallback)


def canonical_key(url: Column, twins: str | None = None) -> Column:
    """Scheme and host in lower case, no fragment, no trailing slash, the query kept. twins: a pattern whose group 1 alone makes the key (twin addresses of one page)."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    start = F.regexp_extract(bare, r"^[^:]*://[^/?]*", 0)
    rest = F.substr(bare, F.length(start) + 1, F.greatest(F.length(bare), F.lit(1)))
    key = F.concat(F.lower(start), F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), "/+$", ""), F.regexp_extract(rest, r"\?.*$", 0))
    if twins:
        key = F.when(url.rlike(twins), F.concat(host(url), F.lit("::"), F.regexp_extract(url, twins, 1))).otherwise(key)
    return F.nullif(key, F.lit(""))


def document_type(url: Column) -> Column:
    """By the path's suffix; none is html, one that is not known `unknown`."""
    suffix = F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]{1,5})$", 1))
    out = F.when(suffix == "", "html")
    for s, t in TYPES.items():
        out = out.when(suffix == s, t)
    return out.otherwise("unknown")


def allowed(url: Column, base: Column, allow: list[str], deny: list[str]) -> Column:
    """Same host or an attachment, not the base itself, no denied part, and an allowed part if any are named."""
    file = ~document_type(url).isin("html", "unknown")
    low = F.lower(url)
    has = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(low, p)) if parts else F.lit(False)
    return ((host(url) == host(base)) | file) & (canonical_key(url) != canonical_key(base)) & ~has(deny) & (has(allow) if allow else F.lit(True))
