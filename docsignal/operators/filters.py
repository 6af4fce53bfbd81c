"""Filters, orders and searches over documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squash, strip
from ..schema import LEVELS, rank_of


def clamp(n: int, low: int, high: int) -> int:
    return min(max(n, low), high)


def rolling(df: DataFrame, ts: Column, as_of: dt.datetime, days: int) -> DataFrame:
    """Rows of the last days before as_of."""
    return df.filter(ts >= F.lit(as_of - dt.timedelta(days=clamp(days, 1, 365))))


def on_day(df: DataFrame, ts: Column, day: dt.date) -> DataFrame:
    """Rows of a calendar day, as a range that a scan can use."""
    start = dt.datetime.combine(day, dt.time())
    return df.filter((ts >= F.lit(start)) & (ts < F.lit(start + dt.timedelta(days=1))))


def unprocessed(df: DataFrame, flag: str, most: int, *order: Column) -> DataFrame:
    """The work queue: rows whose flag is null, first in, first out."""
    return df.filter(F.col(flag).isNull()).orderBy(*order).limit(most)


def unnotified(df: DataFrame) -> DataFrame:
    return df.filter((F.col("action_level") == LEVELS[0]) & F.col("is_relevant") & ~F.coalesce("notified", F.lit(False)))


def where(df: DataFrame, **wanted: list | str | None) -> DataFrame:
    """A conjunction of optional conditions: None is no condition, a list is IN."""
    for name, v in wanted.items():
        if v is not None:
            df = df.filter(F.col(name).isin(*v) if isinstance(v, (list, tuple)) else F.col(name) == v)
    return df


def relevance_order(level: Column, importance: Column, ts: Column, collected: Column, key: Column) -> list[Column]:
    return [rank_of(level, LEVELS).desc(), rank_of(importance, ("high", "medium", "low")).desc(), ts.desc(), collected.desc(), key.desc()]


def search(df: DataFrame, query: str, fields: list[str], most: int, level: Column, *recency: Column) -> DataFrame:
    """Rows that hold the query in a field, Unicode case folded: higher levels first, then the better match (whole first field, then field by field), then recency."""
    q = query.lower()
    hit = [F.contains(F.lower(F.col(f)), F.lit(q)) for f in fields]
    any_ = F.lit(False)
    for h in hit:
        any_ = any_ | F.coalesce(h, F.lit(False))
    quality = F.when(F.lower(F.col(fields[0])) == q, len(fields) + 1)
    for i, h in enumerate(hit):
        quality = quality.when(h, len(fields) - i)
    found = df.filter(any_).withColumns({"level_points": level, "match_points": quality.otherwise(0)})
    return found.orderBy(F.desc("level_points"), F.desc("match_points"), *recency).limit(clamp(most, 1, 20))


def scan_candidate(file_type: Column, recognised: Column, length: Column, pages: Column, needs: Column | None = None, least: int = 0) -> Column:
    """A file whose text should be recognised from its pages: a PDF not recognised yet, without text, marked so, or
    with under 120 characters a page on three pages and more. least: shorter texts count too, as after a first reading."""
    thin = (length == 0) | (length < least) | ((F.coalesce(pages, F.lit(0)) >= 3) & (length < 120 * F.coalesce(pages, F.lit(0))))
    if needs is not None:
        thin = thin | F.coalesce(needs, F.lit(False))
    return F.coalesce((F.lower(file_type) == "pdf") & ~F.coalesce(recognised, F.lit(False)) & thin, F.lit(False))


def should_refresh(prefetched: Column, role: Column) -> Column:
    """Whether a stored address is read again: its text is there already, or its page keeps its address while it changes."""
    return (F.coalesce(F.length(prefetched), F.lit(0)) > 0) | F.coalesce(role == "active_support_measures", F.lit(False))


def backfill_reason(old: Column, new: Column, title: Column, share: float = 0.5) -> Column:
    """Why a new text does not replace the old one: it is empty, or shorter than the share and without the title or its first six words. Null if it does."""
    length = lambda c: F.length(strip(F.coalesce(c, F.lit(""))))
    flat = lambda c: F.lower(squash(F.coalesce(c, F.lit(""))))
    whole = flat(title)
    words = F.regexp_extract_all(whole, F.lit(r"(?U)\w+"), F.lit(0))
    start = F.concat_ws(" ", F.slice(words, 1, 6))
    titled = ((whole != "") & F.contains(flat(new), whole)) | ((F.size(words) >= 4) & F.contains(flat(new), start))
    short = (length(old) > 0) & (length(new) < F.floor(length(old) * share)) & ~titled
    return F.when(length(new) == 0, "skipped_empty_text").when(short, "skipped_low_quality")


#: Levels that are worth an enrichment, states of one that may be shown, and what its words of confidence count: fixed values.
ENRICHED_LEVELS, SHOWN_STATES = ("requires_attention", "watchlist"), ("success", "fallback")
CONFIDENCE, LEAST_CONFIDENCE = {"high": 0.9, "medium": 0.75, "low": 0.45}, 0.5


def enrichment_eligible(level: Column) -> Column:
    """Whether a document of the level is enriched."""
    return F.coalesce(F.trim(level).isin(*ENRICHED_LEVELS), F.lit(False))


def enrichment_shown(status: Column, error: Column, version: Column, confidence: Column, words: Column, has_facts: Column, current: str, least: float = LEAST_CONFIDENCE) -> Column:
    """Whether a stored enrichment is shown: a good state (a missing one is good), no error unless it is a fallback, facts of the current version, and confidence enough.

    confidence: a number, which counts before words; without both, and for rows without facts, nothing is asked of it.
    """
    state = F.lower(F.trim(F.coalesce(F.nullif(status, F.lit("")), F.lit("success"))))
    failed = (F.trim(F.coalesce(error, F.lit(""))) != "") & (state != "fallback")
    own = F.trim(F.coalesce(version, F.lit("")))
    spoken = F.lit(0.0)
    for word, n in CONFIDENCE.items():
        spoken = F.when(F.lower(F.trim(words)) == word, n).otherwise(spoken)
    score = F.coalesce(confidence.cast("double"), F.when(has_facts, spoken))
    return state.isin("", *SHOWN_STATES) & ~failed & ~(has_facts & (own != "") & (own != current)) & F.coalesce(score >= least, F.lit(True))
