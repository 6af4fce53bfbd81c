"""Scores, sections, hashes and state machines of the monitor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, strip
from ..schema import rank_of


def content_hash(text: Column, fallback: Column) -> Column:
    """SHA-256 of the text without white space at its ends; of the fallback for blank text, lest all empty rows collide."""
    return F.sha2(F.when(blank(text), fallback).otherwise(strip(text)), 256)


def status_hash(*fields: Column) -> Column:
    """Of fields in order, null as empty."""
    return F.sha2(F.concat_ws("||", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)


def fact_points(deadline: Column, application: Column, support: Column, *others: Column) -> Column:
    """3 for a deadline, 2 for a known application status, 1 for a support status and each other fact."""
    has = lambda c: (~blank(c)).cast("int")
    known = lambda c: F.coalesce((c != "unknown") & ~blank(c), F.lit(False)).cast("int")
    out = 3 * has(deadline) + 2 * known(application) + known(support)
    for o in others:
        out = out + has(o)
    return out


def importance(level: Column) -> Column:
    return F.when(level == "requires_attention", "high").when(level == "watchlist", "medium").otherwise("low")


def change_summary(pairs: list[tuple[str, Column, Column]]) -> Column:
    """`name: old → new` for each pair that differs."""
    shown = lambda c: F.coalesce(F.nullif(strip(c.cast("string")), F.lit("")), F.lit("—"))
    return F.concat_ws("; ", *(F.when(~a.eqNullSafe(b), F.concat(F.lit(f"{n}: "), shown(a), F.lit(" → "), shown(b))) for n, a, b in pairs))


def hysteresis(cycles: DataFrame, failed: Column, key: str, *order: Column) -> DataFrame:
    """One alert at the start of each run of failed cycles: rows with the state, and `alert` where it turns."""
    w = Window.partitionBy(key).orderBy(*order)
    return cycles.withColumn("state", F.when(failed, "alerted").otherwise("ok")).withColumn("alert", (F.col("state") == "alerted") & (F.coalesce(F.lag("state").over(w), F.lit("ok")) == "ok"))


def once_per_day(df: DataFrame, day: Column, *order: Column) -> DataFrame:
    """The first row of each day."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(day).orderBy(*order))).filter("_n = 1").drop("_n")


def queue_priority(level: Column, page_type: Column, urgent_types: list[str]) -> Column:
    return F.when(level == "requires_attention", "high").when((level == "watchlist") & page_type.isin(*urgent_types), "high").when(level == "watchlist", "medium").otherwise("low")


def queue_order(priority: Column, status: Column, updated: Column, key: Column) -> list[Column]:
    return [rank_of(priority, ("high", "medium", "low")).desc(), rank_of(status, ("pending", "in_review", "done", "skipped")).desc(), updated.desc(), key.desc()]


def read_filters(url: Column, title: Column, base_host: Column, deny: list[str], stop_titles: list[str]) -> Column:
    """Why a listing's link is dropped, null if it is kept."""
    from ..functions.urls import document_type, host

    low = F.lower(url)
    return (
        F.when(blank(title), "empty_title").when(title.isin(*stop_titles), "stop_title").when(title.rlike(r"^\d{1,3}$"), "page_number")
        .when(F.exists(F.array(*map(F.lit, deny)), lambda p: F.contains(low, p)), "denied").when((host(url) != base_host) & document_type(url).isin("html", "unknown"), "external")
    )
