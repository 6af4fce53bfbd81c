"""The report: best rows, visible rows, sections with caps, Markdown."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..operators import latest, monitor
from ..schema import LEVELS, SECTIONS, rank_of


@dataclass(frozen=True)
class Policy:
    """What a deployment decides: regions, markers, caps."""

    target_regions: tuple[str, ...] = ()
    federal_markers: tuple[str, ...] = ()
    market_markers: tuple[str, ...] = ()
    evergreen_titles: tuple[str, ...] = ()
    role_of: dict[str, str] = field(default_factory=dict)
    urgent_cap: int = 5
    section_cap: int = 5
    budget: int = 60
    near_days: int = 7


def effective_level(policy: Policy) -> Column:
    """The level after what overrides it, in order: market news are background, other regions irrelevant, unreadable scans background."""
    level = F.coalesce(F.col("action_level"), F.lit(LEVELS[3]))
    scope = geo_scope(policy)
    weak_scan = (F.col("document_type") == "pdf") & text.unreadable(F.coalesce("raw_text", F.lit("")))
    urgent = level.isin(*LEVELS[:2])
    return F.when(urgent & (scope == "global_market"), LEVELS[2]).when(urgent & (scope == "non_target_region"), LEVELS[3]).when(urgent & weak_scan, LEVELS[2]).otherwise(level)


def geo_scope(policy: Policy) -> Column:
    body = F.concat_ws(" ", "title", "region", F.substring("raw_text", 1, 5000))
    target = text.any_of(body, list(policy.target_regions))
    return F.when(F.col("region").isin(*policy.target_regions) | target, "target_region").when(text.any_of(F.col("title"), list(policy.market_markers)), "global_market").when((F.col("level") == "federal") | text.any_of(body, list(policy.federal_markers)), "federal").otherwise("non_target_region")


def role(policy: Policy) -> Column:
    out = F.lit("support_documents")
    for source, r in policy.role_of.items():
        out = F.when(F.col("source_name") == source, r).otherwise(out)
    return out


def section(level: Column, role_: Column) -> Column:
    """Urgent rows by level, others by role."""
    return F.when(level == LEVELS[0], SECTIONS[0]).when(role_.isin("active_support_measures", "support_documents"), SECTIONS[1]).when(role_ == "regional_npa", SECTIONS[2]).when(role_ == "strategy", SECTIONS[3]).otherwise(SECTIONS[4])


def selected(documents: DataFrame, as_of: dt.datetime, days: int, policy: Policy) -> DataFrame:
    """Visible rows of the period with level, section, deadline and score; duplicates by url, content and title are gone."""
    ts = dates.event_ts(F.col("published_at"), F.col("collected_at"))
    period = documents.filter((ts >= F.lit(as_of - dt.timedelta(days=days))) & (ts <= F.lit(as_of + dt.timedelta(days=2)))).withColumn("event_ts", ts)
    day = dates.parse_deadline(F.coalesce("deadline_text", F.lit("")))
    known = period.withColumns({"effective_level": effective_level(policy), "role": role(policy), "deadline": day, "deadline_status": dates.deadline_class(day, F.lit(as_of.date()), policy.near_days)})
    facts = monitor.fact_points(F.col("deadline_text"), F.col("application_status"), F.col("support_status"), F.col("npa_number"), F.col("terms_text"), F.col("business_signal"))
    closed = (F.col("application_status") == "closed") | (F.col("deadline_status") == "expired")
    score = F.when(F.col("effective_level") == LEVELS[0], 100).otherwise(0) + F.when(F.col("deadline").isNotNull(), 40).otherwise(0) + F.when(F.col("application_status") == "open", 35).otherwise(0) + F.when(F.col("support_status") == "active", 2).otherwise(0) - F.when(closed, 80).otherwise(0)
    known = known.withColumns({"facts": facts, "closed": closed, "score": score, "section": section(F.col("effective_level"), F.col("role"))})
    order = [rank_of(F.col("effective_level"), LEVELS), F.col("facts"), text.quality_points(F.col("raw_text"))]
    one = latest.best_of(known, urls.canonical_key(F.col("url")), order, F.col("id")).drop("position")
    one = latest.best_of(one, F.col("content_hash"), order, F.col("id")).drop("position")
    title = text.key_of(F.col("title"))
    one = latest.best_of(one, F.when(F.length(title) >= 24, title), order, F.col("id")).drop("position")
    evergreen = text.any_of(F.col("title"), list(policy.evergreen_titles)) & F.col("deadline").isNull()
    return one.filter(F.col("effective_level").isin(*LEVELS[:2])).filter(~evergreen)


def placed(rows: DataFrame, policy: Policy) -> DataFrame:
    """Rows in sections with places: urgent rows over the cap move to the section of their role, at most one closed row a section, sections are capped, the budget spares urgent rows."""
    urgent = F.col("section") == SECTIONS[0]
    order = [F.desc("score"), F.desc("event_ts"), F.col("id")]
    first = F.row_number().over(Window.partitionBy("section").orderBy(*order))
    moved = rows.withColumn("_n", first).withColumn("section", F.when(urgent & (F.col("_n") > policy.urgent_cap), section(F.lit(""), F.col("role"))).otherwise(F.col("section"))).drop("_n")
    moved = latest.running_limit(moved, F.col("closed"), ["section"], 1, *order)
    w = Window.partitionBy("section")
    counted = moved.withColumns({"place": F.row_number().over(w.orderBy(*order)), "in_section": F.count("*").over(w)})
    shown = counted.filter(F.col("place") <= policy.section_cap).withColumn("left_out", F.greatest(F.col("in_section") - policy.section_cap, F.lit(0)))
    used = Window.orderBy((F.col("section") != SECTIONS[0]).cast("int"), rank_of(F.col("section"), SECTIONS).desc(), "place")
    # at most section_cap rows of each section are left here
    return shown.withColumn("number", F.row_number().over(used)).filter((F.col("section") == SECTIONS[0]) | (F.col("number") <= policy.budget))


def markdown(rows: DataFrame, title: str) -> DataFrame:
    """One column of lines in order: a heading per section, two lines per row, the number left out."""
    item = F.concat_ws("\n", F.concat(F.lit("- **"), text.clip_words(F.col("title"), 160), F.lit("**")), F.when(~text.blank(F.col("summary")), F.concat(F.lit("  "), text.clip_sentence(F.col("summary"), 300))), F.when(F.col("deadline").isNotNull(), F.concat(F.lit("  deadline: "), F.col("deadline").cast("string"), F.lit(" ("), F.col("deadline_status"), F.lit(")"))), F.concat(F.lit("  "), F.col("url")))
    lines = rows.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("place", item.alias("line")))).alias("l"), F.max("left_out").alias("left_out"))
    body = F.concat_ws("\n", F.concat(F.lit("## "), F.col("section")), F.concat_ws("\n", F.transform("l", lambda x: x["line"])), F.when(F.col("left_out") > 0, F.concat(F.lit("… and "), F.col("left_out"), F.lit(" more"))))
    parts = lines.agg(F.sort_array(F.collect_list(F.struct((-rank_of(F.col("section"), SECTIONS)).alias("o"), body.alias("b")))).alias("p"))
    return parts.select(F.concat_ws("\n\n", F.lit(f"# {title}"), F.transform("p", lambda x: x["b"])).alias("value"))


def save_markdown(report: DataFrame, path: str) -> None:
    """One text file."""
    report.coalesce(1).write.mode("overwrite").text(path)
