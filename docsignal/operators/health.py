"""Freshness, schedules, locks and the figures of a state, as expressions and aggregates. `as_of` is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LEVELS

#: Minutes that data count as fresh, and after which a collection counts as late; days after which a source is stale: fixed values.
FRESH_MINUTES, LATE_MINUTES = 60, 24 * 60
STALE_DAYS = {"news_signals": 3}
STALE_DAYS_ELSE = 7


def minutes(since: Column, as_of: Column) -> Column:
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(since)) / 60)


def freshness(success: Column, latest: Column, attempted: Column, degraded: Column, as_of: Column) -> Column:
    """unconfirmed (tried, never done), unknown, partial (sources failed or stale), late, fresh or stale.

    success: when sources were last collected. latest: the last event of any kind, for when that is null.
    """
    age = minutes(F.coalesce(success, latest), as_of)
    return (
        F.when(attempted.isNotNull() & success.isNull(), "unconfirmed").when(age.isNull(), "unknown").when(degraded > 0, "partial")
        .when(attempted.isNotNull() & (age > LATE_MINUTES), "late").when(age <= FRESH_MINUTES, "fresh").otherwise("stale")
    )


def stale_source(success: Column, role: Column, as_of: Column) -> Column:
    """Whether a source has been silent for longer than its role allows."""
    days = F.lit(STALE_DAYS_ELSE)
    for r, n in STALE_DAYS.items():
        days = F.when(role == r, n).otherwise(days)
    return F.coalesce(minutes(success, as_of) > days * 24 * 60, F.lit(True))


def slot_due(now: Column, slots: tuple[str, ...], done: Column) -> Column:
    """Whether a run is due: always without slots, else in a slot's minute (HH:MM) unless `done`, an array of yyyy-MM-dd HH:MM, holds it."""
    if not slots:
        return F.lit(True)
    return F.date_format(now, "HH:mm").isin(*slots) & ~F.coalesce(F.array_contains(done, F.date_format(now, "yyyy-MM-dd HH:mm")), F.lit(False))


def cooldown_left(last: Column, now: Column, hours: float = 3) -> Column:
    """Seconds until a run by hand is free again; 0 if it is."""
    return F.coalesce(F.greatest(F.lit(0), F.lit(int(hours * 3600)) - (F.unix_timestamp(now) - F.unix_timestamp(last))), F.lit(0)).cast("long")


def lock_stale(alive: Column, started: Column, now: Column, hours: float = 1) -> Column:
    """Whether a writer's lock may be taken over: nothing is known of it, its process is gone, or it is too old."""
    return (alive.isNull() & started.isNull()) | F.coalesce(~alive, F.lit(False)) | F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(started) > int(hours * 3600), F.lit(False))


def retry_delay(attempt: Column, base: float, most: float, unit: Column | None = None) -> Column:
    """Seconds before the next try: doubled with each attempt up to `most`, and up to a quarter (a second at most) more by unit, a number in 0 to 1."""
    delay = F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))))
    more = (unit if unit is not None else F.lit(0.0)) * F.least(F.lit(1.0), delay * 0.25)
    return F.when(delay <= 0, 0.0).otherwise(F.least(F.lit(float(most)), delay + more))


def status_extremes(df: DataFrame, collected: Column, published: Column, as_of: dt.datetime, tolerance_days: int = 2) -> DataFrame:
    """One row: n, the latest collected, the latest published that does not lie further ahead than the tolerance."""
    bound = F.lit(as_of + dt.timedelta(days=tolerance_days))
    return df.agg(F.count("*").alias("n"), F.max(collected).alias("latest_collected"), F.max(F.when(published <= bound, published)).alias("latest_published"))


def report_statistics(df: DataFrame, **kinds: Column) -> DataFrame:
    """kind, value, n: a histogram of each kind in one pass; null is `unknown`."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(c.cast("string"), F.lit("unknown")).alias("value")) for k, c in kinds.items())))
    return df.select(each.alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def first_errors(df: DataFrame, source: str, error: str, *order: str) -> DataFrame:
    """The first error of each source."""
    return df.groupBy(source).agg(F.min_by(error, F.struct(*order)).alias(error))


def interface_summary(df: DataFrame, level: Column) -> DataFrame:
    """One row: visible rows, urgent ones and those to watch."""
    shown = level.isin(*LEVELS[:2])
    return df.agg(F.count_if(shown).alias("visible_total"), F.count_if(level == LEVELS[0]).alias(LEVELS[0]), F.count_if(level == LEVELS[1]).alias(LEVELS[1]))


def missing(spark: SparkSession, required: tuple[str, ...], present: DataFrame, name: str) -> DataFrame:
    """What is required and not present."""
    return spark.createDataFrame([(r,) for r in required], f"{name} string").join(present.select(name).distinct(), name, "left_anti")


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The path of the newest file that fits, by the listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


#: What a topic adds to the order of display: fixed values.
TOPIC_BOOST = {
    "postanovlenie_1528": 18,
    "concessional_credit": 14,
    "regional_subsidy_distribution": 14,
    "grain_compensation": 12,
    "dairy": 10,
    "elite_seed": 10,
    "processing_modernization": 10,
    "export_support": 10,
    "direct_indirect_subsidies": 8,
}
#: Of twins on two sites, the greater goes first: fixed values.
SITE_PRIORITY = {"admkrai.krasnodar.ru": 2, "npa.krasnodar.ru": 1}


def topic_boost(family: Column, boosts: dict[str, int] = TOPIC_BOOST) -> Column:
    out = F.lit(0)
    for f, n in boosts.items():
        out = F.when(family == f, n).otherwise(out)
    return out


def direct_file(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike(r"\.(?:pdf|docx?)$"), F.lit(False)).cast("int")


def site_priority(url: Column, sites: dict[str, int] = SITE_PRIORITY) -> Column:
    out = F.lit(0)
    for s, n in sorted(sites.items(), key=lambda x: x[1]):
        out = F.when(F.contains(F.lower(url), F.lit(s)), n).otherwise(out)
    return out


def seconds_or_zero(ts: Column) -> Column:
    """A time as seconds, 0 for none, as orders of display need."""
    return F.coalesce(F.unix_timestamp(ts), F.lit(0)).cast("long")
