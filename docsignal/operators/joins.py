"""Joins and set operations of the monitor, set-based where a loop would look up row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_in(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def only_in(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def new_items(items: DataFrame, stored: DataFrame, url: str, content: str, ordinal: str) -> DataFrame:
    """Items whose url and content are neither stored nor earlier in the same run."""
    fresh = items.join(stored.select(url), url, "left_anti")
    one = fresh.withColumn("_u", F.row_number().over(Window.partitionBy(url).orderBy(ordinal))).filter("_u = 1")
    one = one.withColumn("_h", F.row_number().over(Window.partitionBy(content).orderBy(ordinal))).filter("_h = 1")
    return one.join(stored.select(content), content, "left_anti").drop("_u", "_h")


def unresolved(audit: DataFrame, url: str, key: str, condition: Column) -> DataFrame:
    """The newest row of each url, if the condition holds on it: a url whose newest row is fine is resolved."""
    return audit.withColumn("_n", F.row_number().over(Window.partitionBy(url).orderBy(F.desc(key)))).filter((F.col("_n") == 1) & condition).drop("_n")


def coverage(sources: DataFrame, latest: DataFrame, on: str, status: Column) -> DataFrame:
    """All sources with their latest row's status, NO DATA where there is none."""
    return sources.join(latest.withColumn("_seen", F.lit(True)), on, "left").withColumn("status", F.when(F.col("_seen").isNull(), "NO DATA").otherwise(status)).drop("_seen")


def audit_gap(found: DataFrame, audited: DataFrame, keys: list[str]) -> DataFrame:
    """found: keys, found, existing; audited: keys, audited. The gap splits into what was there before and the rest."""
    gap = F.greatest(F.col("found") - F.coalesce("audited", F.lit(0)), F.lit(0))
    return found.join(audited, keys, "left").withColumn("audited", F.coalesce("audited", F.lit(0).cast("long"))).withColumn("gap", gap.cast("long")).withColumn("gap_existing", F.least("gap", "existing")).withColumn("gap_new", F.col("gap") - F.col("gap_existing"))


def suppression(raw: DataFrame, selected: DataFrame, rendered: DataFrame, key: str, early: list[tuple[str, Column]], late: str = "limit") -> DataFrame:
    """Rows of raw that are not rendered, with the reason: the first early condition that holds, `selection` if not selected, else late."""
    flags = raw.join(selected.select(key).distinct().withColumn("_s", F.lit(True)), key, "left").join(rendered.select(key).distinct().withColumn("_r", F.lit(True)), key, "left")
    reason = F.when(F.lit(False), "")
    for name, c in early:
        reason = reason.when(c, name)
    return flags.filter("_r is null").withColumn("reason", reason.when(F.col("_s").isNull(), "selection").otherwise(late)).drop("_s", "_r")


def union_distinct(parts: list[DataFrame], key: str, ordinal: str) -> DataFrame:
    """The union in order of the parts and their ordinals, each key once where it came first."""
    out = None
    for i, p in enumerate(parts):
        p = p.select(key, F.lit(i).alias("part"), F.col(ordinal).cast("long").alias("at"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy(key).agg(F.min(F.struct("part", "at")).alias("first")).select(key, "first.part", "first.at")
