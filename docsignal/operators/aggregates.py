"""Counts for diagnostics: one pass of conditional aggregates wherever several counts are asked."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import top_per_group


def counts(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """Rows and rows per condition, by keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))


def ratio(part: str, whole: str) -> Column:
    """0 for an empty whole."""
    return F.when(F.col(whole) > 0, F.col(part).cast("double") / F.col(whole)).otherwise(0.0)


def rollup(df: DataFrame, sets: list[list[str]], **conditions: Column) -> DataFrame:
    """Counts for several groupings in one pass; `grouping_level` numbers them by the bits of the columns left out."""

    cols = list(dict.fromkeys(c for s in sets for c in s))
    flags = df.select(*cols, *(F.coalesce(c, F.lit(False)).cast("long").alias(n) for n, c in conditions.items()))
    return flags.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in cols)).agg(F.grouping_id().alias("grouping_level"), F.count("*").alias("total"), *(F.sum(n).alias(n) for n in conditions))


def top_values(df: DataFrame, value: Column, ordinal: Column, most: int) -> DataFrame:
    """The most frequent values, ties by first appearance."""
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(ordinal).alias("first")).orderBy(F.desc("n"), "first", "value").limit(most)


def health(df: DataFrame, source: str, attempted: str, succeeded: str, as_of: dt.datetime, stale_days: int) -> DataFrame:
    """Per source the last attempt and success, whether the last attempt failed, and whether it is stale."""
    g = df.groupBy(source).agg(F.max(attempted).alias("last_attempt"), F.max(succeeded).alias("last_success"))
    failed = F.col("last_success").isNull() | (F.col("last_attempt") > F.col("last_success"))
    stale = F.col("last_success").isNull() | (F.col("last_success") < F.lit(as_of - dt.timedelta(days=stale_days)))
    return g.withColumns({"failed": failed, "stale": stale})


def merged(old: DataFrame, new: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Running totals and new ones added up."""
    return old.select(*keys, *sums).unionByName(new.select(*keys, *sums)).groupBy(*keys).agg(*(F.sum(s).alias(s) for s in sums))


def samples(df: DataFrame, keys: list[str], value: str, most: int, *order: Column) -> DataFrame:
    """Per key its rows and the first few values. The values are cut before they are collected."""
    few = top_per_group(df, keys, most, *order).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", value))).alias("_s")).select(*keys, F.transform("_s", lambda x: x[value]).alias("samples"))
    return df.groupBy(*keys).agg(F.count("*").alias("n")).join(few, keys)


def notices(parts: list[DataFrame], severity: tuple[str, ...]) -> DataFrame:
    """Distinct (severity, message) of several producers, the gravest first."""
    from ..schema import rank_of

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("severity", "message").dropDuplicates().orderBy(rank_of(F.col("severity"), severity).desc(), "message")


def warnings(counted: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(key, severity, message) for each rule (severity, message, condition) that holds on a row with column `key`."""
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for s, m, c in rules)))
    return counted.select("key", F.inline(found))
