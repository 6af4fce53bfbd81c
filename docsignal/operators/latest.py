"""One row per key: latest, best, first; and comparison with the row before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """All rows that hold the greatest ts of their key; ties stay. The maximum is made before the shuffle of rows."""
    most = df.groupBy(*keys).agg(F.max(ts).alias(ts))
    return df.join(most, [*keys, ts], "left_semi")


def latest_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the order, which must end in a unique column."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def best_of(df: DataFrame, key: Column, scores: list[Column], ordinal: Column) -> DataFrame:
    """One row per key: the greatest scores in order, ties to the smaller ordinal, which is unique. `position` is the key's first ordinal. Rows without a key stay.

    Keys, scores and ordinals are reduced by aggregates before whole rows move, so that a key with many rows meets in no task.
    """
    keyed = df.withColumn("_k", F.coalesce(key, F.concat(F.lit("#"), ordinal.cast("string")))).withColumns({"_o": ordinal, "_s": F.struct(*(s.alias(f"s{i}") for i, s in enumerate(scores)))})
    best = keyed.groupBy("_k").agg(F.max("_s").alias("_best"), F.min("_o").alias("position"))
    held = keyed.select("_k", "_o", "_s").join(best, "_k").filter(F.col("_s").eqNullSafe(F.col("_best")))
    chosen = held.groupBy("_k").agg(F.min("_o").alias("_o"), F.min("position").alias("position"))
    return keyed.drop("_s").join(chosen, ["_k", "_o"]).select(*df.columns, "position")


def first_wins(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in the order; rows whose key is null are never duplicates."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = df.filter(key.isNotNull()).withColumn("_n", n).filter(F.col("_n") == 1).drop("_n")
    return first.unionByName(df.filter(key.isNull()))


def top_per_group(df: DataFrame, keys: list[str], most: int, *order: Column) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= most)


def running_limit(df: DataFrame, flag: Column, keys: list[str], most: int, *order: Column) -> DataFrame:
    """In the order, keeps rows without the flag and the first `most` with it."""
    seen = F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_seen", seen).filter(~F.coalesce(flag, F.lit(False)) | (F.col("_seen") <= most)).drop("_seen")


def changes(df: DataFrame, keys: list[str], status: str, *order: Column) -> DataFrame:
    """Rows whose status differs from the key's row before: old and new. The first row of a key is no change."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = df.withColumn("old", F.lag(status).over(w)).withColumn("_n", F.row_number().over(w))
    return seen.filter((F.col("_n") > 1) & ~F.col("old").eqNullSafe(F.col(status))).withColumn("new", F.col(status)).drop("_n")


def ordered_distinct(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Distinct keys with the place where each came first."""
    return df.groupBy(key).agg(F.min(ordinal).alias(ordinal))


def collisions(df: DataFrame, title: str, suffixes: list[tuple[str, Column]]) -> DataFrame:
    """Titles that several rows share get the first kind of suffix that all of them have and that tells them apart; else none."""
    w = Window.partitionBy(title)
    n = F.count("*").over(w)
    df = df.withColumns({f"_s{i}": F.nullif(c.cast("string"), F.lit("")) for i, (_, c) in enumerate(suffixes)})
    out, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, _) in reversed(list(enumerate(suffixes))):
        c = F.col(f"_s{i}")
        fits = (F.count(c).over(w) == n) & (F.size(F.collect_set(c).over(w)) == n)
        out, kind = F.when(fits, c).otherwise(out), F.when(fits, name).otherwise(kind)
    df = df.withColumns({"suffix": F.when(n > 1, out), "suffix_kind": F.when(n > 1, kind)})
    return df.withColumn("shown", F.concat_ws(" — ", title, "suffix")).drop(*(f"_s{i}" for i in range(len(suffixes))))
