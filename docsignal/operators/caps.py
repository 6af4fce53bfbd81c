"""Capped top-k with exemptions, overflow counts and overflow routing.

Caps hold per bucket, so a window over a bucket needs only its ranking columns; a report's buckets are
few and its rows are those of a period. Order columns must end in a unique one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_caps(df: DataFrame, bucket: str, caps: dict[str, int], *order: Column) -> DataFrame:
    """At most a bucket's cap of rows, each with its place and the number of the bucket's rows left out. Buckets without a cap stay whole.

    Counts come from an aggregate and places from a row_number filter, which Spark limits before the shuffle.
    """
    cap = F.lit(None).cast("int")
    for b, n in caps.items():
        cap = F.when(F.col(bucket) == b, n).otherwise(cap)
    n = df.groupBy(bucket).agg(F.count("*").alias("_all"))
    most = max(caps.values(), default=0)
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))
    capped = placed.filter(F.col("place") <= most).filter(F.col("place") <= cap) if set(caps) else placed
    whole = placed.filter(cap.isNull())
    out = capped.unionByName(whole) if caps else placed
    return out.join(n, bucket).withColumn("left_out", F.greatest(F.col("_all") - F.coalesce(cap, F.col("_all").cast("int")), F.lit(0)).cast("long")).drop("_all")


def exempt_budget(df: DataFrame, exempt: Column, budget: int, *order: Column) -> DataFrame:
    """All exempt rows, and others in the order while the budget lasts; exempt rows use it up first."""
    # a top-k of fixed size, of which the number of exempt rows, joined as one row, leaves the first ones
    used = df.filter(exempt).agg(F.count("*").alias("_used"))
    rest = df.filter(~exempt).orderBy(*order).limit(budget)
    rest = rest.withColumn("_n", F.row_number().over(Window.orderBy(*order))).join(F.broadcast(used), F.col("_n") + F.col("_used") <= budget, "inner").drop("_n", "_used")
    return df.filter(exempt).unionByName(rest)


def urgent_cap(df: DataFrame, urgent: Column, most: int, section: str, fallback: Column, key: str, *order: Column) -> DataFrame:
    """The first `most` urgent rows stay in their section, the others move to the fallback section, `routed` telling which. key: unique, not null."""
    first = df.filter(urgent).orderBy(*order).limit(most).select(key, F.lit(True).alias("_first"))
    moves = F.coalesce(urgent, F.lit(False)) & F.col("_first").isNull()
    out = df.join(F.broadcast(first), key, "left")
    return out.select(*(F.when(moves, fallback).otherwise(F.col(c)).alias(c) if c == section else F.col(c) for c in df.columns), moves.alias("routed"))


def shared_cap(df: DataFrame, bucket: str, exempt: Column, most: int, *order: Column) -> DataFrame:
    """Per bucket, exempt rows stay and use up the cap; others fill what is left."""
    w = Window.partitionBy(bucket)
    used = F.count_if(exempt).over(w)
    n = F.row_number().over(w.orderBy(exempt.cast("int").desc(), *order))
    return df.withColumns({"_used": used, "place": n}).filter(exempt | (F.col("place") <= F.greatest(F.lit(most), F.col("_used")))).drop("_used")
