"""Mutations as functions of old state and delta; plain files have no MERGE.

Each returns the whole new state. `replace` swaps a stored table for it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key is not stored are appended."""
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


def delete(old: DataFrame, condition: Column) -> DataFrame:
    return old.filter(~F.coalesce(condition, F.lit(False)))


def fill_null(old: DataFrame, new: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """Columns get the new value only where the old is null."""
    return _joined(old, new, key, {c: lambda o, n: F.coalesce(o, n) for c in columns})


def overwrite(old: DataFrame, new: DataFrame, key: str, columns: Iterable[str], keep_if_null: Iterable[str] = ()) -> DataFrame:
    """Matched rows take the new columns; keep_if_null: those that keep the old value if the new is null."""
    kept = set(keep_if_null)
    rules = {c: (lambda o, n, hit: F.when(hit, F.coalesce(n, o)).otherwise(o)) if c in kept else (lambda o, n, hit: F.when(hit, n).otherwise(o)) for c in columns}
    extra = new.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in rules))
    joined = old.join(extra, key, "left")
    return joined.select(*(rules[c](F.col(c), F.col(f"_new_{c}"), F.col("_hit").isNotNull()).alias(c) if c in rules else F.col(c) for c in old.columns))


def _joined(old: DataFrame, new: DataFrame, key: str, rules: dict) -> DataFrame:
    extra = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in rules))
    joined = old.join(extra, key, "left")
    return joined.select(*(rules[c](F.col(c), F.col(f"_new_{c}")).alias(c) if c in rules else F.col(c) for c in old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: Iterable[str] = (), fill: Iterable[str] = ()) -> DataFrame:
    """New rows replace old ones of their key; keep_old columns keep the old value of a known key, fill columns where the new is null."""
    kept, filled = set(keep_old), set(fill)
    a, b = old.withColumn("_in", F.lit(True)).alias("a"), new.withColumn("_in", F.lit(True)).alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = a.join(b, on, "full")

    def pick(c: str) -> Column:
        o, n = F.col(f"a.{c}"), F.col(f"b.{c}")
        hit, known = F.col("b._in").isNotNull(), F.col("a._in").isNotNull()
        if c in kept:
            return F.when(known, o).otherwise(n)
        return F.when(hit, F.coalesce(n, o) if c in filled else n).otherwise(o)

    return joined.select(*(pick(c).alias(c) for c in old.columns))


def last_write(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest order column."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return old.unionByName(new).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def mark(old: DataFrame, keys: DataFrame, key: str, column: str, value: object) -> DataFrame:
    """Sets a column on rows whose key is in a set."""
    hit = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    return old.join(hit, key, "left").withColumn(column, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(column))).select(*old.columns)


def replace(df: DataFrame, path: str) -> None:
    """Writes the new state beside the old and swaps names, so that readers never see half a table."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, draft, gone = (jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", "._new", "._old"))
    fs = at.getFileSystem(conf)
    df.write.mode("overwrite").parquet(path + "._new")
    fs.delete(gone, True)
    if fs.exists(at):
        fs.rename(at, gone)
    fs.rename(draft, at)
    fs.delete(gone, True)
