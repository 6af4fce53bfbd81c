"""Connected components of an edge table, distributed: smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(edges: DataFrame) -> DataFrame:
    """Columns a, b (long) in; node, label out, the label being the smallest node of the component.

    Each round takes the least label of the neighbours, then the label's own label, so that the number
    of rounds grows with the logarithm of the longest chain. Only a count reaches the driver.
    """
    both = save(edges.filter("a != b").select("a", "b").union(edges.filter("a != b").select("b", "a")).dropDuplicates(), "edges")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = save(new.join(far, "label").select("node", "old", F.least("label", "far").alias("label")), "labels")
        if not new.filter("old != label").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels after further edges: only the components that these join are labelled anew."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    named = edges.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    moved = save(components(named.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))), "moved")
    old = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return save(old.unionByName(moved.join(labels, "node", "left_anti")), "labels")
