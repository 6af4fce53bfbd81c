"""Mixing sources to target weights by Pareto order sampling (operator 8).

Each source gets a target number of words. A document expects copies in proportion to its weight, at
most `most`; what that bound takes away is reshared among the source's other documents, so that the
expected words are the target. Its whole expected copies are certain. For the rest, documents are ranked by random
odds divided by inclusion odds, U / (1 - U) over p / (1 - p), and taken in that order until the
source's target is reached; one more document, the one that leaves the least distance, closes the gap.

Defined results: null text has size 0. Null source is a source of its own, ranked last. Equal rank
keys (repeated rows) share one decision. A source without words takes nothing. An empty table gives
an empty result. The random numbers are hashes of doc_id and seed, so that reruns agree. Columns
other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import global_rank, join_small, n_words, save, table, unit_interval

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BINS = 4096


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source (columns key, source, source_size) its target: shares by weight, capped at most times its size, the excess reshared."""
    ranked = save(global_rank(sizes, F.col("source").isNull(), F.col("source")).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    cap = most * F.col("source_size")
    while total:
        full = cap <= level * F.col("w") if stopped >= 0 else F.lit(False)
        r = ranked.agg(F.count_if(full), F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if not r[2]:
            break
        level = (share * total - float(r[1])) / r[2]
        if r[0] == stopped:
            break
        stopped = r[0]
    return ranked.select("key", "source_size", F.least(cap.cast("double"), level * F.col("w")).alias("target"))


def levels(base: DataFrame, per: DataFrame, most: int) -> DataFrame:
    """Adds level to per (columns key, source_size, target): least(most, level * w) copies of each document hold the target's words.

    The words are concave in the level, so that Newton's steps from 0 rise to it and end when no more
    documents reach most. A source whose target is most times its size needs all of every document.
    """
    each = save(base.groupBy("key", "w").agg(F.sum("size").alias("words")), "weights")
    full = (F.col("source_size") > 0) & (F.col("target") >= most * F.col("source_size"))
    now = per.filter(~full & (F.col("target") > 0)).select("key", "target", F.lit(0.0).alias("level"), F.lit(-1).cast("long").alias("reached"))
    while True:
        over = F.col("level") * F.col("w") >= most
        sums = join_small(each, now, ["key"], "inner").groupBy("key", "target", "level", F.col("reached").alias("before")).agg(
            F.count_if(over).alias("reached"), F.sum(F.when(over, most * F.col("words")).otherwise(0)).alias("certain"), F.sum(F.when(over, 0.0).otherwise(F.col("words") * F.col("w"))).alias("slope")
        )
        step = (F.col("target") - F.col("certain")) / F.nullif(F.col("slope"), F.lit(0.0))
        now = save(sums.select("key", "target", F.greatest("level", step).alias("level"), "reached", "before"), "level")
        if not now.filter("reached > before").limit(1).count():
            break
    return per.join(now.select("key", "level"), "key", "left").withColumn("level", F.when(full, F.lit(float("inf"))).otherwise(F.coalesce("level", F.lit(0.0))))


def keyed(docs: DataFrame, seed: int, weight: Column | None) -> DataFrame:
    """Adds what a decision rests on, all from the row itself: key, size, u and w."""
    at = docs.withColumns({"key": source_key(F.col("source").cast("string")), "size": n_words(F.col("text").cast("string")), "u": unit_interval(F.lit(seed), F.col("doc_id").cast("long"))})
    return at.withColumn("w", weight if weight is not None else F.lit(1.0))


def ranked(rows: DataFrame, per: DataFrame, most: int) -> DataFrame:
    """Adds sure (certain copies), open (may have one more), rho (the rank) and bin to keyed rows. per: key, source_size, target, level."""
    known = join_small(rows, per, ["key"], "left")
    known = known.withColumn("expected", F.least(F.lit(float(most)), F.coalesce(F.col("level") * F.col("w"), F.lit(0.0))))
    known = known.withColumn("sure", F.floor(F.col("expected") + 1e-9).cast("long")).withColumn("p", F.least(F.greatest(F.col("expected") - F.col("sure"), F.lit(1e-9)), F.lit(1 - 1e-9)))
    known = known.withColumn("rho", (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    known = known.withColumns({"bin": F.least(F.floor(BINS * F.col("rho") / (1 + F.col("rho"))), F.lit(BINS - 1)).cast("int"), "open": F.col("sure") < most})
    return known.drop("u", "w", "level", "expected", "p")


def chosen() -> Column:
    """Whether a ranked row lies before its source's cut (columns edge, last)."""
    inside = (F.col("bin") == F.col("edge")) & (F.col("rho") <= F.coalesce("last", F.lit(-1.0)))
    return F.col("open") & (F.col("edge").isNull() | (F.col("bin") < F.col("edge")) | inside)


def cuts(known: DataFrame) -> DataFrame:
    """Per source where the ranks are cut: edge (the bin that passes the target), last (the last rank taken in it), extra (the rank of the one more)."""
    left = known.groupBy("key").agg((F.first("target") - F.sum(F.col("sure") * F.col("size"))).alias("left"))
    bins = known.filter("open").groupBy("key", "bin").agg(F.sum("size").alias("words"))
    run = bins.withColumn("upto", F.sum("words").over(Window.partitionBy("key").orderBy("bin"))).join(left, "key")
    edge = save(run.filter(F.col("upto") > F.col("left")).groupBy("key").agg(F.min("bin").alias("edge"), F.min_by(F.col("upto") - F.col("words"), F.col("bin")).alias("before"), F.first("left").alias("left")), "edge")
    inside = join_small(known.filter("open"), edge, ["key"], "inner").filter(F.col("bin") == F.col("edge"))
    inside = inside.groupBy("key", "rho", "before", "left").agg(F.sum("size").alias("words"))  # equal ranks stand or fall together
    inside = inside.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("key").orderBy("rho")))
    taken = inside.filter(F.col("upto") <= F.col("left")).groupBy("key").agg(F.max("rho").alias("last"), F.max("upto").alias("upto"))
    cut = save(edge.join(taken, "key", "left").select("key", "edge", "last", (F.col("left") - F.coalesce("upto", "before")).alias("gap")), "cut")
    # the document that leaves the least distance from the target, on either side; equal ranks count as one
    spare = join_small(known, cut, ["key"], "inner").filter(F.col("open") & ~chosen() & (F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")))
    spare = spare.groupBy("key", "rho", "gap").agg(F.sum("size").alias("size")).filter(F.col("size") < 2 * F.col("gap"))
    extra = spare.groupBy("key").agg(F.min_by("rho", F.struct(F.abs(F.col("size") - F.col("gap")), "rho")).alias("extra"))
    return cut.select("key", "edge", "last").join(extra, "key", "left")


def decided(rows: DataFrame, per: DataFrame, cut: DataFrame, most: int) -> DataFrame:
    """Adds source_size, target and copies to keyed rows."""
    known = join_small(ranked(rows, per, most), cut, ["key"], "left")
    more = chosen() | F.coalesce(F.col("open") & (F.col("rho") == F.col("extra")), F.lit(False))
    return known.withColumn("copies", F.col("sure") + more.cast("long")).drop("sure", "open", "rho", "bin", "edge", "last", "extra")


def plan(docs: DataFrame, seed: int, weight: Column | None, weights: tuple[int, ...], share: float, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keyed rows without texts, the sources' targets and their cuts: the last two hold a row per source."""
    base = save(keyed(docs.select("doc_id", "source", "text"), seed, weight).select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "key", "size", "u", "w"), "mix")
    sizes = base.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    per = save(levels(base, save(targets(sizes, weights, share, most), "shares"), most), "targets")
    known = save(ranked(base.drop("source"), per, most), "ranked")
    return base, per, save(cuts(known), "cuts")


def mix(docs: DataFrame, seed: int = 8, weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The documents' decisions: doc_id, key, size, source_size, target, copies.

    weight: an expression over size, greater for documents that should be likelier.
    """
    base, per, cut = plan(docs, seed, weight, weights, share, most)
    return decided(base.drop("source"), per, cut, most).select("doc_id", "key", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, seed: int = 8, weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Decisions follow from the row and its source's cut, so that no text is shuffled."""
    _, per, cut = plan(docs, seed, weight, weights, share, most)
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))  # apart from working columns, whose names may clash
    done = decided(keyed(rows, seed, weight), per, cut, most).filter("copies > 0")
    return done.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


#: Long documents get smaller inclusion odds, lest a few of them fill a source's share.
LESS_IF_LONG = "1 / (1 + size / 10000)"


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mix(table(spark, sf_dir, "documents"), weight=F.expr(LESS_IF_LONG))
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
