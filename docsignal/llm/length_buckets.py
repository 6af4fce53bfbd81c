"""Packing by optimal length buckets (operator 4).

Dynamic programming over the global histogram of lengths chooses the bucket boundaries that need the
least padding; inside each bucket, batches of one padded length fill a token budget. Lengths are counted
with the tokenizer of operator 1.

Defined results: null and empty texts have length 0 and lie in the first bucket. A text longer than
the budget makes a batch of its own. Ties and repeated rows: each row has a slot of its own, equal
rows in any order among themselves. An empty table gives an empty result. Columns other than doc_id
and text are ignored. A null doc_id is carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, n_words, save, table
from .token_files import RANKS, encoder

#: Lengths up to FINE tokens, of texts of some megabytes, count exactly; above, steps of at most 1/2048 bound the histogram at any size of corpus.
FINE = 1 << 20
#: Rows that one task ranks, about.
GROUP = 2000


def resolved(length: Column) -> Column:
    """A length rounded up to the histogram's resolution; the bound on distinct values is FINE + 2048 * 50."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(FINE)))) - 11).cast("long")
    return F.when(length <= FINE, length).otherwise(F.ceil(length / step).cast("long") * step)


def boundaries(histogram: dict[int, int], n_buckets: int) -> list[int]:
    """The upper ends of at most n_buckets ranges of lengths with the least total padding.

    best[k][j], the least padding of the j shortest lengths in k ranges, is a minimum over lines in
    the length of the last range's end, so that a hull of lines gives each layer in linear time.
    """
    lengths = sorted(histogram)
    n = len(lengths)
    if not n:
        return []
    count, words = [0], [0]
    for x in lengths:
        count.append(count[-1] + histogram[x])
        words.append(words[-1] + x * histogram[x])
    best: list[float] = [0] + [float("inf")] * n
    back: list[list[int]] = []
    for _ in range(min(n_buckets, n)):
        layer, came = [float("inf")] * (n + 1), [0] * (n + 1)
        layer[0] = 0
        hull: list[tuple[int, int, int]] = []  # slope, height, start
        front = 0
        for j in range(1, n + 1):
            if best[j - 1] != float("inf"):
                m, b, i = -count[j - 1], best[j - 1] + words[j - 1], j - 1
                while len(hull) - front >= 2:
                    (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                    if (b - b1) * (m1 - m2) <= (b2 - b1) * (m1 - m):
                        hull.pop()
                    else:
                        break
                hull.append((m, b, i))
            x = lengths[j - 1]
            while len(hull) - front >= 2 and hull[front + 1][0] * x + hull[front + 1][1] <= hull[front][0] * x + hull[front][1]:
                front += 1
            if len(hull) > front:
                m, b, i = hull[front]
                layer[j], came[j] = m * x + b + x * count[j] - words[j], i
        back.append(came)
        best = layer
    ends, j = [], n
    for came in reversed(back):
        if j == 0:
            break
        ends.append(lengths[j - 1])
        j = came[j]
    return ends[::-1]


def pack(rows: DataFrame, n_buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """Columns doc_id and n_tokens (long) in; adds bucket, bucket_len, batch (from 0 in each bucket), slot and padding."""
    rows = save(rows.withColumn("row_", F.monotonically_increasing_id()), "lengths")
    histogram = {r["at"]: r["n"] for r in rows.groupBy(resolved(F.col("n_tokens")).alias("at")).agg(F.count("*").alias("n")).collect()}
    ends = boundaries(histogram, n_buckets)
    if not ends:
        return rows.select("doc_id", "n_tokens", *(F.lit(None).cast("long").alias(c) for c in ("bucket", "bucket_len", "batch", "slot", "padding")))
    held = [sum(n for x, n in histogram.items() if lo < x <= hi) for lo, hi in zip([-1, *ends[:-1]], ends, strict=True)]

    def of(values: list[int]) -> Column:
        out = None
        for end, v in zip(ends, values, strict=True):
            out = F.when(F.col("n_tokens") <= end, F.lit(v)) if out is None else out.when(F.col("n_tokens") <= end, F.lit(v))
        return out.cast("long")

    dealt = rows.select(
        "doc_id", "n_tokens", of(list(range(len(ends)))).alias("bucket"), of(ends).alias("bucket_len"),
        # rows without an id are spread by their places
        F.pmod(F.xxhash64(F.coalesce("doc_id", "row_"), "n_tokens"), of([-(-n // GROUP) or 1 for n in held])).alias("part"),
    )
    counts = dealt.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    before = counts.select("bucket", "part", (F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("at", F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id", "n_tokens")) - 1)
    place = F.col("before") + F.col("at")
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    return ranked.join(before, ["bucket", "part"]).select(
        "doc_id", "n_tokens", "bucket", "bucket_len", F.floor(place / each).cast("long").alias("batch"), (place % each).alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding")
    )


def token_lengths(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        encode = encoder(ranks).encode_ordinary
        for doc_id, text in rows:
            yield doc_id, len(encode(text or ""))

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long")


def lengths(docs: DataFrame) -> DataFrame:
    """Words in the place of tokens, for texts that are their own tokens."""
    return docs.select(F.col("doc_id").cast("long"), n_words(F.col("text")).alias("n_tokens"))


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_lengths(table(spark, sf_dir, "documents")))
