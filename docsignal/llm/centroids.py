"""Centroid clustering with Elkan's bounds (operator 12).

Vectors become integers and travel in blocks with what is known of each: its centroid, an upper bound of
the distance to it, and a lower bound of the distance to every centroid. A round is one pass over the blocks
without a shuffle. Bounds move with the centroids, and together with the distances between centroids they
tell which distances need no computing. Upper bounds are rounded up and lower ones down, and only a strict
inequality prunes, so that ties are decided by exact distances. Centroids are sums of integers, added by
Spark from sums per block: clusters, assignments and distances are those of the plain algorithm.

Only centroids and their sums (k times the number of components) reach the driver. Each round's blocks are
written to the shared folder before the last round's are deleted; rounds end early when no centroid moves.

Defined results: vectors that are null, of another length, or hold a null or non-finite component take no
part. With fewer than k vectors each starts a cluster; with none the result is empty. Of equal start hashes
the smaller vector comes first; a null vec_id hashes as the empty word. Repeated rows count each. Integers
are cut to 62 bits and results that do not fit a long to the largest one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, save, table, tidied

BLOCKS = "ids array<long>, width int, x binary, own binary, upper binary, lower binary, high array<long>, low array<long>, counts array<long>, computed long"
ASSIGNED = "vec_id long, cluster int, distance long"
LARGEST = (1 << 63) - 1


def whole(vec: Column, dim: int) -> Column:
    """Whether a vector takes part."""
    return F.coalesce((F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), cut to 62 bits."""
    return np.clip(np.floor(x * float(scale)), -(2.0**62), 2.0**62).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to c, one row or as many: longs where they fit, else Python's numbers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if most <= math.isqrt((1 << 62) // max(1, x.shape[1])) // 2:
        d = x - c
        return np.einsum("ij,ij->i", d, d)
    d = x.astype(object) - c.astype(object)
    return (d * d).sum(axis=1) if len(d) else np.zeros(0, object)


def above(squares: np.ndarray) -> np.ndarray:
    """Floats not below the roots."""
    root = np.nextafter(np.sqrt(np.nextafter(squares.astype(np.float64), np.inf)), np.inf)
    return np.nextafter(root.astype(np.float32), np.float32(np.inf))


def below(squares: np.ndarray) -> np.ndarray:
    """Floats not above the roots."""
    root = np.nextafter(np.sqrt(np.maximum(0, np.nextafter(squares.astype(np.float64), -np.inf))), -np.inf)
    return np.maximum(np.float32(0), np.nextafter(root.astype(np.float32), np.float32(-np.inf)))


class Centroids:
    """The centroids of a round, half the distances between them rounded down, and how far each has moved since the last, rounded up."""

    def __init__(self, at: list[list[int]], before: list[list[int]] | None = None) -> None:
        self.at = np.array(at, np.int64)
        self.half = np.stack([below(squared(self.at, c)) for c in self.at]) / np.float32(2)
        np.fill_diagonal(self.half, np.inf)
        self.gap = self.half.min(axis=1)
        self.moved = above(np.array([squared(self.at[i : i + 1], np.array(before[i], np.int64))[0] for i in range(len(at))])) if before else np.zeros(len(at), np.float32)
        if before:
            self.moved[[a == b for a, b in zip(at, before, strict=True)]] = 0

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """own, upper and lower of a block after the move, and the number of distances computed."""
        own = own.copy()
        upper = np.where(self.moved[own] > 0, np.nextafter(upper + self.moved[own], np.float32(np.inf)), upper)
        lower = np.where(self.moved > 0, np.maximum(np.float32(0), np.nextafter(lower - self.moved, np.float32(-np.inf))), lower)
        at = np.flatnonzero(~(upper < self.gap[own]))
        exact = squared(x[at], self.at[own[at]])
        computed = len(at)
        upper[at], lower[at, own[at]] = above(exact), below(exact)
        left = ~(upper[at] < self.gap[own[at]])
        at, exact = at[left], exact[left]
        for j in range(len(self.at)):
            mine, bound = own[at], upper[at]
            ask = np.flatnonzero((mine != j) & ~(bound < lower[at, j]) & ~(bound < self.half[mine, j]))
            rows = at[ask]
            d = squared(x[rows], self.at[j])
            computed += len(rows)
            lower[rows, j] = below(d)
            nearer = (d < exact[ask]) | ((d == exact[ask]) & (j < own[rows]))
            own[rows[nearer]], upper[rows[nearer]] = j, above(d[nearer])
            if exact.dtype != d.dtype:
                exact = exact.astype(object)
            exact[ask[nearer]] = d[nearer]
        return own, upper, lower, computed


def batch(ids: pa.Array, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, computed: int, k: int) -> pa.RecordBatch:
    """A block's row, with the sums of its vectors by centroid as high and low halves, lest they outgrow longs."""
    most = int(np.abs(x).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    wide = x if most < 1 << 40 else x.astype(object)
    sums = np.stack([wide[own == j].sum(axis=0) if (own == j).any() else np.zeros(x.shape[1], wide.dtype) for j in range(k)]).reshape(-1)
    row = [ids.to_pylist(), width, x.astype(f"<i{width}").tobytes(), own.astype("<i4").tobytes(), upper.astype("<f4").tobytes(), lower.astype("<f4").tobytes(), (sums >> 32).tolist(), (sums & 0xFFFFFFFF).tolist(), np.bincount(own, minlength=k).tolist(), computed]
    kinds = [pa.list_(pa.int64()), pa.int32(), *[pa.binary()] * 4, *[pa.list_(pa.int64())] * 3, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, kinds, strict=True)], names=[c.strip().split(" ")[0] for c in BLOCKS.split(",")])


def blocks_of(b: pa.RecordBatch, k: int, dim: int) -> Iterator[tuple]:
    """(ids, vectors, own, upper, lower) of each block of a batch."""
    for i in range(b.num_rows):
        col = lambda n: b.column(n)[i]  # noqa: B023, E731
        n = len(ids := col("ids").values)
        x = np.frombuffer(col("x").as_py(), f"<i{col('width').as_py()}").reshape(n, dim).astype(np.int64)
        yield ids, x, np.frombuffer(col("own").as_py(), "<i4").astype(np.int64), np.frombuffer(col("upper").as_py(), "<f4").copy(), np.frombuffer(col("lower").as_py(), "<f4").reshape(n, k).copy()


def starts(known: DataFrame, k: int, scale: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of their ids, as integers."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = known.orderBy(hashed, "vec").limit(k).select("vec").collect()
    return integers(np.array([r.vec for r in first], np.float64), scale).tolist() if first else []


def moved(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid with members becomes their exact floored mean."""
    dim = len(centroids[0])
    total = lambda *cols: state.select(F.posexplode(F.arrays_zip(*cols)).alias("at", "v")).groupBy("at").agg(*(F.sum(f"v.{c}").alias(c) for c in cols)).collect()
    counts = {r["at"]: r["counts"] for r in total("counts")}
    sums = {r["at"]: (r["high"] << 32) + r["low"] for r in total("high", "low")}
    return [[sums[j * dim + i] // counts[j] for i in range(dim)] if counts[j] else old for j, old in enumerate(centroids)]


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, trace: Callable[[int, int], None] | None = None) -> tuple[DataFrame, list[list[int]]]:
    """Columns vec_id and vec in; (vec_id, cluster, distance) and the centroids out. trace gets a round's number and how many distances it computed."""
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec")).filter(whole(F.col("vec"), dim))
    centroids = starts(known, k, scale, seed)
    k = len(centroids)
    if not k:
        return vectors.sparkSession.createDataFrame([], ASSIGNED), []
    now = Centroids(centroids)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = integers(b.column("vec").flatten().to_numpy().reshape(b.num_rows, dim), scale)
                n = len(x)
                yield batch(b.column("vec_id"), x, *now.assign(x, np.zeros(n, np.int64), np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32)), k)

    state = save(known.mapInArrow(tidied(opened), BLOCKS), "clusters-0")
    for n in range(1, rounds + 1):
        if trace:
            trace(n, state.agg(F.sum("computed")).first()[0])
        before, centroids = centroids, moved(state, centroids)
        if before == centroids:
            break
        now = Centroids(centroids, before)

        def again(batches: Iterator[pa.RecordBatch], now: Centroids = now) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, x, *rest in blocks_of(b, k, dim):
                    yield batch(ids, x, *now.assign(x, *rest), k)

        new = save(state.mapInArrow(tidied(again), BLOCKS), f"clusters-{n}")
        release(state)
        state = new

    def last(batches: Iterator[pa.RecordBatch], now: Centroids = now) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x, own, *_ in blocks_of(b, k, dim):
                d = np.minimum(squared(x, now.at[own]), LARGEST).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    found = save(state.select("ids", "width", "x", "own", "upper", "lower").mapInArrow(tidied(last), ASSIGNED), "clusters")
    release(state)
    return found, centroids


def elkan(vectors: DataFrame, **how) -> DataFrame:
    """clustered() with each cluster's sum of distances, their total, and the hash of its centroid."""
    found, centroids = clustered(vectors, **how)
    spark = vectors.sparkSession
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    cut = lambda v: min(v, LARGEST)
    rows = [(j, cut(sums[j]), cut(sum(sums.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids) if j in sums]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec")))


def _oracle(rounds: int = 10, k: int = 8, dim: int = 64) -> str:
    """The plain algorithm, its rounds written out: all distances, no bounds."""
    near = "SELECT row, vec_id, v, arg_min(c, (d, c)) AS c, arg_min(mid, (d, c)) AS mid, min(d) AS d FROM (SELECT row, vec_id, v, c, mid, CAST(list_sum(list_transform(list_zip(v, mid), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM vectors, {mids}) GROUP BY row, vec_id, v"
    steps = [
        f"""vectors AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"mids0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS mid FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM vectors ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds):
        steps.append(f"near{r} AS MATERIALIZED ({near.format(mids=f'mids{r}')})")
        steps.append(f"""sums{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{r}) GROUP BY c, i)""")
        steps.append(f"""mids{r + 1} AS MATERIALIZED (SELECT c, coalesce(moved, mid) AS mid FROM mids{r} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS moved FROM sums{r} GROUP BY c) USING (c))""")
    steps.append(f"last AS MATERIALIZED ({near.format(mids=f'mids{rounds}')})")
    return f"WITH {', '.join(steps)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(mid, ',')) AS centroid_sha256 FROM last"


ORACLE_SQL = _oracle()
