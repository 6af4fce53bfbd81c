"""Approximate nearest neighbours by cross-polytope hashing (operator 2).

Directions of vectors are rotated by three rounds of random signs and a Hadamard transform; the nearest
signed axis is the bucket in a table. A query looks into its nearest axes of each table (multiprobe);
candidates are reranked by exact inner products of the original vectors in double precision.

The hash functions have no fitted part, every row is indexed, and no bucket has a cap: a large one is
cut into tiles of queries by candidates which are searched apart. Tables and probes are the same at
every size, as finer buckets would lose neighbours; recall against brute force is measured in tests/llm
(at least 0.9, also on clustered vectors and on norms far apart). A query whose buckets hold fewer than
k vectors is searched again, against all rows in blocks, so that no list is shorter than it should be.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no
part. Vectors of different lengths are never neighbours. Rows that share a vec_id are one vector's
copies: none of them is a neighbour of that id, and as neighbours they count once, at their best score.
Ties go to the smaller vec_id. A null vec_id takes no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_small, save, table, tidied

BLOCKS = "dim int, tab int, bucket long, query boolean, n long, ids binary, vecs binary"
HITS = "query_id long, scores binary, ids binary"
#: Queries whose hits one task merges, about.
MERGE = 500
#: Most candidates, and most queries, of a tile.
TILE = 32_768


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Pseudo-random rotation: for each row of signs, flip and transform (fast Walsh-Hadamard)."""
    n, d = x.shape
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            y = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
            h *= 2
        x = x / np.sqrt(d)
    return x


def axes(rotated: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest signed axes of each row, nearest first, and their coordinates' sizes."""
    size = np.abs(rotated)
    n = min(n, rotated.shape[1])
    at = np.argsort(-size, axis=1, kind="stable")[:, :n]
    return at * 2 + (np.take_along_axis(rotated, at, 1) > 0), np.take_along_axis(size, at, 1)


def nearest(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best candidates, each id once: (id, scores, ids). Scores are sums in one fixed order, so that a pair scores alike in any tile."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    first = np.flatnonzero(np.append(True, c_ids[1:] != c_ids[:-1]))
    step = max(1, 4_000_000 // max(1, len(c_ids)))
    for lo in range(0, len(q_ids), step):
        qs, qi = q[lo : lo + step], q_ids[lo : lo + step]
        s = qs @ c.T
        s[qi[:, None] == c_ids[None, :]] = -np.inf
        best = s if len(first) == len(c_ids) else np.maximum.reduceat(s, first, axis=1)
        edge = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k] if best.shape[1] > k else np.full(len(qi), -np.inf)
        rows, cols = np.nonzero((s >= (edge - 1e-9 * np.maximum(1, np.abs(edge)))[:, None]) & (s > -np.inf))
        exact = np.concatenate([(qs[rows[i : i + 100_000]] * c[cols[i : i + 100_000]]).sum(axis=1) for i in range(0, len(rows), 100_000)] or [np.zeros(0)])
        rows, exact, ids = top(rows, exact, c_ids[cols], k)
        ends = np.searchsorted(rows, np.arange(len(qi) + 1))
        for i in range(len(qi)):
            if ends[i + 1] > ends[i]:
                yield int(qi[i]), exact[ends[i] : ends[i + 1]], ids[ends[i] : ends[i + 1]]


def top(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row in order, each id once at its best score."""
    order = np.lexsort((-scores, ids, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
    rows, scores, ids = rows[new], scores[new], ids[new]
    order = np.lexsort((ids, -scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(rows)))
    keep = np.arange(len(rows)) - np.repeat(start, size) < k
    return rows[keep], scores[keep], ids[keep]


def usable(vec: Column) -> Column:
    """Whether a vector takes part."""
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = 6, probes: int = 18, seed: int = 2) -> DataFrame:
    """Columns vec_id (long) and vec (array of float or double) in; query_id, rank, vec_id, score out."""
    known = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("vec"))).select("vec_id", F.col("vec").cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("query"))
    # vectors of floats travel as floats, and are doubles again before any product
    wire = "<f4" if vectors.schema["vec"].dataType.elementType.simpleString() == "float" else "<f8"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length of the vectors, ids, whether queries, vectors) of each batch."""
        for b in batches:
            ids = b.column(0).to_numpy()
            query = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            sizes = np.diff(b.column(1).offsets.to_numpy())
            flat = b.column(1).flatten().to_numpy()
            starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            for dim in np.unique(sizes):
                mine = np.flatnonzero(sizes == dim)
                yield int(dim), ids[mine], query[mine], flat[starts[mine][:, None] + np.arange(dim)]

    def emit(out: list[tuple], dim: int, tab: int, bucket: np.ndarray, asks: bool, ids: np.ndarray, raw: np.ndarray) -> None:
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(part):
                out.append((dim, tab, int(bucket[part[0]]), asks, len(part), ids[part].astype("<i8").tobytes(), raw[part].tobytes()))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["dim", "tab", "bucket", "query", "n", "ids", "vecs"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, query, x in pieces(batches):
            width = 1 << max(1, (dim - 1).bit_length())
            unit = np.zeros((len(x), width))
            unit[:, :dim] = x / np.abs(x).max(axis=1, keepdims=True)  # lest squares overflow
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            rng = np.random.default_rng([seed, dim])
            raw = x.astype(wire)
            out: list[tuple] = []
            for tab in range(tables):
                found = axes(rotate(unit, rng.choice([-1.0, 1.0], size=(3, width))), probes)[0]
                emit(out, dim, tab, found[:, 0], False, ids, raw)
                asked = np.flatnonzero(query)
                where = np.repeat(asked, found.shape[1])
                emit(out, dim, tab, found[asked].reshape(-1), True, ids[where], raw[where])
            yield batch(out)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All vectors in one bucket, which tiles cut."""
        for dim, ids, query, x in pieces(batches):
            out: list[tuple] = []
            for asks in (False, True):
                mine = query == asks if asks else np.ones(len(ids), bool)
                for lo in range(0, int(mine.sum()), 1024):
                    part = np.flatnonzero(mine)[lo : lo + 1024]
                    emit(out, dim, -1, np.zeros(len(part), np.int64), asks, ids[part], x[part].astype(wire))
            if out:
                yield batch(out)

    found = save(merged(tiles(save(known.mapInArrow(tidied(hashed), BLOCKS), "buckets"), wire, k), k), "found")
    # queries whose buckets hold too few
    each = known.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
    asked = known.filter("query").select("vec_id", F.size("vec").alias("dim")).join(F.broadcast(each), "dim").groupBy("vec_id").agg(F.max("n").alias("n"))
    short = asked.join(found.select(F.col("query_id").alias("vec_id"), F.size("ids").alias("held")), "vec_id", "left")
    short = save(short.filter(F.coalesce("held", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("vec_id"), "short")
    if short.limit(1).count():
        again = join_small(known, short.withColumn("short", F.lit(True)), ["vec_id"]).select("vec_id", "vec", (F.col("query") & F.coalesce("short", F.lit(False))).alias("query"))
        more = merged(tiles(save(again.mapInArrow(tidied(whole), BLOCKS), "whole"), wire, k), k)
        found = join_small(found, short.withColumnRenamed("vec_id", "query_id"), ["query_id"], "left_anti").unionByName(more)
    hits = found.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("at", "hit"))
    return hits.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))


def tiles(blocks: DataFrame, wire: str, k: int) -> DataFrame:
    """The k best hits of each query in each tile, a part of a bucket's queries by a part of its candidates."""
    key = ["dim", "tab", "bucket"]
    held = blocks.groupBy(*key).agg(F.sum(F.when(F.col("query"), F.col("n"))).alias("asked"), F.sum(F.when(~F.col("query"), F.col("n"))).alias("kept")).filter("asked > 0 and kept > 0")
    cuts = held.select(*key, F.ceil(F.col("asked") / TILE).cast("int").alias("rows"), F.ceil(F.col("kept") / TILE).cast("int").alias("cols"))
    tiled = join_small(blocks, cuts, key, "inner")
    own = F.pmod(F.xxhash64("ids"), F.when(F.col("query"), F.col("rows")).otherwise(F.col("cols"))).cast("int")
    tiled = tiled.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("cols")).otherwise(F.col("rows")) - 1)))
    tiled = tiled.withColumns({"row": F.when(F.col("query"), F.col("own")).otherwise(F.col("other")), "col": F.when(F.col("query"), F.col("other")).otherwise(F.col("own"))})
    schema = pa.schema([("query_id", pa.int64()), ("scores", pa.binary()), ("ids", pa.binary())])

    def tile(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        parts: dict[bool, list] = {True: [], False: []}
        for asks, ids, vecs in zip(t.column("query").to_pylist(), t.column("ids").to_pylist(), t.column("vecs").to_pylist(), strict=True):
            parts[asks].append((np.frombuffer(ids, "<i8"), np.frombuffer(vecs, wire).reshape(-1, dim).astype(np.float64)))
        if not parts[True] or not parts[False]:
            return schema.empty_table()
        (qi, q), (ci, c) = ((np.concatenate([i for i, _ in p]), np.concatenate([v for _, v in p])) for p in (parts[True], parts[False]))
        got = [(i, scores.tobytes(), ids.tobytes()) for i, scores, ids in nearest(qi, q, ci, c, k)]
        return pa.Table.from_arrays([pa.array([g[n] for g in got], type=schema.field(n).type) for n in range(3)], schema=schema)

    return tiled.select(*key, "row", "col", "query", "ids", "vecs").groupBy(*key, "row", "col").applyInArrow(tile, HITS)


def merged(hits: DataFrame, k: int) -> DataFrame:
    """Per query its k best neighbours over all tiles: query_id, scores, ids."""
    hits = save(hits, "hits")
    parts = max(1, hits.select(F.approx_count_distinct("query_id")).first()[0] // MERGE)
    schema = pa.schema([("query_id", pa.int64()), ("scores", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])

    def run(t: pa.Table) -> pa.Table:
        scores = [np.frombuffer(x, "<f8") for x in t.column("scores").to_pylist()]
        rows = np.repeat(t.column("query_id").to_numpy(), [len(x) for x in scores])
        rows, scores, ids = top(rows, np.concatenate(scores), np.concatenate([np.frombuffer(x, "<i8") for x in t.column("ids").to_pylist()]), k)
        query, start = np.unique(rows, return_index=True)
        cuts = pa.array(np.append(start, len(rows)).astype(np.int32))
        return pa.Table.from_arrays([pa.array(query), pa.ListArray.from_arrays(cuts, pa.array(scores)), pa.ListArray.from_arrays(cuts, pa.array(ids))], schema=schema)

    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")
    return hits.select(part, "query_id", "scores", "ids").groupBy("part").applyInArrow(run, "query_id long, scores array<double>, ids array<long>")


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), F.col("embedding").alias("vec"))
    return search(vectors, F.pmod("vec_id", F.lit(20)) == 0)
