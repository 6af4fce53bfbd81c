"""Toxicity by nearest labelled examples (operator 3).

A bounded sample of labelled rows (SAMPLE, by hash of doc_id, training folds only) is fitted. Every word
of a sampled text is a term. A term's weight is its frequency's logarithm times its inverse document
frequency, raised for terms that go with the label beyond chance; no term is left out, and words that
the sample does not hold count in a text's norm, so that the cosine is that of whole texts. Every whole
text is scored by its nearest examples, found exactly in an inverted index whose blocks hold the
greatest weight of each term: blocks that cannot reach the nearest few are left out. The lists of the
most frequent terms are dense rows, multiplied for many texts at once, and sharpen the blocks' bounds. Votes are weighted
by distance; isotonic regression over the examples' leave-one-out votes turns them into probabilities.
The nearest examples' ids are given as evidence.

Defined results: null and empty texts, and texts without any word of the sample, are equally far from
all examples, which all vote. Without labels of both kinds the score is the share of toxic labels, or
0. Examples at equal distance vote together. Repeated rows are scored alike; of repeated labels of one
doc_id the greatest counts, of repeated rows of a labelled doc_id with different texts the one of the
smallest hash. A null doc_id is carried and not held out. An empty table gives an empty result. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, save, table, tidied, trim

SAMPLE = 6000
NEAREST = 15
BLOCK = 64
#: Blocks that are scored before the others are held against them.
FIRST = 12
#: Terms in more than 1 / OFTEN of the examples have a dense list.
OFTEN = 20
TIE = 1e-9
FOLDS = 5
#: Standard deviations, about, that a term's share of toxic examples may differ from the whole's by chance.
CHANCE = 3.0
WORD = re.compile(r"[^\W\d_]+")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def words(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start[i] ... start[i] + n[i] - 1 for each i in turn."""
    total = np.cumsum(n)
    out = np.ones(int(total[-1]) if len(n) else 0, np.int64)
    if len(out):
        # steps of one inside a range, and to the next one's start at its end; no range is empty
        out[0] = start[0]
        out[total[:-1]] = start[1:] - start[:-1] - n[:-1] + 1
    return np.cumsum(out)


class Index:
    """Distinct example vectors (terms, weights) behind an inverted index in blocks of BLOCK vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, toxic: np.ndarray, total: np.ndarray, example: list[int]) -> None:
        # vectors with the same heaviest terms go to the same blocks
        order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0][np.argsort(-vectors[i][1], kind="stable")[:8]].tolist(), example[i]))
        self.toxic, self.total, self.example = toxic[order], total[order], [example[i] for i in order]
        self.n_blocks = -(-len(order) // BLOCK)
        each = [len(vectors[i][0]) for i in order]
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int32)
        # weights have the precision in which they travel, so that all copies of the index give the same sums
        weight = (np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)).astype(np.float32).astype(np.float64)
        place = np.repeat(np.arange(len(order), dtype=np.int32), each)
        # lists of a tenth of the examples and more are dense rows; the others lie in blocks
        often = np.bincount(term, minlength=n_terms) * OFTEN > len(order)
        self.dense_at = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((int(often.sum()), len(order)))
        wide = often[term]
        self.dense[self.dense_at[term[wide]], place[wide]] = weight[wide]
        term, place, weight = term[~wide], place[~wide], weight[~wide]
        at = np.lexsort((place, term))
        term, self.place, self.weight = term[at], place[at].astype(np.int32), weight[at]
        block = self.place // BLOCK
        first = np.ones(len(term), bool)
        first[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        self.start = np.flatnonzero(first)
        self.size = np.diff(np.append(self.start, len(term)))
        self.block = block[self.start]
        self.most = np.maximum.reduceat(self.weight, self.start) if len(term) else self.weight
        self.of_term = np.searchsorted(term[self.start], np.arange(n_terms + 1))

    def __getstate__(self) -> dict:
        """Half the bytes for the way."""
        narrow = {np.dtype(np.float64): np.float32, np.dtype(np.int64): np.int32}
        return {k: v.astype(narrow[v.dtype]) if isinstance(v, np.ndarray) and v.dtype in narrow else v for k, v in self.__dict__.items()}

    def __setstate__(self, state: dict) -> None:
        wide = {np.dtype(np.float32): np.float64, np.dtype(np.int32): np.int64}
        self.__dict__.update({k: v.astype(wide[v.dtype]) if isinstance(v, np.ndarray) and v.dtype in wide and k != "place" else v for k, v in state.items()})

    def partial(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the frequent terms give to the similarities of vectors (rows) with all examples."""
        asked = np.zeros((len(vectors), len(self.dense)))
        for row, (terms, weights) in zip(asked, vectors, strict=True):
            at = self.dense_at[terms]
            row[at[at >= 0]] = weights[at >= 0]
        return asked @ self.dense

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None, partial: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, places), nearest first, until k examples are counted and with all that tie with the last.

        without: a place that counts one example less. partial: this vector's row of partial().
        """
        if not self.example:
            return np.zeros(0), np.zeros(0, np.int64)
        found = (self.partial([(terms, weights)])[0] if partial is None else partial).copy()
        rare = self.dense_at[terms] < 0
        terms, weights = terms[rare], weights[rare]
        n = self.of_term[terms + 1] - self.of_term[terms]
        if not n.all():
            terms, weights, n = terms[n > 0], weights[n > 0], n[n > 0]
        entries = ranges(self.of_term[terms], n)
        entry_weight, block = np.repeat(weights, n), self.block[entries]
        bound = np.bincount(block, entry_weight * self.most[entries], minlength=self.n_blocks) + np.maximum.reduceat(found, np.arange(0, len(found), BLOCK))
        left = np.argsort(-bound, kind="stable")
        count = self.total
        if without is not None:
            count = count.copy()
            count[without] -= 1
        seen, kth = np.zeros(self.n_blocks, bool), -1.0
        here = left[:FIRST]
        while len(here):
            chosen = np.zeros(self.n_blocks, bool)
            chosen[here] = True
            mine = np.flatnonzero(chosen[block])
            e = entries[mine]
            size = self.size[e]
            postings = ranges(self.start[e], size)
            found += np.bincount(self.place[postings], np.repeat(entry_weight[mine], size) * self.weight[postings], minlength=len(found))
            seen |= chosen
            known = np.flatnonzero(np.repeat(seen, BLOCK)[: len(found)])
            top = known if len(known) <= k + 1 else known[np.argpartition(-found[known], k)[: k + 1]]
            top = top[np.argsort(-found[top], kind="stable")]
            enough = np.flatnonzero(np.cumsum(count[top]) >= k)
            kth = found[top[enough[0]]] if len(enough) else -1.0
            here = np.flatnonzero(~seen & (bound >= kth - TIE))
        known = np.flatnonzero(np.repeat(seen, BLOCK)[: len(found)] & (found >= kth - TIE))
        near = np.round(found[known], 9)  # sums may differ in their last digits with the company they are made in
        order = np.lexsort((known, -near))
        return near[order], known[order]


class Model:
    """vocabulary: the sample's words. weight: of each, then of a word that the sample does not hold."""

    def __init__(self, vocabulary: dict[str, int], weight: np.ndarray, prior: float) -> None:
        self.vocabulary, self.weight, self.prior = vocabulary, weight, prior
        self.memo: dict[int, tuple[float, list[int], float]] = {}
        self.index: Index | None = None
        self.own: dict[int, int] = {}

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms in order with their counts; all words beyond the vocabulary have the number after its last, each an entry."""
        got = words(text)
        unknown = len(self.vocabulary)
        terms = np.fromiter(map(self.vocabulary.get, got, repeat(unknown)), np.int32, len(got))
        at = np.argsort(terms, kind="stable")
        return terms[at], np.fromiter(got.values(), np.int32, len(got))[at]

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weight[terms]
        known = int(np.searchsorted(terms, len(self.vocabulary)))
        norm = math.sqrt(float((w * w).sum()))
        return terms[:known].astype(np.int64), (w / norm if norm else w)[:known]

    def learn(self, examples: list[tuple[int, bytes, bytes, int]]) -> None:
        """Indexes (doc_id, terms, counts, toxic); equal vectors are one place."""
        groups: dict[tuple[bytes, bytes], list[int]] = {}
        for doc_id, terms, counts, toxic in examples:
            g = groups.setdefault((terms, counts), [0, 0, doc_id])
            g[0] += toxic
            g[1] += 1
            g[2] = min(g[2], doc_id)
        vectors = [(t.astype(np.int32), w.astype(np.float32)) for t, w in (self.vector(np.frombuffer(t, "<i4"), np.frombuffer(c, "<i4")) for t, c in groups)]
        found = list(groups.values())
        self.index = Index(vectors, len(self.vocabulary), np.array([g[0] for g in found]), np.array([g[1] for g in found]), [g[2] for g in found])
        place = {e: i for i, e in enumerate(self.index.example)}
        self.own = {doc_id: place[groups[terms, counts][2]] for doc_id, terms, counts, _ in examples}

    def vote(self, similarity: np.ndarray, place: np.ndarray, without: int | None = None, label: int = 0) -> float:
        """Share of toxic examples by weight, with one example's worth of the prior at distance 1. without: a place with one example of this label less."""
        w = 1 / (0.02 + np.maximum(0, 1 - similarity)) ** 2
        own = place == (-1 if without is None else without)
        top = self.prior + float((w * (self.index.toxic[place] - own * label)).sum())
        return top / (1 + float((w * (self.index.total[place] - own)).sum()))

    def scores(self, texts: list[str | None], steps: tuple[np.ndarray, np.ndarray] | None) -> list[tuple[float, list[int], float]]:
        """For each text its probability, nearest examples (up to 3) and the similarity of the first."""
        if self.index is None:
            return [(self.prior, [], 0.0)] * len(texts)
        out = []
        for lo in range(0, len(texts), 64):
            keys = [xxhash.xxh3_64_intdigest((x or "").encode("utf-8", "replace")) for x in texts[lo : lo + 64]]
            fresh = {k: x for k, x in zip(keys, texts[lo : lo + 64], strict=True) if k not in self.memo}
            if len(self.memo) > 50_000:
                fresh = dict(zip(keys, texts[lo : lo + 64], strict=True))
                self.memo.clear()
            vectors = [self.vector(*self.counts(x)) for x in fresh.values()]
            for k, v, partial in zip(fresh, vectors, self.index.partial(vectors), strict=True):
                similarity, place = self.index.nearest(*v, NEAREST, partial=partial)
                at = float(np.interp(self.vote(similarity, place), *steps))
                self.memo[k] = min(1.0, max(0.0, at)), [self.index.example[p] for p in place[:3]], float(similarity[0]) if len(place) else 0.0
            out += [self.memo[k] for k in keys]
        return out


def isotonic(votes: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over (vote, label, weight): the mean votes and probabilities of its steps."""
    pools: list[list[float]] = []
    for v, y, n in sorted(votes):
        pools.append([v * n, y * n, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            v2, y2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + v2, pools[-1][1] + y2, pools[-1][2] + n2]
    return np.array([v / n for v, _, n in pools]), np.array([(y + 0.02) / (n + 0.04) for _, y, n in pools])


def weights(n: np.ndarray, bad: np.ndarray, total: int, prior: float) -> np.ndarray:
    """Of terms in n of `total` examples, `bad` of them toxic: inverse document frequency, times what the
    root of the likelihood ratio (about a normal deviate) has beyond chance; at last that of an unseen term."""
    good = n - bad
    part = lambda x, share: np.where(x > 0, x * np.log(np.maximum(x, 1) / (n * share)), 0.0)
    z = np.sqrt(np.maximum(0, 2 * (part(bad, prior) + part(good, 1 - prior))))
    idf = np.log((total + 1) / (n + 1)) + 1
    return np.append(idf * (1 + np.maximum(0, z - CHANCE)), math.log(total + 1) + 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """docs: doc_id, text; labels: doc_id, toxic, already without the held-out fold. Gives the model, broadcast once, and its steps."""
    spark = docs.sparkSession
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    rows = save(found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "examples")
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = toxic / total if total else 0.0
    if not 0 < prior < 1:
        return spark.sparkContext.broadcast(Model({}, np.zeros(1), float(prior))), None

    def count(batch: Iterable[tuple]) -> Iterator[tuple]:
        n: Counter = Counter()
        bad: Counter = Counter()
        for _, y, text in batch:
            some = words(text).keys()
            n.update(some)
            if y:
                bad.update(some)
            if len(n) > 1_000_000:
                yield from ((t, k, bad[t]) for t, k in n.items())
                n.clear()
                bad.clear()
        yield from ((t, k, bad[t]) for t, k in n.items())

    each = map_rows(rows, count, "term string, n long, bad long", batch=20_000).groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).toArrow().sort_by("term")
    model = Model({t: i for i, t in enumerate(each.column("term").to_pylist())}, weights(each.column("n").to_numpy(), each.column("bad").to_numpy(), total, prior), prior)
    shared = spark.sparkContext.broadcast(model)

    def vectors(batch: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, y, text in batch:
            terms, counts = shared.value.counts(text)
            yield doc_id, terms.tobytes(), counts.tobytes(), y

    held = save(map_rows(rows, vectors, "doc_id long, terms binary, counts binary, toxic int"), "vectors")
    rows = held.orderBy("doc_id").toArrow()
    model.learn(list(zip(*(rows.column(c).to_pylist() for c in held.columns), strict=True)))
    shared.destroy()
    known = spark.sparkContext.broadcast(model)
    del model, rows, each
    trim()

    def votes(batch: Iterable[tuple]) -> Iterator[tuple]:
        """Each example's vote without itself."""
        m = known.value
        for doc_id, terms, counts, y in batch:
            own = m.own[doc_id]
            near = m.index.nearest(*m.vector(np.frombuffer(terms, "<i4"), np.frombuffer(counts, "<i4")), NEAREST, own)
            yield m.vote(*near, own, y), y

    return known, isotonic([(r["vote"], r["toxic"], 1) for r in map_rows(held, votes, "vote double, toxic int").collect()])


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """labels: doc_id, toxic; rows of the held-out fold are left out here."""
    shared, steps = fit(docs, labels.filter(fold(F.col("doc_id")) != 0), sample)

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        rows = iter(rows)
        while some := list(islice(rows, 256)):
            for (doc_id, held_out, _), (p, near, similarity) in zip(some, shared.value.scores([r[2] for r in some], steps), strict=True):
                yield doc_id, held_out, p, int(p >= 0.5), near, similarity

    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return map_rows(docs.select(F.col("doc_id").cast("long"), held, F.col("text").cast("string")), run, "doc_id long, held_out boolean, score double, predicted int, nearest array<long>, similarity double")


def kept(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    shared, steps = fit(docs, labels.filter(fold(F.col("doc_id")) != 0), sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                piece = b.slice(lo, 256)
                yield piece.filter(pa.array([p < 0.5 for p, _, _ in shared.value.scores(piece.column(at).to_pylist(), steps)], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
