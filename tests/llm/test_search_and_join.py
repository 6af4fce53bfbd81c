"""Operators 1, 2, 3 and 7 against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsignal.llm import components, cross_polytope, jaccard_join, token_files, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_token_counts(spark, documents, odd_rows, tmp_path):
    rows = [*odd_rows, (30, "<|endoftext|> is text")]
    encode = token_files.encoder(token_files.RANKS).encode_ordinary
    got = token_files.token_counts(documents(rows).repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((r[0] or -1, len(encode(r[1] or ""))) for r in rows)
    assert token_files.token_counts(documents([])).count() == 0


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    want = []
    for name in ("a", "b", "c"):
        tokens = [9 if rng.random() < 0.2 else rng.randint(10, 60_000) for _ in range(200)] + ([9] if name == "a" else [])
        (tmp_path / f"{name}.bin").write_bytes(np.array(tokens, "<u2").tobytes())
        start = 0
        for i, x in enumerate(tokens):
            if x == 9:
                want.append((f"{name}.bin", start, i - start, True))
                start = i + 1
        if start < len(tokens):
            want.append((f"{name}.bin", start, len(tokens) - start, False))
    (tmp_path / "empty.bin").write_bytes(b"")
    got = token_files.scan_token_files(spark, str(tmp_path), separator=9, block_bytes=block).collect()
    assert sorted((r.file, r.start, r.n_tokens, r.finished) for r in got) == sorted(want)
    for name in ("a.bin", "b.bin", "c.bin"):
        mine = sorted((r.ordinal, r.start) for r in got if r.file == name)
        assert [o for o, _ in mine] == list(range(len(mine))) and mine == sorted(mine, key=lambda x: x[1])


def brute_neighbours(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x[i] * x).sum(axis=1)
        s[ids == ids[i]] = -np.inf
        order = np.lexsort((ids, -s))
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order[:k] if s[j] > -np.inf]
    return out


def vectors(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, vec array<float>")


def recall(spark, x, **options):
    x = x.astype(np.float32).astype(float)
    ids = np.arange(len(x))
    got = cross_polytope.search(vectors(spark, ids, x), F.col("vec_id") % 20 == 0, **options).collect()
    want = brute_neighbours(ids, x, 20)
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, hits in mine.items():
        hits.sort()
        assert [r for r, _, _ in hits] == list(range(1, len(want[q]) + 1))
        for (_, v, s), (_, v2, s2) in zip(hits, hits[1:], strict=False):
            assert s > s2 or (s == s2 and v < v2)
        for _, v, s in hits:
            assert abs(s - x[q] @ x[v]) < 1e-9 * max(1, abs(s))
    assert set(mine) == set(want)
    # a tie with the last counts as found
    return sum(s >= want[q][-1][1] for q in want for _, _, s in mine[q]) / sum(map(len, want.values()))


def test_all_probes_are_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 10)).astype(np.float32).astype(float)
    x[50:120] = x[0]  # ties
    ids = np.arange(300)
    got = cross_polytope.search(vectors(spark, ids, x), F.col("vec_id") % 20 == 0, tables=16, probes=32).collect()
    found = sum((r.vec_id, r.score) in brute_neighbours(ids, x, 20)[r.query_id] for r in got)
    assert len(got) == 300 and found >= 0.99 * len(got)


@pytest.mark.parametrize("kind", ["random", "uneven", "clustered", "skewed", "few"])
def test_recall(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500 if kind == "few" else 6000, 64 if kind == "few" else 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "uneven":
        x *= rng.uniform(0.6, 1.4, size=(6000, 1))
    if kind == "skewed":
        x *= np.exp(rng.normal(size=(6000, 1)))
    if kind == "clustered":
        x = rng.normal(size=(40, 32))[rng.integers(0, 40, 6000)] + 0.5 * x
    assert recall(spark, x) >= 0.9


def test_short_lists_are_filled(spark):
    """Queries far from all other vectors find their k all the same."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=32)
    x = v + 0.01 * rng.normal(size=(2850, 32))
    x[:100:20] = -v + 0.01 * rng.normal(size=(5, 32))
    got = cross_polytope.search(vectors(spark, np.arange(2850), x), F.col("vec_id").isin(0, 20, 40, 60, 80, 100)).collect()
    assert Counter(r.query_id for r in got) == dict.fromkeys((0, 20, 40, 60, 80, 100), 20)
    s = x @ x[0]
    s[0] = -np.inf
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0][:4] == np.argsort(-s)[:4].tolist()


def test_repeated_ids_count_once(spark):
    rows = [(0, [1.0, 0.1])] + [(7, [1.0, 0.2])] * 50 + [(7, [1.0, 0.3 + i / 100]) for i in range(30)] + [(i, [1.0, -i / 100]) for i in range(21, 60)]
    got = sorted((r["rank"], r.vec_id) for r in cross_polytope.search(spark.createDataFrame(rows, "vec_id long, vec array<double>"), F.col("vec_id") == 0).collect())
    assert got == [(1, 7), *((i + 2, 21 + i) for i in range(19))]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [0.5, 0.5]), (8, [0.5, 0.5]), (20, [-1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, vec array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in cross_polytope.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 8, 0.5), (0, 2, 20, -1.0), (20, 1, 8, -0.5), (20, 2, 0, -1.0)]
    assert cross_polytope.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def shingle_set(text):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, s) in enumerate(sets):
        least[root(a)] = min(i, least.get(root(a), i))
    return sorted((i, len(s), least[root(a)]) for a, (i, s) in enumerate(sets))


def near_copies(rng, n_base, copies, words=(6, 300), vocabulary=4000):
    rows = []
    for _ in range(n_base):
        base = [f"w{rng.randint(0, vocabulary)}" for _ in range(rng.randint(*words))]
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                t[rng.randrange(len(t))] = f"w{rng.randint(0, vocabulary)}"
            rows.append((len(rows), " ".join(t).title()))
    return rows


def test_join_is_exact(spark, documents):
    rows = near_copies(random.Random(7), 60, 6) + []
    passage = " ".join(f"p{i}" for i in range(70))
    rows += [(1000 + i, f"{passage} q{i} r{i} s{i} t{i} u{i} v{i} " + " ".join(f"x{i}{k}" for k in range(i % 25))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "one two"), (2005, "one two three"), (2006, "ONE two")]
    got = jaccard_join.jaccard_join(documents(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


@pytest.mark.parametrize("hot_from", [1, 5])
def test_spread_lists_are_exact(spark, documents, hot_from):
    """Texts of one passage and few other words, whose combinations' lists are spread over several groups; near copies of near copies."""
    rng = random.Random(hot_from)
    passage = [f"p{i}" for i in range(90)]
    rows = []
    for i in range(200):
        words = list(passage)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(90)] = f"z{rng.randint(0, 5)}"
        rows.append((i, " ".join(words[: rng.randint(60, 90)])))
    got = jaccard_join.jaccard_join(documents(rows), hot_from).collect()
    want = brute_components(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want and 1 < len({c for _, _, c in want}) < 150
    order = jaccard_join.Order(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.full(1 << 24, 255, np.uint8), 6)
    order.classes = lambda s: np.full(len(s), 7)
    assert (jaccard_join.keys(jaccard_join.shingles(rows[0][1]), order, hot_from)[1] == 1 << (7 - hot_from)).all()


@pytest.mark.parametrize("common", [False, True])
def test_near_misses_do_not_meet(spark, documents, monkeypatch, common):
    """Texts that share 26 of 30 shingles do not link, and the pairs that are looked at grow at most with their number."""
    if common:
        monkeypatch.setattr(jaccard_join, "COMBINE_FROM", 2)
    seen = []
    plain = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, sets: (seen.append(pairs.count()), plain(pairs, sets))[1])
    passage = " ".join(f"p{i}" for i in range(30))
    counts = []
    for n in (100, 300):
        seen.clear()
        rows = [(i, f"{passage} q{i} r{i} s{i} t{i}") for i in range(n)]
        rows += [(1000 + i, f"{passage} q0 r0 s0 u{i}") for i in range(5)]  # these link with one of them
        got = jaccard_join.jaccard_join(documents(rows)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
        counts.append(sum(seen))
    assert counts[1] <= 3 * counts[0] + 30


def test_rows_without_id_carry_links(spark, documents):
    words = [f"w{i}" for i in range(104)]
    middle, right = words[10:], words[20:]  # neighbours link, the ends do not
    rows = [(1, " ".join(words)), (None, " ".join(middle)), (None, " ".join(middle)), (3, " ".join(right + ["v1", "v2", "v3", "v4", "v5", "v6"]))]
    got = jaccard_join.jaccard_join(documents(rows)).collect()
    assert brute_components([(r[0] or 2, r[1]) for r in rows])[-1][2] == 1
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (None, 1), (3, 1)}
    assert brute_components([rows[0], rows[3]])[-1][2] == 3
    alone = jaccard_join.jaccard_join(documents(rows[1:2])).collect()
    assert [(r.doc_id, r.component_id) for r in alone] == [(None, None)]


def test_unlike_rows_of_one_id_stay(spark, documents):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (5, " ".join(words)), (5, " ".join(f"v{i}" for i in range(40))), (5, " ".join(f"v{i}" for i in range(40))), (6, ""), (6, None), (7, "a b c"), (7, "a b d")]
    got = jaccard_join.first_of_each(documents(rows)).collect()
    assert sorted((r.doc_id, (r.text or "")[:2]) for r in got) == [(1, "w0"), (5, "v0"), (6, ""), (6, ""), (7, "a "), (7, "a ")]


def test_combinations_are_exact(spark, documents, monkeypatch):
    """With every repeated shingle taken as frequent, only combinations find links."""
    monkeypatch.setattr(jaccard_join, "COMBINE_FROM", 1)
    rows = near_copies(random.Random(77), 12, 40)
    order = jaccard_join.Order(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.full(1 << 24, 255, np.uint8), 6)
    order.classes = lambda s: np.full(len(s), 7)
    keys, short = {}, {}
    for i, t in rows:
        k, _, of_short = jaccard_join.keys(jaccard_join.shingles(t), order)
        keys[i], short[i] = set(k.tolist()), set(k[of_short].tolist())
    sets = {i: shingle_set(t) for i, t in rows}
    n = 0
    for a in sets:
        for b in range(a):
            if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                small, large = sorted((a, b), key=lambda i: len(sets[i]))
                assert short[small] & keys[large]
                n += 1
    assert n > 100


def test_signatures_bound_the_overlap():
    rng = np.random.default_rng(0)
    pruned = 0
    for _ in range(500):
        n = int(rng.integers(2, 900))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[int(rng.integers(0, len(a))) // 3 :], rng.integers(0, 2**63, int(rng.integers(0, n // 3 + 1))).astype(np.uint64))))
        same = len(np.intersect1d(a, b))
        x, y = jaccard_join.folded([jaccard_join.signature(a), jaccard_join.signature(b)])
        differ = int(np.bitwise_count(x ^ y).sum())
        assert differ <= len(a) + len(b) - 2 * same
        pruned += 9 * ((len(a) + len(b) - differ) // 2) < 4 * (len(a) + len(b))
    assert pruned > 250


def test_join_odd(spark, documents, odd_rows):
    got = jaccard_join.jaccard_join(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[5][1] == by[6][1] == by[None][1] == 5 and by[7] == (1, 7)
    assert jaccard_join.jaccard_join(documents([])).count() == 0
    kept = jaccard_join.first_of_each(documents(odd_rows))
    assert sorted(r.doc_id or -1 for r in kept.select("doc_id").collect()) == [-1, 1, 2, 3, 4, 5, 7, 8, 9, 10]
    assert kept.columns == documents([]).columns


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(rng.randint(300, 360), rng.randint(300, 360)) for _ in range(40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    table = lambda e: spark.createDataFrame(e, "a long, b long")
    want = {x: root(x) for x in list(parent)}
    assert {r.node: r.label for r in components.components(table(edges)).collect()} == want
    some = components.components(table(edges[::2]))
    assert {r.node: r.label for r in components.extended(some, table(edges[1::2])).collect()} == want


def test_index_gives_exact_neighbours():
    rng = random.Random(9)
    dense = np.zeros((500, 41))
    for v in dense:
        for _ in range(rng.randint(1, 8)):
            v[rng.randint(0, 40)] = rng.random()
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    sparse = [(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in dense]
    index = toxicity.Index(sparse, 41, np.zeros(500, int), np.ones(500, int), list(range(500)))
    for i in range(60):
        sims = np.sort(dense @ dense[i])[::-1]
        got, place = index.nearest(*sparse[i], 15)
        assert np.allclose(got[:15], sims[:15], atol=1e-6) and np.allclose(got, [dense[index.example[p]] @ dense[i] for p in place], atol=1e-6)
        assert len(got) >= 15 and (len(got) == 500 or got[-1] > sims[len(got)] - 1e-6)
    everything, _ = index.nearest(np.zeros(0, np.int64), np.zeros(0), 15)
    assert len(everything) == 500


def brute_scores(rows, labels, sample):
    """Scores in plain Python: all words, whole texts, all examples compared."""
    tokens = lambda t: Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    text = dict(rows)
    examples = [(i, tokens(text[i]), labels[i]) for i in sample]
    total, prior = len(examples), sum(y for _, _, y in examples) / len(examples)
    n, bad = Counter(), Counter()
    for _, c, y in examples:
        n.update(c.keys())
        bad.update(c.keys() if y else [])

    def weight(t):
        if t not in n:
            return math.log(total + 1) + 1
        g = 0.0
        for x, share in ((bad[t], prior), (n[t] - bad[t], 1 - prior)):
            g += 2 * x * math.log(x / (n[t] * share)) if x else 0.0
        return (math.log((total + 1) / (n[t] + 1)) + 1) * (1 + max(0.0, math.sqrt(max(0.0, g)) - 3))

    def vector(c):
        v = {t: (1 + math.log(k)) * weight(t) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    vs = [vector(c) for _, c, _ in examples]

    def vote(v, without=None):
        sims = [(sum(x * o.get(t, 0.0) for t, x in v.items()), j) for j, o in enumerate(vs) if j != without]
        edge = sorted(sims, reverse=True)[: toxicity.NEAREST][-1][0]
        top, all_ = prior, 1.0
        for s, j in sims:
            if s >= edge - 1e-7:
                w = 1 / (0.02 + max(0.0, 1 - s)) ** 2
                top, all_ = top + w * examples[j][2], all_ + w
        return top / all_

    steps = toxicity.isotonic([(vote(v, j), examples[j][2], 1) for j, v in enumerate(vs)])
    return {i: float(np.interp(vote(vector(tokens(t))), *steps)) for i, t in rows}


def test_toxicity_scores_are_those_of_whole_texts(spark, documents):
    rng = random.Random(3)
    rows, labels = [], {}
    for i in range(160):
        some = [f"w{'abcdefgh'[rng.randint(0, 7)]}{'ijklmnop'[int(rng.random() ** 2 * 8)]}{'qrst'[rng.randint(0, 3)]}" for _ in range(rng.randint(0, 40))]
        labels[i] = int(rng.random() < 0.25)
        rows.append((i, " ".join(some + ["vile"] * (labels[i] and rng.randint(0, 2)))))
    sample = [i for i in labels if zlib.crc32(str(i).encode()) % 5]
    want = brute_scores(rows, labels, sample)
    got = toxicity.toxicity(documents(rows), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()
    assert len({round(r.score, 6) for r in got}) > 3
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-4, r.doc_id


def test_toxicity_on_held_out_rows(spark, documents):
    rng = random.Random(5)
    plain, bad = [f"word{i}" for i in range(800)], ["vile", "nasty", "lowbrow", "scorn"]
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(plain) for _ in range(60)]
        y = rng.random() < 0.2
        for _ in range(rng.randint(2, 5) if y else 0):
            words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(y)))
    got = toxicity.toxicity(documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).filter("held_out").collect()
    truth = dict(labels)
    assert len(got) > 200 and sum(r.predicted == truth[r.doc_id] for r in got) / len(got) > 0.95
    kept = toxicity.kept(documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == documents([]).columns and abs(kept.count() - sum(1 - y for _, y in labels)) < 60


def test_toxicity_odd(spark, documents, odd_rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(documents(odd_rows), none).collect()
    assert len(got) == len(odd_rows) and all(r.score == 0 and r.predicted == 0 for r in got)
    some = spark.createDataFrame([(5, 1), (5, 0), (6, None), (None, 1), (2, 0), (7, 0), (1, 0), (99, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(documents(odd_rows), some).collect())
    assert toxicity.toxicity(documents([]), some).count() == 0
