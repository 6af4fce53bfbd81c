"""Operators 4, 6 and 8 against plain Python."""

import itertools
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from docsignal.llm import length_buckets, mixing, quality_rules, token_files, weak

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram.items())


def test_boundaries_are_optimal():
    rng = random.Random(4)
    for _ in range(200):
        h = {rng.randint(0, 40): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}
        k = rng.randint(1, 4)
        lengths = sorted(h)
        best = min(padding(h, [*c, lengths[-1]]) for r in range(min(k, len(h))) for c in itertools.combinations(lengths[:-1], r))
        ends = length_buckets.boundaries(h, k)
        assert len(ends) <= k and padding(h, ends) == best


def test_packing(spark, documents, odd_rows):
    rows = length_buckets.pack(length_buckets.lengths(documents(odd_rows)), n_buckets=3, budget=300).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == sorted((r[0] or -1, len(WORD.findall(r[1] or ""))) for r in odd_rows)
    batches = defaultdict(list)
    for r in rows:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    for b in batches.values():
        assert len({r.slot for r in b}) == len(b)
        assert len(b) == 1 or len(b) * b[0].bucket_len <= 300
    assert length_buckets.pack(length_buckets.lengths(documents([]))).count() == 0


def test_packing_counts_tokens(spark, documents, tmp_path):
    rows = [(1, None), (2, ""), (3, "one two three"), (4, "QUJDREVGR0hJSktMTU5PUA" * 200), (5, "\u5b66\u4e60\u8bad\u7ec3" * 50), (6, "unbelievably antidisestablishmentarian")]
    df = documents(rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    encode = token_files.encoder(token_files.RANKS).encode_ordinary
    want = sorted((i, len(encode(t or ""))) for i, t in rows)
    for got in (length_buckets.op4_length_buckets(spark, str(tmp_path)), corpus_pipeline.pack_batches(spark, df, "")):
        assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == want
    assert length_buckets.pack(length_buckets.token_lengths(documents([]))).count() == 0


def test_resolution_bounds_the_histogram(spark):
    df = spark.createDataFrame([(x,) for x in (0, 5, 16384, 16385, 40_000, 10**9)], "n long").select("n", length_buckets.resolved(F.col("n")).alias("r"))
    for n, r in df.collect():
        assert n <= r <= n * (1 + 1 / 1000) and (n > 16384 or r == n)


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {j for i, g in enumerate(grams) if g in twice for j in (i, i + 1, i + 2)}
    lines, seen, copies = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            copies += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered)


def test_quality_counts(spark, documents, odd_rows):
    rows = [*odd_rows, (20, "a b c a b c a b\na b\na b\n\n x"), (21, "x|y ## <b>\n" * 40)]
    got = quality_rules.quality_rules(documents(rows)).collect()
    want = sorted(((r[0] or -1), *brute_quality(r[1])) for r in rows)
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(documents([])).count() == 0


def test_label_model_finds_reliabilities():
    rng = random.Random(6)
    right = (0.95, 0.9, 0.7)
    seen = Counter()
    truth = {}
    for _ in range(20_000):
        y = rng.random() < 0.7
        v = tuple(-1 if rng.random() < 0.1 else int(y if rng.random() < p else not y) for p in right)
        seen[v] += 1
        truth.setdefault(v, [0, 0])[y] += 1
    model = weak.fit(seen, 3)
    for got, p in zip(model.right_for, right):
        assert abs(got - p) < 0.05
    wrong = sum(min(model.posterior(v) >= 0.5, 1) * n[0] + (model.posterior(v) < 0.5) * n[1] for v, n in truth.items())
    assert wrong / 20_000 < 0.08
    assert weak.fit({}, 2).prior == 0.5


def brute_targets(sizes):
    """By source in order of code points, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        each = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if each[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else each[s] for s in order}
        full |= over


def test_mixing(spark, documents):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 60))) if i % 50 else None, rng.choice(["a", "b", "é", "Z", None, "b", "b"])) for i in range(3000)]
    df = documents(rows)
    got = mixing.mix(df, weight=F.expr(mixing.LESS_IF_LONG)).collect()
    again = mixing.mix(df.repartition(7), weight=F.expr(mixing.LESS_IF_LONG)).collect()
    assert sorted(got) == sorted(again) and len(got) == len(rows)
    size, source = {i: len(WORD.findall(t or "")) for i, t, _ in rows}, {i: s for i, _, s in rows}
    per = Counter()
    for i in size:
        per[source[i]] += size[i]
    want = brute_targets(per)
    taken = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == per[source[r.doc_id]] and 0 <= r.copies <= 2
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * want[source[r.doc_id]]
        taken[source[r.doc_id]] += r.size * r.copies
    for s, x in want.items():
        assert abs(taken[s] - x) <= 60
    kept = mixing.mixed(df, weight=F.expr(mixing.LESS_IF_LONG))
    assert kept.columns == df.columns and kept.filter("key <> 'key'").count() == 0
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mixing_odd(spark, documents, odd_rows):
    assert len(mixing.mix(documents(odd_rows)).collect()) == len(odd_rows)
    assert mixing.mix(documents([])).count() == 0
    assert [r.copies for r in mixing.mix(documents([(1, None), (2, "")])).collect()] in ([0, 0], [1, 1], [2, 2])


def test_mixing_reaches_targets_with_very_long_documents(spark, documents):
    """A capped source needs every document twice; elsewhere what most takes from short documents goes to the long ones."""
    long = " ".join("w" * 30_000)
    rows = [(0, long, "a"), *((10_000 + i, " ".join("w" * 50), "a") for i in range(400))]
    rows += [(100, " ".join("w" * 60_000), "b"), *((100 + i, " ".join("w" * 20), "b") for i in range(1, 2001))]
    rows += [(5000 + i, " ".join("w" * 100), "c") for i in range(1800)]
    got = mixing.mix(documents(rows), weight=F.expr(mixing.LESS_IF_LONG)).collect()
    source, taken, target = {r[0]: r[2] for r in rows}, Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.size * r.copies
        target[source[r.doc_id]] = r.target, r.source_size
    assert target["a"][0] == 2 * target["a"][1] and {r.copies for r in got if source[r.doc_id] == "a"} == {2}
    assert abs(taken["c"] - target["c"][0]) <= 50


def test_expected_copies_hold_the_target(spark):
    base = spark.createDataFrame([("s", 10, 1.0)] * 50 + [("s", 1000, 0.01), ("s", 3000, 0.001)], "key string, size long, w double")
    per = spark.createDataFrame([("s", 4500, 4000.0), ("t", 0, 0.0)], "key string, source_size long, target double")
    level = {r.key: r.level for r in mixing.levels(base, per, 2).collect()}
    assert level["t"] == 0.0 and abs(sum(r["size"] * min(2.0, level["s"] * r.w) for r in base.collect()) - 4000) < 1e-6
