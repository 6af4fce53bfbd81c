import datetime as dt
import difflib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsignal import schema
from docsignal.operators import caps, filters, joins, latest, monitor, state, titles
from docsignal.plans import report

T = dt.datetime


def test_ties_and_best(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "b", 1), (4, None, 9)], "id long, k string, v int")
    assert sorted(r.id for r in latest.latest_rows(df.filter("k is not null"), ["k"], "v").collect()) == [1, 2, 3]
    best = latest.best_of(df, F.col("k"), [F.col("v")], F.col("id"))
    assert sorted((r.id, r.position) for r in best.collect()) == [(1, 1), (3, 3), (4, 4)]
    assert sorted(r.id for r in latest.first_wins(df.union(spark.createDataFrame([(5, None, 1)], df.schema)), F.col("k"), F.col("id")).collect()) == [1, 3, 4, 5]


def test_caps(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i % 5 == 0) for i in range(20)], "id long, b string, u boolean")
    got = caps.bucket_caps(df, "b", {"a": 3}, F.col("id")).collect()
    assert sorted(r.id for r in got) == sorted([0, 2, 4, *range(1, 20, 2)]) and {r.left_out for r in got if r.b == "a"} == {7} and {r.left_out for r in got if r.b == "b"} == {0}
    got = caps.exempt_budget(df, F.col("u"), 6, F.col("id"))
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 5, 10, 15]
    assert sorted(r.id for r in caps.exempt_budget(df, F.col("u"), 2, F.col("id")).collect()) == [0, 5, 10, 15]
    routed = {r.id: (r.b, r.routed) for r in caps.urgent_cap(df, F.col("u"), 2, "b", F.lit("x"), "id", F.col("id")).collect()}
    assert len(routed) == 20 and routed[10] == ("x", True) and routed[5] == ("b", False) and routed[1] == ("b", False)


def test_collisions(spark):
    df = spark.createDataFrame([(1, "t", "a", "1"), (2, "t", "a", "2"), (3, "s", "q", "1"), (4, "w", "x", "1"), (5, "w", "y", "1"), (6, "z", "", "1"), (7, "z", "", "1")], "id long, title string, a string, b string")
    got = {r.id: r.shown for r in latest.collisions(df, "title", [("a", F.col("a")), ("b", F.col("b"))]).collect()}
    assert got == {1: "t — 1", 2: "t — 2", 3: "s", 4: "w — x", 5: "w — y", 6: "z", 7: "z"}


def test_state(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", None, True), (2, "b", 5, True)], "k long, s string, v int, active boolean")
    new = spark.createDataFrame([(2, None, 7, False), (3, "c", 8, True)], old.schema)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(state.upsert(old, new, ["k"], keep_old=["active"], fill=["s"])) == [(1, "a", None, True), (2, "b", 7, True), (3, "c", 8, True)]
    assert rows(state.append_new(old, new, "k")) == [(1, "a", None, True), (2, "b", 5, True), (3, "c", 8, True)]
    assert rows(state.fill_null(old, spark.createDataFrame([(1, "z", 9, False), (2, "z", 9, False)], old.schema), "k", ["v"])) == [(1, "a", 9, True), (2, "b", 5, True)]
    assert rows(state.overwrite(old, new, "k", ["s", "v"], keep_if_null=["s"])) == [(1, "a", None, True), (2, "b", 7, True)]
    assert rows(state.delete(old, F.col("v") == 5)) == [(1, "a", None, True)]
    assert rows(state.mark(old, new, "k", "active", False)) == [(1, "a", None, True), (2, "b", 5, False)]
    path = f"{tmp_path}/t"
    state.replace(old, path)
    state.replace(state.append_new(spark.read.parquet(path), new, "k"), path)
    assert spark.read.parquet(path).count() == 3


def test_new_items(spark):
    stored = spark.createDataFrame([("u0", "h0")], "url string, h string")
    items = spark.createDataFrame([(1, "u0", "x"), (2, "u1", "h0"), (3, "u2", "h2"), (4, "u2", "h3"), (5, "u3", "h2"), (6, "u4", "h4")], "id long, url string, h string")
    assert sorted(r.id for r in joins.new_items(items, stored, "url", "h", "id").collect()) == [3, 6]


def greedy_titles(rows):
    leaders, by_url, want = [], {}, {}
    for i, t, u in rows:
        t = t or ""
        at = by_url.get(u) if u else None
        if at is None and len(t) >= 24:
            for k, o in leaders:
                if len(o) >= 24 and (o == t or re.findall(r"\d+", o) == re.findall(r"\d+", t) and difflib.SequenceMatcher(None, t, o).ratio() >= 0.92):
                    at = k
                    break
        if at is None:
            at = i
            leaders.append((i, t))
        if u:
            by_url.setdefault(u, at)
        want[i] = at
    return want


@pytest.mark.parametrize("tile", [512, 3])
@pytest.mark.parametrize("urls", [True, False])
def test_similar_titles_is_greedy(spark, monkeypatch, tile, urls):
    monkeypatch.setattr(titles, "TILE", tile)
    rng = random.Random(4)
    base = ["order of the ministry on support for dairy farms no 12", "rules for grants to family farms and small producers", "list of measures for the export of grain in 2024", "x" * 23, "", "long line " * 40]
    rows = []
    for i in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 6]) if t else 0):
            x, c = rng.randrange(len(t)), rng.choice("abcdefgh ")
            t[x : x + rng.randint(0, 1)] = [c]  # put in, or in another's place
        rows.append((i, rng.choice(["", "", "a "]) + "".join(t) if i % 29 else None, rng.choice([f"u{rng.randint(0, 50)}", "", None])))
    df = spark.createDataFrame(rows, "id long, t string, u string")
    got = {r.id: r.leader for r in titles.similar_titles(df, "id", "t", "u" if urls else None, "id").collect()}
    assert got == greedy_titles([(i, t, u if urls else None) for i, t, u in rows])


def long_titles(n, seed):
    rng = random.Random(seed)
    syllables = ["the ", "and", "tion ", "er", "in", "re ", "on ", "sh", "ea", "st ", "of ", "qu", "jo ", "x", "z ", "k"]
    base = ["".join(rng.choices(syllables, k=rng.randint(90, 220))).strip() for _ in range(n)]
    near = []
    for t in base[:40]:
        t = list(t)
        for _ in range(rng.choice([1, 5, 12, 20])):
            x = rng.randrange(len(t))
            t[x : x + rng.randint(0, 3)] = rng.choices("abe xq", k=rng.randint(0, 3))
        near.append("".join(t))
    return base, near


def test_similar_long_titles_are_greedy(spark):
    base, near = long_titles(60, 2)
    rows = [(i, t, None) for i, t in enumerate(base + near + [t[:180] for t in base] + ["é" + t[3:] for t in base])]
    want = greedy_titles(rows)
    assert sum(k != v for k, v in want.items()) > 20
    got = titles.similar_titles(spark.createDataFrame(rows, "id long, t string, u string"), "id", "t", None, "id")
    assert {r.id: r.leader for r in got.collect()} == want


def test_unlike_long_titles_do_not_meet(spark):
    base, near = long_titles(200, 3)
    kind = lambda t: next(k for k, (size, _) in enumerate(titles.PIECES) if size <= titles._piece(t, 0.92)[2])
    base = [t for t in base if titles._piece(t, 0.92)[2] >= titles.PIECES[-1][0]]
    rows = spark.createDataFrame([(i, t, 7, kind(t)) for i, t in enumerate(base)], "n long, t string, hn long, kind int")
    assert len(base) > 100 and titles._by_pieces(rows, 0.92).count() < len(base)
    tiles = rows.select("kind", "t", F.lit("").alias("numbers"), F.col("n").alias("id"))
    assert titles._tiles(tiles, 0.92).count() == 0


def test_titles_of_equal_pieces_at_far_places_do_not_meet(spark):
    base, near = long_titles(80, 5)
    halves = [t[len(t) // 2 :] + t[: len(t) // 2] for t in base]
    kind = lambda t: next((k for k, (size, _) in enumerate(titles.PIECES) if size <= titles._piece(t, 0.92)[2]), -1)
    rows = spark.createDataFrame([(i, t, 7, kind(t)) for i, t in enumerate(base + halves + near)], "n long, t string, hn long, kind int")
    met = {(r.leader, r.n) for r in titles._by_pieces(rows, 0.92).collect()}
    assert all(a < b for a, b in met) and not any(b == a + len(base) for a, b in met)
    leads = [i for i, t in enumerate(base[:40]) if kind(t) >= 0 and difflib.SequenceMatcher(None, near[i], t).ratio() >= 0.92]
    assert len(leads) > 3 and all((i, 2 * len(base) + i) in met for i in leads)


def test_rare_grams_of_equal_pieces_lie_at_equal_places_in_them():
    rng = np.random.default_rng(1)
    rarity = rng.integers(0, 3, (len(titles.PIECES), titles.BUCKETS)).astype(np.uint64)
    piece = "".join(rng.choice(list("abcd"), 90))
    for k in range(len(titles.PIECES)):
        one, two = ({int(x): (n, a, b) for x, n, a, b in zip(*titles._keys(t, k, rarity))} for t in (piece, "zyx" * 11 + piece))
        # pieces across the joint may have such a gram too
        assert all(two[x][0] >= n and two[x][1] <= a + 33 and b + 33 <= two[x][2] for x, (n, a, b) in one.items())
        assert sum(two[x] == (n, a + 33, b + 33) for x, (n, a, b) in one.items()) >= len(one) - 1
        assert sum(n for n, _, _ in one.values()) == 90 - titles.PIECES[k][0] + 1


def test_keys_that_only_one_leader_looks_for_are_not_wanted(spark):
    base, _ = long_titles(12, 6)
    kind = 0
    base = [t for t in base if titles._piece(t, 0.92)[2] >= titles.PIECES[kind][0]]
    rarity = spark.sparkContext.broadcast(np.zeros((len(titles.PIECES), titles.BUCKETS), np.uint64))
    rows = spark.createDataFrame([(t, 0, kind) for t in base + base[:1]], "t string, hn long, kind int")
    once, twice = titles._leaders_keys(rows, rarity, 0.92)
    for t, want in zip(base[:2], (1, 0)):
        keys, pieces, _, _ = titles._keys(t, kind, rarity.value)
        slots = keys[titles._sought(t, kind, pieces, 0.92)[0]].astype(np.int64) & (8 * len(once) - 1)
        assert len(slots) and (once[slots >> 3] >> (slots & 7) & 1).all()
        assert (twice[slots >> 3] >> (slots & 7) & 1).mean() == pytest.approx(want, abs=0.1)


def test_similarity_is_that_of_difflib():
    base, near = long_titles(40, 7)
    got = []
    for a, b in [*zip(base, near), *zip(near, base), *((t, t[: len(t) * 6 // 7]) for t in base), *((t[:90], t[:100]) for t in near), *((t, t) for t in base)]:
        want = difflib.SequenceMatcher(None, a, b).ratio() >= 0.92
        assert titles._Leader(b, 0.92).similar(a) == want
        got.append(want)
    assert 20 < sum(got) < len(got) - 20


def test_similar_titles_of_no_and_of_repeated_rows(spark):
    none = spark.createDataFrame([], "id long, t string, u string")
    assert titles.similar_titles(none, "id", "t", "u", "id").collect() == []
    rows = [(1, "a title that is long enough for it", "u")] * 3 + [(2, "a title that is long enough for it", None)] * 2
    got = titles.similar_titles(spark.createDataFrame(rows, "id long, t string, u string"), "id", "t", "u", "id")
    assert sorted((r.id, r.leader) for r in got.collect()) == [(1, 1)] * 3 + [(2, 1)] * 2


def test_hashes(spark):
    import hashlib

    df = spark.createDataFrame([(" a ", "f"), (" ", "f"), (None, "f")], "t string, u string")
    got = [r.h for r in df.select(monitor.content_hash(F.col("t"), F.col("u")).alias("h")).collect()]
    assert got == [hashlib.sha256(x).hexdigest() for x in (b"a", b"f", b"f")]


def test_filters(spark):
    df = spark.createDataFrame([(i, T(2024, 1, 1 + i), None if i % 2 else True) for i in range(10)], "id long, ts timestamp, flag boolean")
    assert filters.rolling(df, F.col("ts"), T(2024, 1, 10), 3).count() == 4
    assert [r.id for r in filters.on_day(df, F.col("ts"), dt.date(2024, 1, 4)).collect()] == [3]
    assert [r.id for r in filters.unprocessed(df, "flag", 2, F.col("id")).collect()] == [1, 3]
    assert filters.clamp(0, 1, 20) == 1


def test_hysteresis(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([0, 1, 1, 0, 1])], "k long, i int, bad int")
    assert [r.alert for r in monitor.hysteresis(df, F.col("bad") == 1, "k", F.col("i")).orderBy("i").collect()] == [False, True, False, False, True]


def test_report(spark, tmp_path):
    now = T(2024, 5, 10)
    docs = []
    for i in range(12):
        docs.append({"id": i, "source_name": "rules", "title": f"Order number {i} on support for farms", "url": f"http://a.org/{i}", "collected_at": now, "action_level": "requires_attention", "raw_text": "long text " * 200, "content_hash": f"h{i}", "level": "federal", "deadline_text": f"until {11 + i}.05.2024", "document_type": "html"})
    docs.append(docs[0] | {"id": 50, "url": "http://A.org/0/#x", "content_hash": "other", "npa_number": "7"})  # the same page, with one more fact
    docs.append(docs[1] | {"id": 51, "url": "http://b.org/q", "content_hash": "h1", "deadline_text": None})  # the same text, less known
    docs.append(docs[2] | {"id": 52, "url": "http://c.org/m", "title": "World market: prices", "content_hash": "m"})
    docs.append(docs[2] | {"id": 53, "url": "http://c.org/old", "title": "Something long ago and far away", "content_hash": "o", "collected_at": T(2024, 1, 1)})
    df = spark.createDataFrame([tuple(d.get(f.split()[0]) for f in schema.TABLES["documents"].split(", ")) for d in docs], schema.TABLES["documents"])
    policy = report.Policy(market_markers=("world market",), role_of={"rules": "regional_npa"}, federal_markers=("federal",))
    rows = report.selected(df, now, 7, policy)
    assert sorted(r.id for r in rows.collect()) == [*range(1, 12), 50]
    placed = report.placed(rows, policy).collect()
    by = {}
    for r in placed:
        by.setdefault(r.section, []).append(r)
    assert len(by["requires_attention"]) == 5 and len(by["regional_npa"]) == 5 and by["regional_npa"][0].left_out == 2
    out = report.markdown(report.placed(rows, policy), "Report")
    lines = out.first().value.split("\n")
    assert lines[0] == "# Report" and lines[2] == "## requires_attention" and "… and 2 more" in lines
    report.save_markdown(out, f"{tmp_path}/r")
    assert spark.read.text(f"{tmp_path}/r").count() == len(lines)


def test_schema(spark):
    df = schema.conform(spark.createDataFrame([(1, "x", 3)], "id int, url string, other int"), "documents")
    assert df.columns[0] == "id" and df.schema["id"].dataType.simpleString() == "bigint" and df.first().title is None


def test_latest_file(spark, tmp_path):
    import os

    from docsignal.operators import health

    for i, name in enumerate(("gr_1.md", "gr_3.md", "gr_2.md", "other.txt")):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1_000_000 + i, 1_000_000 + i))
    assert health.latest_file(spark, str(tmp_path), "gr_*.md").endswith("gr_2.md")


def test_enrichments_that_are_shown(spark):
    rows = [
        (("success", None, "v5", 0.5, None, True), True), ((None, "", "v5", None, "high", True), True), (("failed", None, "v5", 0.9, None, True), False), (("success", "boom", "v5", 0.9, None, True), False),
        (("Fallback ", "boom", "v5", 0.9, None, True), True), (("success", None, "v4", 0.9, None, True), False), (("success", None, "v4", 0.9, None, False), True), (("success", None, "", None, "low", True), False),
        (("success", None, None, None, "odd", True), False), (("success", None, None, None, None, False), True), (("success", None, None, 0.49, "high", True), False),
    ]
    df = spark.createDataFrame([r for r, _ in rows], "status string, error string, version string, confidence double, words string, has_facts boolean")
    got = df.select(filters.enrichment_shown(*map(F.col, df.columns), "v5").alias("v")).collect()
    assert [r.v for r in got] == [v for _, v in rows]
    levels = spark.createDataFrame([("watchlist ",), ("background",), (None,)], "l string").select(filters.enrichment_eligible(F.col("l")).alias("v"))
    assert [r.v for r in levels.collect()] == [True, False, False]
