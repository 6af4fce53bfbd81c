"""Operators 5, 9 and 10 and the pipeline against plain Python."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docsignal.llm import main_text, pii, url_rules
from docsignal.llm.html_labelled import PAGES

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the contract, as they stand.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for o, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), o, m.end()))
    return sorted(out)


def shown(spans):
    return ",".join(f"{KINDS[o]}:{s}:{e}" for s, o, e in spans)


def test_base_spans(spark, documents, odd_rows):
    rng = random.Random(5)
    pieces = ["a.b+c@d-e.fr.com", "x@y", "x@y.com_z@q.org", "1.2.3.4.5", "999.1.1.1", "0001.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (434) 555-2368", "+12", "+49 (0) 30.123456-7 8", "\U0001f600", "é", "@", ".", "7", " ", "\n", "--", "%_x@a-.b", "4539578763621486 4539578763621486"]
    rows = [*odd_rows, *((100 + i, "".join(rng.choice(pieces) + rng.choice(["", " ", ","]) for _ in range(rng.randint(1, 30)))) for i in range(300))]
    rows.append((999, " ".join(f"u{i}@h{i}.org" for i in range(1500))))  # more matches than a chunk of offsets
    got = pii.spans(documents(rows)).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], *(sum(o == k for _, o, _ in brute_spans(r[1])) for k in range(4)), shown(brute_spans(r[1]))) for r in rows)
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base) for r in got) == want
    for r in got:
        every = {f"{s.kind}:{s.start}:{s.end}" for s in r.all_spans}
        assert set(filter(None, r.base.split(","))) <= every
    assert pii.spans(documents([])).count() == 0


def test_added_spans_and_redaction(spark, documents):
    rows = [(i, f"write a mail to ann{i} [at] example [dot] com or call (434) 555-23{i % 90 + 10} at noon") for i in range(30)]
    rows += [(100 + i, f"mail bob{i}@example.org now, phone +1 434 555 23{i % 90 + 10}") for i in range(60)]
    rows += [(300, "no personal data, number 2390409500648960 here"), (301, None)]
    got = {r.doc_id: r for r in pii.spans(documents(rows)).collect()}
    assert sum(any(s.added and s.kind == "email" for s in got[i].all_spans) for i in range(30)) == 30
    assert not got[300].all_spans
    df = documents(rows)
    done = pii.redact(df)
    assert done.columns == df.columns and done.filter("base <> 'base'").count() == 0
    by = {r.doc_id: r for r in done.collect()}
    assert by[100].text == "mail <EMAIL> now, phone <PHONE>" and by[100].n_chars == len(by[100].text)
    assert by[300].text == rows[-2][1] and by[301].text is None


def test_labelled_pages_come_out():
    w = main_text.weights(main_text.labelled_counts())
    for page, content in PAGES:
        want = " ".join(x for x in map(main_text.words_of, main_text.blocks(page)) if x in content)
        assert main_text.extract(page, w) == want


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<article><p>a &amp; b<br>c <b>d</b>e\n f &#233;</p></article>", "a & b c de f é"),
        ("<nav><ul><li><a href=/>Home</a><article><p>Alpha beta.</p><div class=ad>Buy now</div><p>x</p></article>", "Alpha beta. x"),
        ("<div class='topnav'>Go here or there</div><article><p>Six words are in this text.</p></article><div>Made by nobody</div>", "Six words are in this text."),
        ("<article><h1>T</h1><p>Text.</p><section id='comments'><p>a reader says hello</p></section></article>", "T Text."),
        ("<main><p>Alpha beta gamma.</p></main><section class='comment-list'><article class='comment'><p>Me too.</p></article></section>", "Alpha beta gamma."),
        ("<div class='post-author-content'><p>The real body is here, in some words.</p></div><div class='x9'><p>Buy now cheap</p></div>", "The real body is here, in some words."),
        ("<div class='post-content'><p>The real body is here, in some words.</p><div class='author-box'><p>Ann writes for us</p></div><div class='comment-content'>Me too</div></div>", "The real body is here, in some words."),
        ("<article><p>whole <!-- gone --> text<script>var a = '<p>no</p>';</script></p><style>p{}</style><p>ends &am", "whole text ends &am"),
        ("<html><body><div class='menu'><a href=x>Home</a></div><div class='article-body'><p>First one here, long enough to count as text.</p><form><label>Mail</label></form><p>Second <a href=z>linked</a> one.</p></div><div class='cookie-banner'>We use cookies</div>", "First one here, long enough to count as text. Second linked one."),
    ],
)
def test_main_text_of(page, text):
    assert main_text.extract(page, main_text.weights(main_text.labelled_counts())) == text


def test_best_region_is_the_maximum():
    rng = random.Random(9)
    for _ in range(300):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        a, b = main_text.best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


def test_main_text_table(spark):
    rows = [(1, "u", "<article><p>one two</p></article>", "x"), (1, "u", "<article><p>one two</p></article>", "x"), (2, None, None, None), (None, "v", "<p>" + "long " * 50_000 + "</p>", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or -1, r.url or "", r.n_chars) for r in main_text.main_text(df).collect())
    assert got == [(-1, "v", 249_999), (1, "u", 7), (1, "u", 7), (2, "", 0)]
    assert main_text.main_text(df.limit(0)).count() == 0


def brute_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(url_rules.UPPER, url_rules.LOWER)), m[2]) if m else ("", "")
    fits = [(h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None)))


def test_url_rules(spark):
    rng = random.Random(10)
    hosts = ["Example.com", "www.example.com", "a.www.example.com", "net", "x.net", "xnet", "shop.org", "casino-win.org", "casino.x.org", "com", "é.com"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/es/1', '/fr/2?x=/en/', '#/es/', '?a=1&b=2'])}" for _ in range(400)] + [None, "", "no scheme", "://", "a://b://c/en/", "http://casino-win.org/en/1\nx"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in url_rules.url_rules(df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict in ("allow", "block")
        assert verdict is None or got[i].verdict == verdict
    assert url_rules.url_rules(df.limit(0)).count() == 0


def brute_mine(rows, support, confidence, least, plain=(), deviations=3.0):
    """All combinations of each labelled row's tokens, counted; a token that settles a verdict by itself is in no other rule."""
    rows = [(set(t), v) for t, v in rows if v]
    counts, total = Counter(), len(rows)
    for tokens, verdict in rows:
        for size in range(1, len(tokens) + 1):
            for c in itertools.combinations(sorted(tokens), size):
                counts[c, None] += 1
                counts[c, verdict] += 1
    least, found = max(least, math.ceil(support * total)), []
    settled = {c[0] for (c, v), n in counts.items() if len(c) == 1 and v and n == counts[c, None] and n >= least and c[0] not in plain}
    for c, v in sorted((k for k, n in counts.items() if k[1] and n), key=lambda k: (len(k[0]), k)):
        n, any_, share = counts[c, v], counts[c, None], sum(x == v for _, x in rows) / total
        if set(c) <= set(plain) or len(c) > 1 and settled & set(c):
            continue
        if n >= least and n >= confidence * any_ and n / any_ > share + deviations * math.sqrt(share * (1 - share) / any_):
            if not any(w == v and p >= n / any_ and set(d) <= set(c) for d, w, p in found):
                found.append((c, v, n / any_))
    return found


@pytest.mark.parametrize("plain", [(), ("a", "d")])
def test_mined_rules_are_those_of_enumeration(spark, plain):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        t = [x for x in "abcdefgh" if rng.random() < 0.4]
        block = ("a" in t and "b" in t and "c" not in t) or rng.random() < 0.05
        rows.append((t, rng.choice(["block"] * 9 + [None]) if block else rng.choice(["allow", "allow", None])))
    rows += [(["i", "b"], "block")] * 30 + [(["j", "a"], "allow")] * 25
    want = brute_mine(rows, 0.02, 0.7, 10, plain)
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.7, least=10, plain=plain)
    assert {(tuple(r["tokens"]), r["verdict"], round(r["confidence"], 9)) for r in got} == {(c, v, round(p, 9)) for c, v, p in want} and len(want) > 2


def test_tokens_of_the_same_urls_are_one(spark):
    rows = [(["x", "y", "z"], "block")] * 30 + [(["x", "y"], "allow")] * 5 + [(["o"], "allow")] * 60
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.01, 0.8, least=10, plain=("x",))
    assert sorted((r["tokens"], r["verdict"]) for r in got) == [(["o"], "allow"), (["z"], "block")]


def test_urls_without_a_fixed_rule_follow_mined_ones(spark):
    """Subdomains that the fixed rules block and allow elsewhere; a part of a fixed rule alone blocks nothing."""
    rng = random.Random(12)
    urls = [f"http://{rng.choice(['blog', 'www', 'm'])}.example.com/{rng.choice(['en', 'de'])}/{i}" for i in range(600)] + [f"http://a{i % 40}.example.net/fr/{i}" for i in range(100)]
    asked = {"http://blog.other.org/en/1": "block", "http://www.other.org/en/1": "allow", "http://blog.other.org/de/1": "allow", "http://q.other.net/en/1": "allow", "http://x.org/": "allow"}
    df = spark.createDataFrame(list(enumerate([*urls, *asked])), "page_id long, url string")
    got = {r.page_id: r for r in url_rules.url_rules(df).collect()}
    for i, (u, v) in enumerate(asked.items(), len(urls)):
        assert (got[i].rule, got[i].verdict) == (None, v), (u, got[i])
    assert got[len(urls)].mined == "p:en s:blog" and got[len(urls) + 4].mined is None
    told = url_rules.held_out(df).collect()
    assert sum(r.n for r in told if r.mined == r.verdict) >= 0.9 * sum(r.n for r in told if r.mined)


def test_long_shared_paths_are_mined(spark):
    """Sixteen and thirty segments that all urls of a site share."""
    for k in (16, 30):
        path = "/".join(f"seg{'abcdefghijklmnopqrstuvwxyzABCDEFG'[i]}" for i in range(k))
        urls = [(i, f"http://s{chr(97 + i % 26)}.org/{path}/{'x' if i % 3 else 'y'}") for i in range(300)]
        labels = spark.createDataFrame([(u, "block" if u.endswith("x") else "allow") for _, u in urls], "url string, verdict string")
        got = url_rules.url_rules(spark.createDataFrame(urls, "page_id long, url string"), labels=labels, confidence=0.45).collect()
        assert len(got) == 300


def test_held_out_labels_are_met(spark):
    rng = random.Random(11)
    urls = []
    for i in range(3000):
        bad = rng.random() < 0.3
        site = rng.choice(["win-casino", "casino-bet", "pills-now"] if bad else ["news", "garden", "town-hall", "win-cup"])
        urls.append((i, f"https://{site}.org/{rng.choice(['a', 'b', 'de'])}/{i}?ref=x", "block" if bad else "allow"))
    held = [u for u in urls if u[0] % 5 == 0]
    labels = spark.createDataFrame([u[1:] for u in urls if u[0] % 5], "url string, verdict string")
    got = {r.page_id: r.verdict for r in url_rules.url_rules(spark.createDataFrame([u[:2] for u in held], "page_id long, url string"), labels=labels).collect()}
    assert all(got[i] == v for i, _, v in held)


def test_ties_of_mined_rules_go_to_block(spark):
    rules = [{"tokens": ["a"], "verdict": v, "confidence": 0.9, "support": 0.1} for v in ("allow", "block")] + [{"tokens": ["b", "c"], "verdict": "allow", "confidence": 0.95, "support": 0.1}]
    df = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "c"],), (["z"],), ([],)], "tokens array<string>")
    assert [r[0] for r in df.select(url_rules.judged(rules)["verdict"]).collect()] == ["block", "block", "allow", None, None]


def test_thousands_of_spans(spark, documents):
    """Spans of several kinds, in and beyond a chunk, touching and apart, in one text."""
    rng = random.Random(6)
    pieces = ["030-123-4567", "(434) 555-2368", "+1 434 555 2368", "4539578763621486", "4539.5787.6362.1486", "a@b.org", "a [at] b [dot] com", "10.0.0.1", "10[.]0[.]0[.]1", "\U0001f600 word", "x"]
    text = "".join(rng.choice(pieces) + rng.choice([" ", " ", ",", "\n", ""]) for _ in range(1500))
    df = documents([(1, text), (2, text[:900])])
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    done = {r.doc_id: r.text for r in pii.redact(df).collect()}
    for i, t in ((1, text), (2, text[:900])):
        assert got[i].base == shown(brute_spans(t))
        spans, at, out = got[i].all_spans, 0, ""
        base = [s for s in spans if not s.added]
        added = [s for s in spans if s.added]
        assert spans == sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))
        assert not any(a.start < b.end and b.start < a.end for a in added for b in base) and all(a.end <= b.start for a, b in itertools.pairwise(added))
        for s in spans:
            if s.start >= at:
                out += t[at : s.start] + f"<{s.kind.upper()}>"
            at = max(at, s.end)
        assert done[i] == out + t[at:]
    assert len(got[1].all_spans) > 600


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    plain = [f"word{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(80)]
        y = i % 5 == 0
        for _ in range(4 if y else 0):
            words[rng.randrange(80)] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(words) + (f" me{i}@example.org" if i % 7 == 0 else ""), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(y)))
    rows += [(1000 + i, r[1], "en", "s9", 0) for i, r in enumerate(rows[1:4])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "pii", "mixing", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        stages.append(docs)
    ids = [Counter(r.doc_id for r in d.select("doc_id").collect()) for d in stages]
    assert all(d.columns == list(corpus_pipeline.COLUMNS) for d in stages[:-1])
    assert set(ids[0]) == {r[0] for r in rows if "vile" not in r[1] and "nasty" not in r[1]}
    assert set(ids[1]) == {i for i in ids[0] if i < 1000}
    assert ids[2] == ids[1] and not stages[2].filter(F.contains("text", F.lit("@"))).count()
    assert max(ids[3].values()) <= 2 and ids[4] == ids[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == stages[-1].count()


def test_url_rules_read_whole_urls(spark):
    labels = [(f"http://h{i}.org/a/b/c/d/{'bad' if i % 2 else 'good'}", "block" if i % 2 else "allow") for i in range(100)]
    labels += [(f"http://a.b.{'dark' if i % 2 else 'light-side'}.h{i}.org/", "block" if i % 2 else "allow") for i in range(100)]
    pages = [(1, "http://x.org/e/f/g/h/bad"), (2, "http://x.org/e/f/g/h/good"), (3, "http://p.q.dark.x.org/"), (4, "http://p.q.light-side.x.org/")]
    labels = spark.createDataFrame(labels, "url string, verdict string")
    got = url_rules.url_rules(spark.createDataFrame(pages, "page_id long, url string"), labels=labels).collect()
    assert {r.page_id: (r.verdict, r.mined) for r in got} == {1: ("block", "p:bad"), 2: ("allow", "p:good"), 3: ("block", "s:dark"), 4: ("allow", "s:light-side")}
