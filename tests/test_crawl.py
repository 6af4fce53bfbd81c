import random

from pyspark.sql import functions as F

from docsignal.functions import urls
from docsignal.sources import crawl


def key(u):
    return u.split("#")[0].rstrip("/")


def host(u):
    return u.split("/")[2]


def brute(seeds, pages, rounds, per_host, failures):
    """The same rounds by loops: seen addresses, budgets and errors by host."""
    frontier, seen, spent, errors, visits, items = sorted({key(u) for u in seeds}), set(), {}, {}, [], {}
    for n in range(rounds):
        todo = [k for k in frontier if k not in seen and errors.get(host(k), 0) < failures]
        got, took = [], {}
        for k in sorted(todo):
            if spent.get(host(k), 0) + took.get(host(k), 0) < per_host:
                took[host(k)] = took.get(host(k), 0) + 1
                got.append(k)
        if not got:
            break
        found = []
        for h in took:
            spent[h] = spent.get(h, 0) + took[h]
            statuses = [pages.get(k, (404, None))[0] for k in got if host(k) == h]
            errors[h] = (0 if any(s < 500 for s in statuses) else errors.get(h, 0) + len(statuses))
        for k in got:
            status, links = pages.get(k, (404, None))
            visits.append((k, n, status))
            seen.add(k)
            if status < 400 and links:
                found += [(k, i, link) for i, link in enumerate(links)]
        for base, i, link in sorted(found):
            if link.endswith(".pdf"):
                items.setdefault(key(link), (key(link), n, base))
        frontier = sorted({key(link) for _, _, link in found if not link.endswith(".pdf")})
    return sorted(visits), sorted(items.values())


def test_crawl_is_that_of_loops(spark):
    rng = random.Random(6)
    names = [f"http://h{h}.org/p{i}" for h in range(5) for i in range(25)]
    pages = {}
    for u in names:
        links = [rng.choice(names) + rng.choice(["", "", "/", "#x"]) for _ in range(rng.randint(0, 4))] + [f"http://h{rng.randint(0, 4)}.org/f{rng.randint(0, 30)}.pdf" for _ in range(rng.randint(0, 2))]
        rng.shuffle(links)
        pages[u] = (503 if "h3" in u else rng.choice([200, 200, 200, 500, 404]), links)
    rows = [(u, s, "".join(f"<a href='{x}'>title {i}</a>" for i, x in enumerate(links))) for u, (s, links) in pages.items()]
    df = spark.createDataFrame(rows, "url string, status int, html string")
    seeds = ["http://h0.org/p0", "http://h0.org/p0/", "http://h1.org/p1", "http://h3.org/p2", "http://h2.org/none"]
    pdf = crawl.attachment(("pdf",))
    for rounds, per_host, failures in ((4, 100, 3), (6, 6, 2), (1, 5, 5)):
        visits, items = crawl.crawl(spark.createDataFrame([(u,) for u in seeds] + [(None,)], "url string"), crawl.from_table(df), lambda u, t, b: ~urls.document_type(u).isin("pdf"), pdf, rounds, per_host, failures)
        want_visits, want_items = brute(seeds, pages, rounds, per_host, failures)
        assert sorted((r.key, r.round, r.status) for r in visits.collect()) == want_visits
        assert sorted((r.key, r.round, key(r.base)) for r in items.collect()) == want_items
        assert {r.document_type for r in items.select("document_type").distinct().collect()} <= {"pdf"}


def test_listings_are_followed_and_files_harvested(spark):
    rows = [
        ("http://a.org/list", "<a href='/list?page=2'>2</a><a href='f1.pdf'>One</a><a href='/other'>x</a><a href='http://b.org/f9.doc'>Nine</a>"), ("http://a.org/list?page=2", "<a href='/list?page=3'>3</a><a href='f1.pdf'>One again</a><a href='f2.DOCX'>Two</a>"),
        ("http://a.org/list?page=3", None), ("http://a.org/other", "<a href='f7.pdf'>Seven</a>"),
    ]
    visits, items = crawl.crawl(spark.createDataFrame([("http://a.org/list",)], "url string"), crawl.from_table(spark.createDataFrame(rows, "url string, html string")), crawl.next_page, crawl.attachment())
    assert sorted((r.url, r.round) for r in visits.collect()) == [("http://a.org/list", 0), ("http://a.org/list?page=2", 1), ("http://a.org/list?page=3", 2)]
    assert sorted((r.url, r.title, r.round) for r in items.collect()) == [("http://a.org/f1.pdf", "One", 0), ("http://a.org/f2.DOCX", "Two", 1), ("http://b.org/f9.doc", "Nine", 0)]


def test_crawl_of_nothing(spark):
    visits, items = crawl.crawl(spark.createDataFrame([(None,)], "url string"), crawl.from_table(spark.createDataFrame([], "url string, html string")), crawl.next_page, crawl.attachment())
    assert visits.count() == 0 and items.count() == 0 and "document_type" in items.columns and F
