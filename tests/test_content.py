import random

import pytest
from pyspark.sql import functions as F

from docsignal.sources import content


class Node:
    def __init__(self, tag, cls="", ident=None):
        self.tag, self.cls, self.ident, self.children = tag, cls, ident, []

    def html(self):
        names = (f" class='{self.cls}'" if self.cls else "") + (f" id='{self.ident}'" if self.ident else "")
        return f"<{self.tag}{names}>" + "".join(c if isinstance(c, str) else c.html() for c in self.children) + f"</{self.tag}>"


def tree(rng, depth=0):
    n = Node(rng.choice(["div", "p", "article", "section", "nav", "span", "aside"]), rng.choice(["", "", "content", "news x", "menu", "related-posts"]), rng.choice([None, None, "content", "nav"]))
    for _ in range(rng.randint(0, 4)):
        c = tree(rng, depth + 1) if depth < 5 and rng.random() < 0.6 else rng.choice([" word", " поиск по сайту ", " реклама на сайте", "some longer text here ", "поделиться в социальных сетях"])
        if isinstance(c, str) and n.children and isinstance(n.children[-1], str):
            n.children[-1] += c  # text without a tag between is one piece
        else:
            n.children.append(c)
    return n


def brute(root, profile):
    """Over the tree itself: noise is cut away, then every candidate's text is scored."""
    def noisy(n):
        return n.tag in profile.noise_tags or any(k in " ".join(x for x in (n.ident, n.cls) if x).lower() for k in profile.noise_names)

    def walk(n):
        if not noisy(n):
            yield n
            for c in n.children:
                if not isinstance(c, str):
                    yield from walk(c)

    def joined(n):
        return [] if noisy(n) else [t for c in n.children for t in ([c.strip()] if isinstance(c, str) else joined(c)) if t]

    def fits(n, s):
        return s[1:] in n.cls.split() if s[0] == "." else n.ident == s[1:] if s[0] == "#" else n.tag == s

    found = []
    for s in profile.selectors:
        found += [n for n in walk(root) if fits(n, s) and n not in found]
    best, text = None, ""
    for n in found or [root]:
        t = " ".join(" ".join(joined(n)).split())
        points = len(t) - profile.penalty * sum(p in t.lower() for p in profile.phrases)
        if t and (best is None or points > best):
            best, text = points, t
    at = min([text.lower().find(x) for x in profile.tails if x in text.lower()] or [len(text)])
    return text[:at].strip()


@pytest.mark.parametrize("profile", [content.GOVERNMENT, content.MARKET, content.Profile(penalty=10, selectors=("p", ".news"))], ids=["government", "market", "own"])
def test_content_is_that_of_the_tree(spark, profile):
    rng = random.Random(9)
    roots = []
    for _ in range(150):
        r = Node("body")
        r.children = [tree(rng) for _ in range(rng.randint(0, 3))]
        roots.append(r)
    df = spark.createDataFrame([(i, f"http://x/{i}", r.html()) for i, r in enumerate(roots)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in content.placed(df).select("page_id", content.trimmed(content.picked(F.col("elements"), F.col("pieces"), profile), profile.tails).alias("text")).collect()}
    for i, r in enumerate(roots):
        assert got[i] == brute(r, profile), r.html()


def test_kinds_of_pages(spark):
    long = "<article>" + "Правительство утвердило порядок. " * 20 + "</article>"
    rows = [
        (1, "http://government.ru/docs/1/", f"<nav>menu</nav>{long}<div class=content>short</div>"), (2, "http://government.ru/search/?q=1", long), (3, "http://government.ru/news/2/", "<main>Коротко</main>"), (4, "http://government.ru/news/3/", None),
        (5, "http://government.ru/news/4/", "<article>Поиск по сайту. Реклама на сайте.</article>"), (6, None, "<p>open <b>tags &amp; <i>more"), (7, "u", "<article>text<script>no</script></div></p> end</article> after"),
    ]
    got = {r.page_id: r for r in content.content(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].quality for i in range(1, 8)] == ["good", "navigation", "weak", "empty", "navigation", "weak", "weak"]
    assert got[1].text.startswith("Правительство утвердило") and got[2].text == content.GOVERNMENT.service_text and got[2].is_service_page
    assert (got[6].text, got[7].text) == ("open tags & more", "text end")
    assert content.content(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
