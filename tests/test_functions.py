import datetime as dt

import pytest
from pyspark.sql import functions as F

from docsignal.functions import dates, periods, rules, text, urls
from docsignal.sources import html_dates

D = dt.date


def value(spark, expression, **columns):
    names = list(columns)
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} {'string' if not isinstance(columns[n], list) else 'array<int>'}" for n in names))
    return df.select(expression.alias("v")).first().v


@pytest.mark.parametrize(
    ("t", "day"),
    [
        ("2024-02-29", D(2024, 2, 29)), ("on 2023-02-29", None), ("5.3.2024", D(2024, 3, 5)), ("31/12/2023 noon", D(2023, 12, 31)), ("32.1.2024", None),
        ("7 March 2024", D(2024, 3, 7)), ("12 марта 2025 года", D(2025, 3, 12)), ("3 мая 2024", D(2024, 5, 3)), ("1.2.2024 or 2024-05-06", D(2024, 5, 6)),
        ("2024-13-01 and 1.1.2024", None), ("no day", None), (None, None),
    ],
)
def test_parse_date(spark, t, day):
    assert value(spark, dates.parse_date(F.col("t")), t=t) == day


@pytest.mark.parametrize(
    ("t", "day"),
    [
        ("from 1.2.2024 until 15.3.2024 and 1.1.2030", D(2024, 3, 15)), ("1.2.2024 - 20.2.2024", D(2024, 2, 20)), ("orders of 3.3.2023 and 4.4.2024", D(2024, 4, 4)),
        ("до 5 июня 2024, конец обсуждения 9.6.2024", D(2024, 6, 9)), ("until 40.1.2024, seen 2.2.2024", D(2024, 2, 2)), ("", None),
    ],
)
def test_parse_deadline(spark, t, day):
    assert value(spark, dates.parse_deadline(F.col("t")), t=t) == day


def test_deadline_classes(spark):
    c = lambda d: value(spark, dates.deadline_class(F.to_date("d"), F.lit(D(2024, 5, 10))), d=d)
    assert [c(x) for x in ("2024-05-09", "2024-05-10", "2024-05-17", "2024-05-18", None)] == ["expired", "today", "near", "future", "unknown"]


def test_dates_elsewhere(spark):
    assert value(spark, dates.date_from_url(F.col("u")), u="http://x.org/2024/3/7/a") == D(2024, 3, 7)
    assert value(spark, dates.date_from_url(F.col("u")), u="http://x.org/n/12_03_2024?x=1") is None
    assert value(spark, dates.date_from_url(F.col("u")), u="http://x.org/n/2024_03_12.html") == D(2024, 3, 12)
    assert value(spark, dates.from_array(F.col("a")), a=[2024, 2, 3]) == D(2024, 2, 3) and value(spark, dates.from_array(F.col("a")), a=[2024, 2, 31]) is None
    assert value(spark, dates.age(F.to_timestamp("t"), F.lit(dt.datetime(2024, 1, 3))), t="2024-01-02 20:00:00") == "4 h"


def test_text(spark):
    c = F.col("t")
    v = lambda e, t: value(spark, e, t=t)
    assert v(text.squash(c), "  a \n\tb ") == "a b" and v(text.blank(c), "  ") and v(text.blank(c), None)
    assert v(text.key_of(c), "Приказ №5, «О мерах»") == "приказ 5 о мерах"
    assert v(text.clip_words(c, 12), "one two three four") == "one two…" and v(text.clip_words(c, 30), "one two") == "one two"
    assert v(text.clip_sentence(c, 20), "One here. Two there. Three.") == "One here. Two there."
    assert v(text.summary(c, ["апк"]), "Начало. Поддержка АПК растёт. Конец.") == "Поддержка АПК растёт."
    assert v(text.summary(c, ["none"]), "A one. B two. C three.") == "A one. B two."
    assert v(text.distinct_sentences(c), "A one. B two. a ONE. C.") == "A one. B two. C."
    assert v(text.distinct_lines(c, "^menu"), "a\n\nMenu here\n a \nb") == "a\nb"
    assert v(text.matched(c, ["Суб", "xyz", "мер"]), "МЕРЫ субсидий") == ["Суб", "мер"]
    assert v(text.unreadable(c), "#### ---- 1234") and not v(text.unreadable(c), " ".join(f"слово{'абвгдежзик'[i]}" for i in range(10)))
    assert v(text.redacted(c), "token=abc Bearer abcdefghijk") == "token=<hidden> Bearer <token>"
    assert v(text.mostly_upper(c), "ПРИКАЗ о") and v(text.first_with(c, ["b"], 3), "Aa. Xbcd.") == "Xbc"
    assert [v(text.quality_points(c), "x" * n) for n in (0, 100, 1000, 5000)] == [0, 1, 2, 3]
    assert v(text.chunks(c, 5), "ab\ncdefghij\nk") == ["ab\n", "cdefg", "hij\nk"] and "".join(v(text.chunks(c, 7), "line\n" * 30)) == "line\n" * 30


def test_pattern_flags(spark):
    hit = lambda p, t: value(spark, F.col("t").rlike(p), t=t)
    assert hit(text.rx("апк"), "АПК") and not hit("(?i)апк", "АПК")
    assert hit(text.rx(r"^\w+$"), "слово") and hit(text.rx(r"a\sb"), "a b")


def test_urls(spark):
    u = F.col("u")
    v = lambda e, x: value(spark, e, u=x)
    assert v(urls.canonical_key(u), "HTTP://Ab.org/X/?q=1#f") == "http://ab.org/X?q=1" and v(urls.canonical_key(u), "") is None
    twins = r"^https?://g\.org/(?:news|docs)/(\d+)"
    assert v(urls.canonical_key(u, twins), "http://g.org/news/5/") == v(urls.canonical_key(u, twins), "http://g.org/docs/5") == "g.org::5"
    assert [v(urls.document_type(u), f"http://a.b/c{s}") for s in (".PDF", "", ".html?x=.pdf", ".q", "/d.docx#x")] == ["pdf", "html", "html", "unknown", "docx"]
    assert v(urls.host_label(u, F.lit("n")), "https://www.A.org:80/x") == "a.org:80" and v(urls.host_label(u, F.lit("n")), "x") == "n"
    allow = lambda x: v(urls.allowed(u, F.lit("http://a.org/"), ["/docs"], ["/docs/old"]), x)
    assert [allow(x) for x in ("http://a.org/docs/1", "http://b.org/docs/1", "http://b.org/docs/1.pdf", "http://a.org", "http://a.org/docs/old", "http://a.org/x")] == [True, False, True, False, False, False]


def test_rules(spark):
    t = F.col("t")
    order = [rules.Rule("closed", any_of=("not active",)), rules.Rule("open", any_of=("active",), none_of=("draft",)), rules.Rule("grant", all_of=("grant", "farm"), near=("2024",))]
    v = lambda e, x: value(spark, e, t=x)
    assert [v(rules.decide(order, t, "none"), x) for x in ("Not active", "active", "active draft", "farm grant 2024", "farm grant", None)] == ["closed", "open", "none", "grant", "none", "none"]
    assert v(rules.decided_by(order, t), "active") == 2
    families = [rules.Family("a", "A", exact=("beet",), veto=("sugar free",)), rules.Family("b", "B", words=("krs",)), rules.Family("c", "C", rules=(rules.Rule("", all_of=("milk",), any_of=("price", "tax")),))]
    got = [v(rules.topic(families, t), x) for x in ("Beet prices", "sugar free beet", "the KRS, herd", "krsx", "Milk tax and price")]
    assert [g.family for g in got] == ["a", None, "b", None, "c"] and got[4].hits == ["milk", "price", "tax"] and got[4].confidence == 0.8


@pytest.mark.parametrize(
    ("t", "day"),
    [
        ("Опубликовано 5 марта 2024", D(2024, 3, 5)),
        ("5 марта 2024 10:15 Новости", D(2024, 3, 5)),
        ("5 марта 2024 Новости", None),
        ("Опубликовано 5 марта 2024, приём заявок открыт", None),
        ("x " * 130 + "опубликовано 5 марта 2024", None),
        ("", None),
        (None, None),
    ],
)
def test_published_from_text(spark, t, day):
    assert value(spark, dates.published_from_text(F.col("t")), t=t) == day
    if t is not None:
        assert html_dates.from_text(t) == day
        assert value(spark, dates.published_from_text(F.col("t"), news=F.lit(True)), t=t) == (D(2024, 3, 5) if "5 марта 2024 Новости" in t else day)


def test_texts_of_pages(spark):
    assert value(spark, text.service_url(F.col("u")), u="http://x.org/search?q=1") and not value(spark, text.service_url(F.col("u")), u="http://x.org/docs/5")
    nav = lambda t: value(spark, text.navigation_text(F.col("t")), t=t)
    assert nav("service_page x") and nav("Поиск по сайту и Реклама на сайте") and not nav("Поиск по сайту") and not nav(None)
    one, two = (value(spark, text.fields_hash(title=F.col("t"), url=F.lit(None).cast("string")), t=t) for t in ("a", "b"))
    assert one != two and one == value(spark, text.fields_hash(url=F.lit(None).cast("string"), title=F.col("t")), t="a")


def test_fields_hash_is_that_of_plain_json(spark):
    import hashlib
    import json

    for t in ("a", 'q"uo\\te / é\n\t', "", None):
        df = spark.createDataFrame([(t, 5, True, None)], "title string, n int, b boolean, url string")
        want = hashlib.sha256(json.dumps({"title": t, "n": 5, "b": True, "url": None}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
        assert df.select(text.fields_hash(**{c: F.col(c) for c in df.columns}).alias("h")).first().h == want


def test_periods():
    assert periods.period("today", D(2024, 3, 5)).label() == "сегодня, 05.03.2024" and periods.period("1", D(2024, 3, 5)).label() == "сегодня, 05.03.2024"
    assert periods.period("9999", D(2024, 3, 5)).days == 365 and periods.period(None, D(2024, 3, 5), 14).label() == "последние 14 дней"


@pytest.mark.parametrize(
    ("title", "core"),
    [
        ("№ 5 от 1.2.2024 Об утверждении правил В  СООТВЕТСТВИИ со статьей 3 на основании закона", "правил"),
        ("Порядок\nвыплаты постановляю: дело\nнастоящим", "Порядок выплаты"),
        ("на основании закона", ""), ("настоящимение статьях", "настоящимение статьях"),
        ("«Порядок субсидий» и «порядок\nиных субсидий, приказываю» конец", "порядок иных субсидий"), (None, None),
    ],
)
def test_order_core_ends_at_the_first_phrase(spark, title, core):
    assert value(spark, text.order_core(F.col("t")), t=title) == core


def test_order_core_works_its_text_out_a_few_times(spark):
    df = spark.createDataFrame([("a",)], "t string").select(text.order_core(F.col("t")))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("translate(t") <= 8
