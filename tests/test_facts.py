import datetime as dt

import pytest
from pyspark.sql import functions as F

from docsignal.functions import dates, facts, shape
from docsignal.sources import html_dates

D = dt.date


@pytest.mark.parametrize(
    ("html", "url", "day"),
    [
        ('<meta property="article:published_time" content="2024-03-05T10:00"><p>1.1.2020', None, D(2024, 3, 5)),
        ('<time datetime="2024-03-06">x</time>', None, D(2024, 3, 6)),
        ('<div class="post-date">7 March 2024</div><p>1.1.2020', None, D(2024, 3, 7)),
        ("<p>News of 8.3.2024</p>", None, None),
        ("<p>8.3.2024 10:30 News</p>", None, D(2024, 3, 8)),
        ("<p>Опубликовано 8 марта 2024</p>", None, D(2024, 3, 8)),
        ("<p>Опубликовано 8 марта 2024, срок подачи 9.3.2024</p>", None, None),
        ("<p>" + "x" * 200 + " 8.3.2024", "http://a.org/2024/03/09/x", D(2024, 3, 9)),
        ("<script>2024-01-01</script>", "http://a.org/x", None),
        (None, None, None),
        ("<time>31.2.2024</time>", "http://a.org/2024_02_01", D(2024, 2, 1)),
    ],
)
def test_published_at(html, url, day):
    assert html_dates.published_at(html, url) == day


def test_link_dates():
    html = "<ul><li>1.2.2024 <a href=a>A</a><li><a href=b>B of 3.2.2024</a><li>order of 4.2.2024 <a href=/2024/5/6/c>C</a></ul><a href=d>D</a>"
    assert html_dates.link_dates(html) == [("a", D(2024, 2, 1)), ("b", D(2024, 2, 3)), ("/2024/5/6/c", D(2024, 5, 6)), ("d", None)]


def test_dated_table(spark):
    df = spark.createDataFrame([(1, "http://a.org/2024/3/9/", "<p>x"), (2, None, None)], "page_id long, url string, html string")
    assert {r.page_id: r.published_on for r in html_dates.dated(df).collect()} == {1: D(2024, 3, 9), 2: None}


def value(spark, expression, t):
    return spark.createDataFrame([(t,)], "t string").select(expression.alias("v")).first().v


SENTENCES = [
    ("Приказ от 1.1.2020. Приём заявок до 15.03.2024 включительно. Иное.", "Приём заявок до 15.03.2024 включительно"),
    ("Срок подачи с 1.3.2024 по 20.3.2024. Прием заявок до 5.3.2024.", "Прием заявок до 5.3.2024"),
    ("Заявки принимаются. До 7 марта 2024 года в отделе.", "Заявки принимаются. До 7 марта 2024 года в отделе"),
    ("Прием заявок. Срок кредита до 1.1.2030.", None),
    ("Срок подачи заявок до 31.2.2024, прием документов по 4.4.2024", "Срок подачи заявок до 31.2.2024, прием документов по 4.4.2024"),
    ("Конец обсуждения: 2024-05-06.", "Конец обсуждения: 2024-05-06"),
    ("Публичное обсуждение программы до 2030 года, до 3.3.2024.", "Публичное обсуждение программы до 2030 года, до 3.3.2024"),
    ("До 1.1.2024 было рано. Итоги.", None),
    ("Подача заявок до 1.4.2024. Подача заявок до 2.4.2024.", "Подача заявок до 1.4.2024"),
    ("Идет прием заявок " + "в районах края " * 20 + "до 1.4.2024", ("прием заявок " + "в районах края " * 20)[:177].rstrip(" ,.;:-") + "..."),
    ("", None), (None, None),
]


@pytest.mark.parametrize(("t", "want"), SENTENCES)
def test_deadline_sentences(spark, t, want):
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(facts.deadline_sentence(F.col("t")).alias("v")).first().v == want


def test_facts(spark):
    t = "Приказ от 1.1.2020. Приём заявок до 15.03.2024 включительно. Ставка: 5 процентов. Мера активная. НПА 12-п."
    f = value(spark, facts.facts(F.col("t"), F.lit(D(2024, 3, 1))), t)
    assert (f.deadline_text, f.application_status, f.support_status, f.is_active) == ("Приём заявок до 15.03.2024 включительно", "open", "active", True)
    assert (f.npa_number, f.terms_text, f.risk_notes, f.is_continuous) == ("НПА 12-п", "Ставка: 5 процентов.", None, None)
    late = value(spark, facts.facts(F.col("t"), F.lit(D(2024, 4, 1))), t)
    assert (late.application_status, late.risk_notes) == ("closed", facts.RISKS[2][2])
    status = lambda t: value(spark, facts.facts(F.col("t"), F.lit(D(2024, 4, 1))), t)
    assert status("Мера не активная, была активная").support_status == "inactive" and status("Мера не активная").risk_notes == facts.RISKS[1][2]
    assert status("Прием завершен. Прием заявок до 1.5.2024.").application_status == "closed"
    assert status("Выдается на регулярной основе").application_status == "regular" and status("Заявки принимаются").application_status == "open"
    assert status("").application_status == "unknown" and status("").risk_notes == facts.RISKS[4][2]


@pytest.mark.parametrize(
    ("title", "text", "source", "url", "day"),
    [
        (None, "Опубликовано 8.3.2024", "Сайт", "http://x.org/2024/1/2/", D(2024, 3, 8)),
        ("Размещено 9.3.2024", "текст", "Сайт", "http://x.org/2024/1/2/", D(2024, 3, 9)),
        (None, "Опубликовано 8.3.2024, срок подачи 1.4.2024", "Сайт", "http://x.org/2024/1/2/", D(2024, 1, 2)),
        (None, "8.3.2024 новости дня", "zol.ru", "http://zol.ru/1", D(2024, 3, 8)),
        (None, "8.3.2024 новости дня", "Сайт", "http://x.org/1", None),
        (None, "Меню Работа 7 марта 2024 12:30 Новости", "Правительство РФ", "http://government.ru/news/12/", D(2024, 3, 7)),
        (None, "Меню Работа 7 марта 2024 12:30 Новости", "Правительство РФ", "http://government.ru/search/", None),
        (None, "Опубликовано 8.3.2024", "Правительство РФ", "http://government.ru/docs/1?page=2", None),
        (None, "П Р И К А З № 5-п от 3.2.2024 О мерах", "Край", "https://admkrai.krasnodar.ru/1", D(2024, 2, 3)),
        (None, "приказ от 3.2.2024. Дата опубликования: 5 февраля 2024", "Край", "https://admkrai.krasnodar.ru/1", D(2024, 2, 5)),
        (None, "requires OCR extraction приказ от 3.2.2024", "Край", "https://admkrai.krasnodar.ru/1", None),
        (None, None, None, None, None),
    ],
)
def test_inferred_publication(spark, title, text, source, url, day):
    df = spark.createDataFrame([(title, text, source, url)], "title string, text string, source string, url string")
    assert df.select(dates.infer_published(*map(F.col, df.columns)).alias("d")).first().d == day


def test_text_choices(spark):
    t = F.col("t")
    assert value(spark, facts.merged(t, F.lit("One two. Three.")), "One two.") == "One two. Three."
    assert value(spark, facts.merged(t, F.lit("Four. One two.")), "One two. Three.") == "One two. Three. Four."
    assert value(spark, facts.title_of(t, F.lit("short\nA long enough first line here"), ["news"]), " News ") == "A long enough first line here"
    assert value(spark, facts.quotes(t, ["grant"]), "A grant one. No. a GRANT one. Grant two. Grant 3. Grant 4.") == ["A grant one.", "Grant two.", "Grant 3."]
    assert value(spark, facts.chosen(F.lit("??? --- !!! ... ### $$$"), t), "A text that is fit to show.") == "A text that is fit to show."
    s = F.struct(t.alias("status"), F.lit("x" * 50).alias("summary"))
    assert value(spark, facts.hardened(s, {"status": (("open", "closed"), "unknown")}), "odd").status == "unknown"
    assert value(spark, facts.weak_reason(s, "summary"), "a") is None


def test_similar_texts_merge(spark):
    rows = [("One  two", "one two"), ("one", "ONE two"), ("one two", "One"), ("support for dairy farms", "support of dairy farms!"), ("farms", "grain export"), (None, " x "), ("x", ""), (None, None)]
    got = [r.m for r in spark.createDataFrame(rows, "a string, b string").select(facts.merged_similar(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == ["One two", "ONE two", "one two", "support for dairy farms", "farms grain export", "x", "x", ""]


def test_debris_of_recognition(spark):
    t = F.col("t")
    heading = "ПРАВИТЕЛЬСТВО КРАСНОДАРСКОГО КРАЯ ПОСТАНОВЛЕНИЕ"
    assert value(spark, shape.stamped_heading(t), heading) and not value(spark, shape.stamped_heading(t), heading.lower())
    assert not value(spark, shape.stamped_heading(t), None) and not value(spark, shape.stamped_heading(t), "ВАЖНЫЕ НОВОСТИ СЕГОДНЯ ДЛЯ ВСЕХ")
    assert value(spark, shape.debris(t), heading + " ©") and not value(spark, shape.debris(t), heading)
    assert value(spark, shape.debris(t), "text cid: 12") and not value(spark, shape.debris(t), "")
    assert value(spark, shape.debris(t), "а бв г де ж зи к лм н оп р") and not value(spark, shape.debris(t), "обычный текст о порядке выдачи")
    assert value(spark, shape.joined_capitals(t), "край П О С Т А Н О В Л Е Н И Е от и П Р И К А З.") == "край ПОСТАНОВЛЕНИЕ от и ПРИКАЗ."
    assert value(spark, shape.joined_capitals(t), "А Б В нет") == "А Б В нет" and value(spark, shape.joined_capitals(t), None) is None
    assert value(spark, shape.without_debris(t), "4ОТО ZB G4QX 2-78, Субсидия выдана") == "Субсидия выдана"
    assert value(spark, shape.without_debris(t), "АПК: субсидия выдана") == "АПК: субсидия выдана"
    assert value(spark, shape.without_debris(t), "ПРИКАЗ № 5 О мерах") == "О мерах"
    assert value(spark, shape.without_debris(t), None) is None


def test_facts_lower_texts_a_few_times(spark):
    df = spark.createDataFrame([("a",)], "t string").select(facts.facts(F.col("t"), F.lit(D(2024, 3, 1))))
    # the rest are of single sentences and what was found in them
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 24


def test_facts_mark_by_any_first_letter(spark):
    marks = (*facts.MARKS.deadline, *facts.MARKS.open, "[x", "-y", "^z", "]")
    df = spark.createDataFrame([(m, f"a {m} b") for m in marks] + [(None, None), ("", "прием заяв]ок"[:9])], "m string, t string")
    assert [r.v for r in df.select(facts.said(F.col("t"), marks).alias("v")).collect()] == [True] * len(marks) + [False, False]
