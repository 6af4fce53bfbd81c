import datetime as dt

import pytest
from pyspark.sql import functions as F

from docsignal.rules import analysis, levels, priority, visibility

COLUMNS = ", ".join(f"{c} {t}" for c, t in visibility.INPUTS.items())


def doc(**given):
    base = {"title": "О зерне", "source_name": "Вестник", "url": "http://x.example/1", "action_level": "watchlist", "page_type": "new_rule", "applicability": "ok", "region": "federal", "application_status": "unknown", "support_status": "unknown"}
    values = base | given
    return tuple(values.get(c) for c in visibility.INPUTS)


@pytest.mark.parametrize("decision", [visibility.GEO_SCOPE, visibility.BUCKET, visibility.SECTION], ids=lambda d: d.name)
def test_every_branch_decides_something(decision):
    assert decision.unreached(20_000) == set()


CASES = [
    (doc(), "watchlist", None, None, "federal_rf", "industry_background", (True, True, True)),
    (doc(action_level="requires_attention"), "requires_attention", None, None, "federal_rf", "requires_attention", (True, True, True)),
    (doc(title="О зерне в Ростове", region=None), "watchlist", None, None, "target_region", "target_watchlist", (True, True, True)),
    (doc(title="Экспорт в Казахстан"), "watchlist", None, None, "global_market", "market_background", (False, False, False)),
    (doc(action_level="requires_attention", region=None), "requires_attention", None, None, "non_target_rf", "non_target_background", (False, False, False)),
    (doc(source_role="strategy", title="О школах"), "background", None, "sector", "federal_rf", "industry_background", (False, False, False)),
    (doc(source_role="strategy", title="О школах", is_placeholder=True, action_level="requires_attention"), "watchlist", None, "placeholder", "federal_rf", "industry_background", (False, False, False)),
    (doc(title="Признание утратившим силу приказа о микропереписи"), "background", None, "statistics", "federal_rf", "industry_background", (True, False, False)),
    (doc(title="Цифровая селекция", source_role="news_signals"), "background", None, "digital", "federal_rf", "industry_background", (True, False, False)),
    (doc(reason="Регион вне фокуса AHSTEP", region=None), "background", None, "reference", "non_target_rf", "non_target_background", (True, False, False)),
    (doc(applicability="background"), "background", None, "applicability", "non_target_rf", "non_target_background", (True, False, False)),
    (doc(title="Состоится форум", source_role="news_signals", page_type="news_background"), "background", "event", None, "federal_rf", "industry_background", (True, False, False)),
    (doc(page_type="registry"), "watchlist", None, None, "federal_rf", "industry_background", (False, True, False)),
    (doc(title="Памятка о зерне", page_type="reference_page"), "watchlist", None, None, "federal_rf", "support_reference", (True, False, True)),
    (doc(title="Форма о коррупции", page_type="reference_page"), "watchlist", None, None, "federal_rf", "industry_background", (False, False, False)),
    (doc(support_status="inactive"), "watchlist", None, None, "federal_rf", "industry_background", (True, False, True)),
    (doc(action_level="irrelevant"), "irrelevant", None, None, "federal_rf", "industry_background", (False, False, False)),
    (doc(title="О порядке выдачи субсидий", url="https://regulation.gov.ru/1", page_type="registry"), "watchlist", None, None, "federal_rf", "industry_background", (True, True, True)),
    (doc(source_role="strategy", title="Совещание о финансировании", raw_text="зерно"), "watchlist", None, None, "federal_rf", "industry_background", (False, False, False)),
]


def test_documents_are_seen_where_they_should(spark):
    df = spark.createDataFrame([(i, *d, "kept") for i, (d, *_) in enumerate(CASES)], f"i int, {COLUMNS}, gate string")
    got = {r.i: r for r in visibility.visible(df).collect()}
    for i, (d, *want) in enumerate(CASES):
        r = got[i]
        assert [r.action_level, r.guard_step, r.effective_step, r.geo_scope, r.bucket, (r.on_report, r.on_digest, r.on_list)] == want, d
        assert r.gate == "kept"
    wide = {r.i: r for r in visibility.visible(df, registries=True, market=True).collect()}
    assert wide[12].on_report and wide[3].on_report and not wide[14].on_report
    assert {r.i: r.on_report for r in visibility.visible(df, sections=True).collect()}[14]


def test_visibility_of_nulls_and_nothing(spark):
    r = visibility.visible(spark.createDataFrame([(None,) * len(visibility.INPUTS)], COLUMNS)).first()
    assert (r.action_level, r.geo_scope, r.section, r.on_report) == ("", "non_target_rf", "news_signals", False)
    assert visibility.visible(spark.createDataFrame([], COLUMNS)).count() == 0


def test_analysis(spark):
    rows = [
        (1, "Отбор на субсидии", "Прием заявок до 15.03.2024 для молочного животноводства АПК.", "ГИСП", "active_support_measures", "https://gisp.gov.ru/measure/1", "federal"),
        (2, "Заметка", "Погода", "Вестник", None, "http://x.example", None),
        (3, "Состоится форум", "Прямая трансляция о зерне", "Отрасль", "news_signals", "http://x.example", None),
        (4, None, None, None, None, None, None),
        (5, "Реестр получателей", "АПК и рыболовство, переработка", "Вестник", None, "http://x.example", "federal"),
    ]
    df = spark.createDataFrame(rows, "id int, title string, raw_text string, source_name string, source_role string, url string, region string")
    got = {r.id: r for r in analysis.analysed(df, "2024-03-01").collect()}
    one = got[1]
    assert (one.page_type, one.action_level, one.importance, one.is_relevant) == ("measure_card", "requires_attention", "high", True)
    assert one.deadline_text == "Прием заявок до 15.03.2024 для молочного животноводства" and one.application_status == "open"
    assert one.impact == analysis.IMPACT["open_dated"].replace("{deadline}", one.deadline_text) and one.title == rows[0][1]
    assert one.reason.startswith("Документ требует внимания GR") and one.business_signal == levels.SIGNALS["open"] and one.reason.endswith(f"Бизнес-сигнал: {one.business_signal}.") and f"Тема: {one.topic}." in one.reason
    assert (got[2].action_level, got[2].reason, got[2].impact) == ("irrelevant", analysis.REASON["irrelevant"], analysis.IMPACT["default"])
    assert got[4].action_level == "irrelevant" and got[4].topic is None and got[4].reason == analysis.REASON["service"]
    assert got[5].topic == analysis.GENERAL and got[5].reason == analysis.REASON["listing"]
    assert analysis.analysed(df.limit(0), "2024-03-01").count() == 0


def test_topics_by_stems(spark):
    rows = [("Метка", "молоко"), (None, "рыболовство и переработка рыбы"), (None, "переработка зерна"), (None, "рыболов апк"), (None, "о погоде"), (None, "")]
    df = spark.createDataFrame(rows, "label string, t string")
    assert [r[0] for r in df.select(analysis.topic_label(F.col("label"), F.col("t"))).collect()] == ["Метка", None, "Переработка сельхозпродукции", analysis.GENERAL, None, None]
    assert levels.IMPORTANCE["background"] == "low"


ORDER = [
    (("Отбор", None, "strategy", None, "open", 0, "dairy"), "today", 410), (("Квоты на импорт", "", "strategy", None, "closed", 0, None), "trade", 380), (("Ограничение приема", None, None, None, None, None, None), "default", 100),
    (("Ограничение вывоза", None, None, None, None, None, None), "trade", 380), (("Терминал для экспорта", None, None, None, None, None, "other"), "trade", 380), (("Приказ", None, "regional_npa", "new_rule", "open", 3, None), "regional_act", 360),
    (("Мера", None, "support_documents", "measure_card", None, None, "postanovlenie_1528"), "support_act", 378), (("Отбор", None, None, None, "open", 7, None), "near", 340), (("Отбор", None, None, None, "open", 8, None), "open", 260),
    (("Отбор", "Условия обновлены", None, None, "open", -1, None), "change", 300), (("План", None, "strategy", None, None, None, None), "discussion", 200), (("Весть", None, "news_signals", None, None, None, None), "news", 180), ((None,) * 7, "default", 100),
]


def test_priorities(spark):
    assert priority.TIER.unreached(5000) == set()
    day = dt.date(2024, 3, 1)
    rows = [(i, *r[:5], day + dt.timedelta(days=r[5]) if r[5] is not None else None, r[6], "kept") for i, (r, *_) in enumerate(ORDER)]
    df = spark.createDataFrame(rows, "i int, title string, summary string, source_role string, page_type string, application_status string, deadline_date date, topic_family string, words string")
    got = {r.i: r for r in priority.prioritised(df, "2024-03-01").collect()}
    assert [(got[i].tier_branch, got[i].priority) for i in range(len(ORDER))] == [(b, n) for _, b, n in ORDER] and got[0].words == "kept"
