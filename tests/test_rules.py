import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docsignal.rules import levels, topics
from docsignal.rules.automaton import Markers
from docsignal.rules.decisions import Branch, Decision, Lowering, layers, with_predicates

AS_OF = "2024-03-01"


def test_markers_are_found_in_one_pass(spark):
    rng = random.Random(1)
    letters = "abё "
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    marks = Markers({"one": words[:90], "two": words[60:], "none": [], "blank": [""]})
    texts = [None, "", "a", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("seen", marks.scan(v=F.col("t"), rest=F.substring("t", 6, 100)))
    got = df.select(
        "id", "t", *(F.expr(marks.any("seen.v", marks.groups[g])).alias(f"any_{g}") for g in marks.groups), F.expr(marks.all("seen.v", words[:2])).alias("all"),
        F.expr(marks.count("seen.v", marks.groups["two"])).alias("n"), marks.which("seen.rest", words[:90]).alias("which"), F.expr(marks.all("seen.v", [])).alias("all_of_none"),
    ).collect()
    for r in got:
        t = r.t or ""
        for g in ("one", "two", "none", "blank"):
            assert r[f"any_{g}"] == any(w in t for w in marks.groups[g])
        assert r["all"] == all(w in t for w in words[:2]) and r.all_of_none
        assert r.n == sum(w in t for w in marks.groups["two"])
        assert r.which == [w for w in words[:90] if w in t[5:]]


def test_predicates_are_layered(spark):
    assert layers({"c": "a AND b", "a": "x > 1", "b": "NOT a OR 'c' = y"}) == [["a"], ["b"], ["c"]]
    with pytest.raises(ValueError, match="need each other"):
        layers({"a": "b", "b": "a"})
    df = spark.createDataFrame([(1, None), (2, "c"), (None, None)], "x int, y string")
    got = with_predicates(df, {"c": "a AND b", "a": "x > 1", "b": "NOT a OR 'c' = y"}).collect()
    assert [(r.a, r.b, r.c) for r in got] == [(False, True, False), (True, True, True), (False, True, False)]


def rows_of(decision, n, seed):
    rng = random.Random(seed)
    domains = decision.domains()
    return [{k: rng.choice(v) if rng.random() < 0.3 else v[0] for k, v in domains.items()} for _ in range(n)]


@pytest.mark.parametrize("decision", [levels.PAGE_TYPE, levels.APPLICABILITY, levels.ACTION_LEVEL, levels.SIGNAL], ids=lambda d: d.name)
def test_every_branch_decides_something(spark, decision):
    assert decision.unreached(40_000) == set()
    rows = rows_of(decision, 300, 2)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in rows[0].items()))
    if decision.name in df.columns:
        df = df.drop(decision.name)
    got = decision.decide(df.withColumn("n", F.monotonically_increasing_id())).orderBy("n").select(f"{decision.name}_branch", decision.name).collect()
    assert [r[0] for r in got] == [decision.first(r) for r in rows]
    by = {b.name: b.value for b in decision.branches} | {"default": decision.default}
    assert all(by[r[0]].startswith("{") or by[r[0]] == r[1] for r in got)


def test_a_shadowed_branch_is_named():
    d = Decision("d", (Branch("one", "a OR b", "x"), Branch("two", "a AND c", "y"), Branch("three", "kind IN ('p', 'q') AND NOT c", "z")), "w")
    assert d.unreached(500) == {"two"}
    assert d.first({"a": False, "b": False, "c": False, "kind": "q"}) == "three" and d.first({"a": False, "b": False, "c": True, "kind": "q"}) == "default"
    with pytest.raises(ValueError, match="share a name"):
        Decision("d", (Branch("one", "a", "x"), Branch("one", "b", "x")), "w")


def test_lowering_only_lowers(spark):
    with pytest.raises(ValueError, match="raises"):
        Lowering("l", levels.LEVELS, (("up", ("background",), "a", "watchlist"),))
    low = Lowering("l", levels.LEVELS, (("computed", ("watchlist", "background"), "a", "{other}"), ("fixed", ("requires_attention",), "b", "watchlist")))
    rows = [(x, a, b, o) for x in (*levels.LEVELS, None) for a in (True, False) for b in (True, False) for o in (*levels.LEVELS, None)]
    got = low.apply(spark.createDataFrame(rows, "level string, a boolean, b boolean, other string").withColumn("before", F.col("level")), "level").collect()
    rank = {x: i for i, x in enumerate(levels.LEVELS)}
    for r in got:
        assert r.before is None or rank[r.level] >= rank[r.before]
        if r.before == "requires_attention":
            assert r.level == ("watchlist" if r.b else "requires_attention") and (r.l_step == "fixed") == r.b


KRASNODAR = "Минсельхоз Краснодарского края - Субсидирование и финансирование"
FARM = "субсидии фермерам на молоко. "


def doc(title, text="", role="", url="http://x.example/1", source="Вестник", level="", region="", quality="content", service=False, deadline=None, application="unknown", support="unknown"):
    day = dt.date.fromisoformat(deadline) if deadline else None
    return (title, text, source, role, url, level, region, quality, service, f"до {deadline}" if deadline else None, day, day, application, support)


#: (document, page type, its branch, action level, its branch)
CASES = [
    (doc("2025"), "year_archive", "year", "irrelevant", "quiet"),
    (doc("Вакансии министерства сельхоза", role="regional_npa"), "section_page", "low_value", "irrelevant", "quiet"),
    (doc("Контакты", "апк", role="support_documents"), "section_page", "low_value", "irrelevant", "low_page"),
    (doc("Приказы 2024", "апк", role="regional_npa", url="http://mshsk.ru/documents/1", source="Ставрополь"), "reference_page", "orders_listing", "background", "list_regional"),
    (doc("О порядке", "Приказ о субсидиях и грантах фермерам", role="support_documents", url="https://npa.krasnodar.ru/rest/files/12", source=KRASNODAR, region="krasnodar"), "new_rule", "krasnodar_order", "watchlist", "krasnodar_order"),
    (doc("О порядке", "Приказ о грантах. Конный спорт", role="support_documents", url="https://npa.krasnodar.ru/rest/files/12", source=KRASNODAR, region="krasnodar"), "new_rule", "krasnodar_order", "background", "krasnodar_exhibits"),
    (doc("О порядке", "Приказ о грантах фермерам", role="support_documents", url="https://npa.krasnodar.ru/rest/files/12/", source=KRASNODAR, region="krasnodar", deadline="2024-03-10", application="open"), "new_rule", "krasnodar_order", "requires_attention", "krasnodar_near"),
    (doc("Указ о полях", "апк", role="regional_npa", url="https://admkrai.krasnodar.ru/a/b.PDF", region="krasnodar"), "new_rule", "admkrai_file", "watchlist", "regional_rule"),
    (doc("Поиск", "апк", role="strategy", url="http://government.ru/search/1"), "navigation", "service_government", "watchlist", "quiet_strategy"),
    (doc("Архив решений", "апк", role="strategy"), "new_rule", "service_strategy_rule", "watchlist", "quiet_strategy"),
    (doc("Архив решений", "апк. Внесены изменения, субсид", role="regional_npa"), "news_background", "service_regional", "requires_attention", "quiet_regional_strong"),
    (doc("Итоги отбора", FARM, role="active_support_measures", level="support_measures"), "results_protocol", "results", "watchlist", "list_hinted"),
    (doc("Проект акта", FARM, role="strategy", url="https://regulation.gov.ru/projects/1"), "new_rule", "regulation_project", "watchlist", "strategy_signal"),
    (doc("Проект постановления о земле", FARM + "публичное обсуждение", role="strategy", url="https://regulation.gov.ru/projects/1", deadline="2024-03-05"), "new_rule", "regulation_project", "watchlist", "strategy_near"),
    (doc("Закон о земле", "апк", role="regional_npa", url="http://pravo.donland.ru/doc/view/1"), "new_rule", "pravo_donland_act", "watchlist", "regional_rule"),
    (doc("Отбор для фермеров", FARM, role="active_support_measures", url="https://promote.budget.gov.ru/public/minfin/selection/view/1", region="federal", application="open", deadline="2024-03-02"), "selection_announcement", "promote_selection", "requires_attention", "measure_strong"),
    (doc("Отбор для фермеров", FARM, role="active_support_measures", url="https://promote.budget.gov.ru/public/minfin/selection/view/1", region="federal", application="open", deadline="2024-03-20"), "selection_announcement", "promote_selection", "requires_attention", "measure_strong"),
    (doc("Отбор для фермеров", "молоко", role="active_support_measures", url="https://promote.budget.gov.ru/public/minfin/selection/view/1", region="federal", application="open", deadline="2024-03-20"), "selection_announcement", "promote_selection", "watchlist", "measure_hinted"),
    (doc("Мера", FARM, role="active_support_measures", url="https://gisp.gov.ru/measure/1", region="federal", support="inactive"), "measure_card", "gisp_measure", "background", "measure_inactive"),
    (doc("Мера", "республика Крым " + FARM, role="active_support_measures", url="https://gisp.gov.ru/measure/1"), "measure_card", "gisp_measure", "background", "not_applicable"),
    (doc("Мера", "рыболовство " + FARM, role="active_support_measures", url="https://gisp.gov.ru/measure/1"), "measure_card", "gisp_measure", "irrelevant", "excluded"),
    (doc("Запрет на вывоз", "Правительство утвердило квоту на экспорт зерна", role="news_signals"), "news_background", "sector", "requires_attention", "news_strong"),
    (doc("Пошлина на пшеницу", "Минсельхоз планирует изменить экспортную пошлину на пшеницу по биржевым ценам для рынка РФ", role="news_signals", level="federal"), "news_background", "sector", "watchlist", "news_duty"),
    (doc("Прогноз урожая", "зерно растет", role="news_signals"), "news_background", "sector", "background", "news"),
    (doc("Вести с поля", "зерно"), "news_background", "sector", "watchlist", "press_hinted"),
    (doc("О погоде", "дождь"), "unknown", "default", "irrelevant", "default"),
    (doc("Указание", "О льготном порядке. постановление"), "new_rule", "says_rule", "background", "mentioned"),
    (doc("Объявление", "Объявлен отбор на технику"), "selection_announcement", "says_selection", "requires_attention", "strict"),
]


def test_documents_get_their_branches(spark):
    names = list(levels.INPUTS)
    df = spark.createDataFrame([(i, *d, "a", "b") for i, (d, *_) in enumerate(CASES)], "i int, " + ", ".join(f"{n} {levels.INPUTS[n]}" for n in names) + ", domain string, agro string")
    got = {r.i: r for r in levels.leveled(df, AS_OF).collect()}
    for i, (d, *want) in enumerate(CASES):
        r = got[i]
        assert [r.page_type, r.page_type_branch, r.action_level, r.action_level_branch] == want, d
        assert (r.domain, r.agro, r.title) == ("a", "b", d[0])
    signal = lambda i: (got[i].signal_branch, got[i].business_signal)
    assert signal(19) == ("not_applicable", levels.SIGNALS["measure_elsewhere"]) and signal(20) == ("not_applicable", levels.WHY_TOPIC)
    assert signal(6) == ("krasnodar_open", "Открыт конкурсный отбор или приём заявок Минсельхоза Краснодарского края (срок подачи: до 2024-03-10): проверить условия участия.")
    assert [signal(i)[0] for i in (11, 13, 14, 21, 23, 24, 27)] == ["results", "strategy_dated", "regional", "market", "market", "default", "default"]


def test_levels_of_nulls_and_nothing(spark):
    schema = "i int, " + ", ".join(f"{n} {t}" for n, t in levels.INPUTS.items())
    r = levels.leveled(spark.createDataFrame([(1, *[None] * len(levels.INPUTS))], schema), AS_OF).first()
    assert (r.page_type, r.action_level, r.applicability, r.importance, r.matched_keywords) == ("navigation", "irrelevant", "ok", "low", [])
    assert levels.leveled(spark.createDataFrame([], schema), AS_OF).count() == 0


def test_keywords_count(spark):
    df = spark.createDataFrame([doc("О погоде", "дождь и ГРАД")], ", ".join(f"{n} {t}" for n, t in levels.INPUTS.items()))
    r = levels.leveled(df, AS_OF, {"g": ["Град", "снег"]}).first()
    assert r.matched_keywords == ["град"] and r.page_type == "news_background" and r.action_level == "watchlist"


@pytest.mark.parametrize(
    ("level", "role", "title", "reason", "text", "want", "step"),
    [
        ("requires_attention", "news_signals", "Состоится форум", "", "приглашаем", "background", "event"),
        ("watchlist", "news_signals", "Состоится форум", "", "утвердил порядок", "watchlist", None),
        ("requires_attention", "news_signals", "Пошлины", "", "Минсельхоз рассматривает экспортную пошлину на зерно, торги", "watchlist", "duty"),
        ("requires_attention", "news_signals", "Турция ввела квоты", "", "импорт", "background", "abroad"),
        ("requires_attention", "news_signals", "Турция ввела квоты", "", "экспорт из России", "requires_attention", None),
        ("watchlist", "news_signals", "Заметка", "Рыночный или отраслевой фон без прямого регуляторного сигнала.", "", "background", "market"),
        ("watchlist", "news_signals", "Обзор рынка", "", "урожай", "background", "noise"),
        ("watchlist", "news_signals", "Обзор рынка", "", "субсидии", "watchlist", None),
        ("watchlist", "strategy", "Обзор рынка", "", "урожай", "watchlist", None),
        ("background", "news_signals", "Состоится форум", "", "", "background", None),
        (None, "news_signals", "Состоится форум", None, None, None, None),
    ],
)
def test_guard(spark, level, role, title, reason, text, want, step):
    df = spark.createDataFrame([(level, role, title, None, reason, None, None, text, None, "kept")], "action_level string, source_role string, title string, summary string, reason string, impact string, signal string, raw_text string, page_type string, news string")
    r = levels.guarded(df).first()
    assert (r.action_level, r.guard_step, r.news) == (want, step, "kept")


def test_topics(spark):
    config = {"families": {
        "first": {"label": "One", "risk": "low", "exact": ["Ёлка и сосна"], "exclude_any": ["крс"], "rules": [{"all": ["зерн", "цены"], "any": ["апк"], "exclude_any": ["мука"]}]},
        "second": {"exact": ["зерн"], "rules": [{"context_any": "поле"}]},
        "empty": {"rules": [{}]},
    }, "keywords": {"a": [" x ", "y"], "b": ["y", ""]}}
    known = topics.families(config)
    rows = ["елка и, СОСНА", "ёлка и сосна КРС зерно", "цены на зерно в АПК", "цены на зерно в апкшке", "цены на зерно АПК мука", "на поле", "ничего", "", None]
    got = topics.with_topic(spark.createDataFrame(list(enumerate(rows)), "i int, t string"), F.col("t"), known=known).orderBy("i").collect()
    shown = [(r.topic.family, r.topic.label, r.topic.hits, r.topic.confidence) if r.topic else None for r in got]
    assert shown[0] == ("first", "One", ["елка и сосна"], "high") and shown[1] == ("second", "second", ["зерн"], "high")
    assert shown[2] == ("first", "One", ["зерн", "цены", "апк"], "high") and shown[3][0] == "second" == shown[4][0]
    assert shown[5] == ("second", "second", ["поле"], "medium") and shown[6:] == [None] * 3
    assert topics.keyword_groups(config) == {"a": ["x", "y"], "b": ["y"]} and topics.keywords(topics.keyword_groups(config)) == ["x", "y"]
    assert len(topics.families()) == 11 and topics.keyword_groups()
