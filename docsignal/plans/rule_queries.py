"""Queries over the rules for page types and levels.

The driver's documents are prose in other languages than the rules', so each gets a title, a source and two
phrases of the rules' language by its numbers, around its whole text. Facts are picked likewise.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts
from ..operators import health, latest
from ..rules import levels, priority, topics, visibility
from ..rules.decisions import layers
from .registry import query

AS_OF = "2024-03-01"
KEYWORDS = {"support_measures": ["господдержка АПК", "мелиорац"], "subsidy_terms": ["возмещение части затрат"], "credit_terms": ["льготные кредиты в АПК"], "export_support": ["экспортная пошлина"], "grain_support": ["элитного семеноводства"], "regulatory_change": ["порядок предоставления"], "public_discussion": ["публичное обсуждение"]}
TITLES = (
    "Субсидии", "2024", "Приказы министерства", "Объявление об отборе на субсидии", "Контакты министерства", "Реестр получателей", "Льготное кредитование аграриев", "Постановление о порядке", "О ценах на рынке зерна",
    "Минсельхоз утвердил квоту на экспорт зерна", "Архив", "Протоколы рассмотрения заявок", "Памятка заявителю", "Приказ министерства сельского хозяйства о гранте", "Проект постановления о мелиорации", "Животноводство",
    "Порядок предоставления субсидий фермерам", "Охрана объектов культурного наследия", "Вакансии", "Господдержка", "Правовые акты", "Встреча с молодежью", "Сводный отчет о результатах проведения публичных консультаций",
    "Урожай пшеницы в крае", "Конкурс на лучший двор", "Независимая экспертиза", "Субсидия на технику", "Сроки приема документов",
)
PHRASES = (
    "", "Прием заявок открыт", "срок подачи заявок", "внесены изменения в порядок", "публичное обсуждение проекта", "главная контакты", "Министерство сельского хозяйства Орловской области", "республика Крым", "Ростовская область",
    "федерального бюджета", "рыболовство и рыбоводство", "пошлина на экспорт зерна", "Минсельхоз планирует изменить экспортную пошлину на пшеницу по биржевым ценам для рынка РФ", "без изменений", "зерновые культуры и молоко",
    "пробирная палата", "конный спорт", "раздел находится в стадии наполнения", "порядок предоставления субсидий", "КРС", "квоты на импорт из Турции", "состоится форум", "приказ о субсидиях и грантах", "возмещение части затрат",
    "льготные кредиты в АПК", "электронный бюджет", "конец обсуждения проекта", "Правительство утвердило программу поддержки экспорта", "московская область", "порт Новороссийск, отгрузки зерна", "оценка регулирующего воздействия", "мера поддержки активная",
)
#: (source, role, address, level, region)
SOURCES = (
    ("ГИСП", "active_support_measures", "https://gisp.gov.ru/nmp/measure/1", "support_measures", "federal"), ("ГИСП", "active_support_measures", "https://gisp.gov.ru/nmp/main/2", "support_measures", ""),
    ("Портал отборов", "active_support_measures", "https://promote.budget.gov.ru/public/minfin/selection/view/3", "federal", "federal"), ("Проекты", "strategy", "https://regulation.gov.ru/projects/4", "federal", "federal"),
    ("Проекты", "news_signals", "https://regulation.gov.ru/npa/5", "federal", "federal"), ("Правительство", "strategy", "http://government.ru/docs/6", "federal", "federal"), ("Зерно", "news_signals", "https://www.zol.ru/n/7", "", ""),
    ("Минсельхоз России - новости", "news_signals", "https://mcx.gov.ru/press/8", "federal", "federal"), ("Минсельхоз", "support_documents", "https://mcx.gov.ru/docs/9", "federal", "federal"), ("Рыба", "strategy", "https://mcx.gov.ru/fish/10", "federal", ""),
    ("Дон", "support_documents", "https://mcx.donland.ru/documents/11", "regional", "rostov"), ("Дон, право", "regional_npa", "https://pravo.donland.ru/doc/view/12.pdf", "regional", "rostov"), ("Дон, право", "regional_npa", "https://pravo.donland.ru/doc/list/", "regional", "rostov"),
    ("Кубань", "regional_npa", "https://admkrai.krasnodar.ru/content/14", "regional", "krasnodar"), ("Кубань", "regional_npa", "https://admkrai.krasnodar.ru/x/15.docx", "regional", "krasnodar"),
    ("Минсельхоз Краснодарского края - Субсидирование и финансирование", "support_documents", "https://npa.krasnodar.ru/rest/files/16", "regional", "krasnodar"), ("Кубань, поддержка", "support_documents", "https://msh.krasnodar.ru/activity/17", "regional", "krasnodar"),
    ("Ставрополь", "support_documents", "http://mshsk.ru/gospodderzhka/", "regional", "stavropol"), ("Ставрополь, право", "regional_npa", "https://pravo.stavregion.ru/document/19", "regional", "stavropol"), ("Вестник", "", "https://vestnik.example/20", "", ""),
    ("Вестник меры поддержки", "", "https://vestnik.example/субсидии/21", "federal", ""), ("Область", "regional_npa", "https://oblast.example/policy/22", "regional", "orel"), ("Отрасль", "news_signals", "https://otrasl.example/23", "", "krasnodar"), ("Стратегия", "strategy", "https://plan.example/24", "federal", "federal"),
)
DEADLINES = (None, "2024-03-02", "2024-03-10", "2024-05-01", "2024-02-01")
APPLICATIONS, SUPPORTS = ("unknown", "open", "closed", "regular"), ("unknown", "active", "inactive")


def pick(values, number: str, spark: bool) -> str:
    shown = [("NULL" if v is None else "'" + v + "'") for v in values]
    at = f"CAST(({number}) % {len(values)} AS INT)"
    return f"array({', '.join(shown)})[{at}]" if spark else f"[{', '.join(shown)}][{at} + 1]"


def dressed(spark: bool) -> list[str]:
    """The rules' input columns, from columns of documents."""
    of = lambda values, number: pick(values, number, spark)
    day = of(DEADLINES, "doc_id * 3 + n_chars")
    return [
        "doc_id",
        f"{of(TITLES, 'doc_id * 5 + n_chars')} AS title",
        f"{of(PHRASES, 'doc_id * 11 + n_chars')} || '. ' || text || ' ' || {of(PHRASES, 'doc_id * 13 + 5 * n_chars')} AS raw_text",
        *(f"{of([s[i] for s in SOURCES], 'doc_id * 7 + n_chars')} AS {n}" for i, n in enumerate(("source_name", "source_role", "url", "level", "region"))),
        "CASE doc_id % 17 WHEN 0 THEN 'navigation' WHEN 1 THEN 'empty' ELSE 'content' END AS content_quality",
        "doc_id % 19 = 0 AS is_service_page",
        f"CASE WHEN {day} IS NULL THEN '' ELSE 'до ' || {day} END AS deadline_text",
        f"CAST({day} AS DATE) AS deadline_date",
        f"CAST({day} AS DATE) AS discussion_date",
        f"{of(APPLICATIONS, 'doc_id + n_chars')} AS application_status",
        f"{of(SUPPORTS, 'doc_id + 2 * n_chars')} AS support_status",
        f"{of(PHRASES, 'doc_id * 17 + n_chars')} AS summary",
        f"{of(('Важно для отрасли', 'Рыночный или отраслевой фон без прямого регуляторного сигнала.', ''), 'doc_id + 3 * n_chars')} AS reason",
        "'' AS impact",
        "'' AS signal",
    ]


#: The same as a table.
DRESSED = f"SELECT {', '.join(dressed(False))} FROM documents"


def layered(source: str, steps: list[dict[str, str]]) -> str:
    """SELECTs one in another, each adding columns."""
    for step in steps:
        source = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM ({source})"
    return source


def level_sql() -> str:
    d = levels.Plain(levels.groups(KEYWORDS))
    p = levels.predicates(d, AS_OF)
    every = layers(p | {"page_type": "NULL"})
    late = {"page_type"}
    while more := {n for n, e in p.items() if n not in late and late & levels.named(e)}:
        late |= more
    steps = [levels.base_columns(d), levels.views(d)]
    tests = lambda keep: [{n: f"coalesce({p[n]}, false)" for n in layer if n in p and keep(n)} for layer in every]
    steps += tests(lambda n: n not in late)
    steps += [{"page_type_branch": levels.PAGE_TYPE.branch_sql()}, {"page_type": levels.PAGE_TYPE.value_sql("page_type_branch")}]
    steps += tests(lambda n: n in late)
    for x in (levels.APPLICABILITY, levels.ACTION_LEVEL, levels.SIGNAL):
        steps += [{f"{x.name}_branch": x.branch_sql()}, {f"{x.name}_text" if x is levels.SIGNAL else x.name: x.value_sql(f"{x.name}_branch")}]
    return layered(DRESSED, [s for s in steps if s])


def guard_sql() -> str:
    d = levels.Plain(levels.groups())
    p = levels.guard_predicates(d)
    start = f"SELECT *, CASE doc_id % 3 WHEN 0 THEN 'watchlist' WHEN 1 THEN 'requires_attention' ELSE 'background' END AS action_level, CASE doc_id % 4 WHEN 0 THEN 'new_rule' ELSE 'news_background' END AS page_type FROM ({DRESSED})"
    return layered(start, [levels.guard_views(), *({n: f"coalesce({p[n]}, false)" for n in layer} for layer in layers(p)), {"lowered": levels.GUARD.sql("action_level")}])


@query(f"SELECT doc_id, page_type, page_type_branch, applicability, applicability_branch, action_level, action_level_branch, signal_branch FROM ({level_sql()})")
def action_levels(t, spark):
    """Type, applicability, level and signal of every document, with the branches that decided."""
    got = levels.leveled(t("documents").selectExpr(*dressed(True)), AS_OF, KEYWORDS)
    return got.select("doc_id", "page_type", "page_type_branch", "applicability", "applicability_branch", "action_level", "action_level_branch", "signal_branch")


@query(f"SELECT doc_id, action_level AS before, lowered AS action_level FROM ({guard_sql()})")
def guarded_levels(t, spark):
    """Levels of news that are mere background are lowered."""
    level = F.when(F.col("doc_id") % 3 == 0, "watchlist").when(F.col("doc_id") % 3 == 1, "requires_attention").otherwise("background")
    df = t("documents").selectExpr(*dressed(True)).withColumns({"before": level, "action_level": level, "page_type": F.when(F.col("doc_id") % 4 == 0, "new_rule").otherwise("news_background")})
    return levels.guarded(df).select("doc_id", "before", "action_level")


def topic_sql() -> str:
    one = lambda m: f"contains(t, '{m}')"
    any_of = lambda ms: "(" + " OR ".join(map(one, ms)) + ")"
    all_of = lambda ms: "(" + " AND ".join(map(one, ms)) + ")"
    tried = list(topics.branches(topics.families(), any_of, all_of))
    case = lambda shown: "CASE " + " ".join(f"WHEN {holds} THEN {shown(f, ms, sure)}" for f, ms, sure, holds in tried) + " END"
    hits = lambda f, ms, sure: f"list_transform(list_filter([{', '.join(repr(m) for m in dict.fromkeys(ms))}], lambda m: contains(t, m)), lambda m: trim(m))"
    text = "' ' || trim(regexp_replace(replace(lower(title || ' ' || raw_text), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g')) || ' '"
    return f"SELECT doc_id, {case(lambda f, ms, sure: repr(f.name))} AS family, {case(lambda f, ms, sure: repr(sure))} AS confidence, array_to_string({case(hits)}, '|') AS hits FROM (SELECT doc_id, {text} AS t FROM ({DRESSED}))"


@query(topic_sql())
def topic_families(t, spark):
    """The topic of every document, by the families of the configuration, with the markers that speak for it."""
    got = topics.with_topic(t("documents").selectExpr(*dressed(True)), F.col("title"), F.col("raw_text"))
    return got.select("doc_id", "topic.family", "topic.confidence", F.array_join("topic.hits", "|").alias("hits"))


#: Sentences about applications in awkward forms, put around the documents' texts.
NOTICES = (
    "", "Прием заявок до 15.03.2024 включительно. Иное", "Срок подачи с 1.3.2024 по 20.3.2024", "Заявки принимаются. До 7 марта 2024 года в отделе", "Прием заявок. Срок кредита до 1.1.2030", "Срок подачи заявок до 31.2.2024, прием документов по 4/4/2024",
    "Конец обсуждения: 2024-05-06", "Публичное обсуждение программы до 2030 года", "До 1.1.2024 было рано", "Объявлен конкурсный отбор: заявки принимаются до 9 мая 2024 г. в центре", "Подача заявок до 1.4.2024. Подача заявок до 2.4.2024", "Приказ от 5.5.2023. Отбор заявок",
    "Идет прием заявок " + "в районах края " * 14 + "до 1.4.2024", "Прием документов по 30 апрель 2024 и до 2024-04-01", "Прием завершен. Прием заявок до 1.5.2024", "Выдается на регулярной основе", "Мера не активная", "Мера активная, срок обсуждения до 10.10.2024!",
)


def facts_sql() -> str:
    m, b = facts.MARKS, r"(?:^|[^\p{L}\p{N}_])"
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    one = lambda c, ms: "(" + " OR ".join(f"contains({c}, {quoted(x)})" for x in ms) + ")"
    names = "[" + ", ".join(f"'{x}'" for x in facts.dates.RUSSIAN) + "]"
    alone = "[" + ", ".join(f"'{x}'" for x in facts.dates.RUSSIAN_ALONE) + "]"
    d = f"lower(regexp_extract_all(t, {quoted('(?i)' + facts.DAY)})[-1])"
    month = f"coalesce(list_position({names}, regexp_extract({d}, '([а-я]+)', 1)), list_position({alone}, regexp_extract({d}, '([а-я]+)', 1)))"
    day = f"""CASE WHEN regexp_matches({d}, '^[0-9]{{4}}-') THEN TRY_CAST({d} AS DATE) WHEN regexp_matches({d}, '^[0-9]+[./]') THEN CAST(try_strptime(replace({d}, '/', '.'), '%d.%m.%Y') AS DATE)
      ELSE CAST(try_strptime(regexp_extract({d}, '^([0-9]+)', 1) || '.' || {month} || '.' || regexp_extract({d}, '([0-9]{{4}})', 1), '%d.%m.%Y') AS DATE) END"""
    last = lambda p: f"list_filter(regexp_extract_all(s, {quoted('(?i)' + b + '(' + p.removeprefix(chr(92) + 'b') + ')')}, 1), lambda t: {day} IS NOT NULL)[-1]"
    ending = last(facts.ENDING).replace("(?i)" + b, "(?i)")
    points = f"CASE WHEN {one('low', m.open)} THEN 5 ELSE 0 END" + "".join(f" + CASE WHEN {one('low', ms)} THEN {n} ELSE 0 END" for ms, n in m.points) + "".join(f" + CASE WHEN contains(lower(dated), '{u}') THEN {n} ELSE 0 END" for u, n in m.until)
    lead = f"strpos(low, regexp_extract(low, '{'|'.join((*m.deadline, *m.lead))}'))"
    other = f"({one('low', m.not_deadline)} OR contains(low, '{m.programme}') AND NOT {one('low', m.programme_unless)})"
    about = lambda c: one(c, (*m.deadline, *m.open))
    at = "length(low) - strpos(reverse(low), reverse(lower(dated))) - length(dated) + 1"
    trimmed = lambda c, p: f"regexp_replace({c}, '{p}', '', 'g')"
    return rf"""
    WITH src AS (SELECT doc_id, trim(regexp_replace({pick(NOTICES, 'doc_id * 11 + n_chars', False)} || '. ' || text || ' ' || {pick(NOTICES, 'doc_id * 13 + 5 * n_chars', False)} || '.', '\s+', ' ', 'g')) AS flat FROM documents),
    parts AS (SELECT doc_id, list_filter(string_split(regexp_replace(flat, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM src),
    each AS (SELECT doc_id, i, p[i] AS s, p[i - 1] AS before FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
    ways AS (SELECT doc_id, i, 0 AS k, s FROM each UNION ALL SELECT doc_id, i, 1, before || ' ' || s FROM each WHERE i > 1 AND starts_with(lower(s), '{m.continued}') AND {about('lower(before)')}),
    lows AS (SELECT *, lower(s) AS low FROM ways WHERE {about('lower(s)')}),
    dates AS (SELECT *, coalesce({last(facts.RANGE)}, {last(facts.UNTIL)}, {ending}) AS dated FROM lows WHERE NOT {other}),
    scored AS (SELECT *, {points} AS points, CASE WHEN {lead} > 0 THEN {lead} - 1 ELSE greatest({at} - {facts.BEFORE}, 0) END AS start, least({at} + length(dated) + {facts.AFTER}, length(low)) AS stop FROM dates WHERE dated IS NOT NULL),
    cut AS (SELECT doc_id, i, k, points, {trimmed('substr(s, start + 1, greatest(stop - start, 0))', facts.EDGES)} AS snippet FROM scored),
    own AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY k) = 1),
    best AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, i) = 1)
    SELECT doc_id, CASE WHEN length(snippet) <= {facts.SNIPPET} THEN snippet ELSE {trimmed(f'substr(snippet, 1, {facts.SNIPPET - 3})', '[ ,.;:-]+$')} || '...' END AS deadline_text,
      CASE WHEN {one('lower(flat)', m.inactive)} THEN 'inactive' WHEN {one('lower(flat)', m.active)} THEN 'active' ELSE 'unknown' END AS support_status, {one('lower(flat)', m.closed)} AS closed FROM src LEFT JOIN best USING (doc_id)"""


@query(facts_sql())
def deadline_sentences(t, spark):
    """The sentence that names the deadline, by points; sentences that go on, ranges, days that are none, loans."""
    text = f"{pick(NOTICES, 'doc_id * 11 + n_chars', True)} || '. ' || text || ' ' || {pick(NOTICES, 'doc_id * 13 + 5 * n_chars', True)} || '.'"
    df = t("documents").select("doc_id", F.expr(text).alias("t"))
    df = df.select("doc_id", facts.facts(F.col("t"), F.to_date(F.lit(AS_OF))).alias("f"), facts.any_of(facts.squash(F.col("t")), list(facts.MARKS.closed)).alias("closed"))
    return df.select("doc_id", "f.deadline_text", "f.support_status", "closed")


#: Columns of an analysis that visibility reads, beside the dressed ones.
ANALYSED = [
    "CASE doc_id % 3 WHEN 0 THEN 'watchlist' WHEN 1 THEN 'requires_attention' ELSE CASE n_chars % 2 WHEN 0 THEN 'background' ELSE 'irrelevant' END END AS action_level",
    "CASE n_chars % 5 WHEN 0 THEN 'new_rule' WHEN 1 THEN 'news_background' WHEN 2 THEN 'reference_page' WHEN 3 THEN 'registry' ELSE 'measure_card' END AS page_type",
    "CASE (doc_id + n_chars) % 7 WHEN 0 THEN 'background' WHEN 1 THEN 'watchlist' ELSE 'ok' END AS applicability", "source_url", "terms_text", "doc_id % 23 = 0 AS is_placeholder",
]
MORE = ("", "сохранено справочно, регион вне фокуса AHSTEP", "признание утратившим силу приказа о сельскохозяйственной переписи", "цифровая селекция", "мировой рынок, Казахстан", "памятка по декларациям о коррупции", "совещание по экономике", "Башкирия", "Ставрополь")


def visibility_sql() -> str:
    d = levels.Plain(levels.groups())
    p = visibility.predicates(d)
    start = f"SELECT * REPLACE (title || ' ' || {pick(MORE, 'doc_id + 7 * n_chars', False)} AS title), {', '.join(ANALYSED)} FROM (SELECT d.*, n_chars, url AS source_url, summary AS terms_text FROM ({DRESSED}) d JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id))"
    tests = [{n: f"coalesce({p[n]}, false)" for n in layer} for layer in layers(p)]
    lowered = visibility.GUARD.sql("action_level")
    effective = "CASE " + " ".join(f"WHEN guarded IN ({', '.join(map(repr, at))}) AND ({when}) THEN {to[1:-1] if to.startswith('{') else repr(to)}" for _, at, when, to in visibility.EFFECTIVE.steps) + " ELSE guarded END"
    scope = [{"geo_branch": visibility.GEO_SCOPE.branch_sql()}, {"geo_scope": visibility.GEO_SCOPE.value_sql("geo_branch")}]
    whole = layered(start, [visibility.views(d), *tests, *scope, {"guarded": lowered}, {"seen_level": effective}])
    after = f"SELECT * EXCLUDE (action_level) RENAME (seen_level AS action_level) FROM ({whole})"
    named = [{"bucket_branch": visibility.BUCKET.branch_sql(), "section_branch": visibility.SECTION.branch_sql()}, {"bucket": visibility.BUCKET.value_sql("bucket_branch"), "section": visibility.SECTION.value_sql("section_branch")}]
    return layered(after, [*named, {n: f"coalesce({e}, false)" for n, e in visibility.surfaces().items()}])


@query(f"SELECT doc_id, action_level, geo_scope, bucket, section, on_report, on_digest, on_list FROM ({visibility_sql()})")
def visible_documents(t, spark):
    """Effective levels, scopes, buckets, sections, and the surfaces that show a document."""
    df = t("documents").selectExpr("*", *(c for c in dressed(True) if c != "doc_id")).withColumns({"source_url": F.col("url"), "terms_text": F.col("summary"), "title": F.concat_ws(" ", "title", F.expr(pick(MORE, "doc_id + 7 * n_chars", True)))})
    df = df.selectExpr("*", *(c for c in ANALYSED if " AS " in c))
    return visibility.visible(df).select("doc_id", "action_level", "geo_scope", "bucket", "section", "on_report", "on_digest", "on_list")


def priority_sql() -> str:
    family = pick([*health.TOPIC_BOOST, "other", None], "doc_id + 11 * n_chars", False)
    start = f"SELECT *, {pick(('new_rule', 'measure_card', 'news_background'), 'doc_id + 5 * n_chars', False)} AS page_type, {family} AS topic_family FROM (SELECT d.*, n_chars FROM ({DRESSED}) d JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id))"
    tests = {n: f"coalesce({e}, false)" for n, e in priority.predicates(levels.Plain({}), AS_OF).items()}
    whole = layered(start, [{"words": priority.WORDS}, tests, {"tier_branch": priority.TIER.branch_sql()}, {"tier": priority.TIER.value_sql("tier_branch")}])
    points = "CASE tier " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in priority.TIERS.items()) + " END"
    boost = "CASE topic_family " + " ".join(f"WHEN '{f}' THEN {n}" for f, n in health.TOPIC_BOOST.items()) + " ELSE 0 END"
    return f"SELECT doc_id, tier_branch, CAST({points} + {boost} AS INTEGER) AS priority, row_number() OVER (PARTITION BY source_role ORDER BY {points} + {boost} DESC, doc_id)::INT AS place FROM ({whole}) QUALIFY place <= 20"


@query(priority_sql())
def display_order(t, spark):
    """C11: tiers of urgent documents with what their topics add, the first twenty of every role of sources."""
    df = t("documents").selectExpr(*dressed(True), f"{pick(('new_rule', 'measure_card', 'news_background'), 'doc_id + 5 * n_chars', True)} AS page_type", f"{pick([*health.TOPIC_BOOST, 'other', None], 'doc_id + 11 * n_chars', True)} AS topic_family")
    got = priority.prioritised(df, AS_OF).select("doc_id", "tier_branch", "priority", "source_role")
    return latest.top_per_group(got, ["source_role"], 20, F.desc("priority"), F.col("doc_id")).select("doc_id", "tier_branch", "priority", "place")
