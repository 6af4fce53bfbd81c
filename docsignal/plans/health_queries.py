"""Queries of freshness, schedules, figures and texts of orders; users stand for sources, event types for signals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates, periods, text
from ..operators import filters, health
from .event_queries import LEVEL_SQL, level
from .registry import query

AS_OF = dt.datetime(2024, 1, 31)


@query("""
WITH u AS (SELECT user_id, max(ts) AS latest, max(CASE WHEN event_type = 'purchase' THEN ts END) AS success, max(CASE WHEN event_type <> 'click' THEN ts END) AS attempted, count(CASE WHEN event_type = 'error' AND value > 95 THEN 1 END) AS degraded FROM events WHERE ts <= TIMESTAMP '2024-01-31' GROUP BY 1),
m AS (SELECT *, floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(coalesce(success, latest)))) / 60) AS age, floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(success))) / 60) AS own FROM u)
SELECT user_id, CASE WHEN attempted IS NOT NULL AND success IS NULL THEN 'unconfirmed' WHEN age IS NULL THEN 'unknown' WHEN degraded > 0 THEN 'partial' WHEN attempted IS NOT NULL AND age > 1440 THEN 'late' WHEN age <= 60 THEN 'fresh' ELSE 'stale' END AS freshness,
coalesce(own > CASE WHEN user_id % 2 = 0 THEN 3 ELSE 7 END * 1440, true) AS stale FROM m""")
def freshness_classes(t, spark):
    """Freshness of each source, and whether it has been silent for longer than its role allows."""
    seen = t("events").filter(F.col("ts") <= F.lit(AS_OF))
    of = lambda cond: F.max(F.when(cond, F.col("ts")))
    u = seen.groupBy("user_id").agg(
        F.max("ts").alias("latest"), of(F.col("event_type") == "purchase").alias("success"), of(F.col("event_type") != "click").alias("attempted"),
        F.count_if((F.col("event_type") == "error") & (F.col("value") > 95)).alias("degraded"),
    )
    role = F.when(F.col("user_id") % 2 == 0, "news_signals").otherwise("strategy")
    now = F.lit(AS_OF)
    return u.select("user_id", health.freshness(F.col("success"), F.col("latest"), F.col("attempted"), F.col("degraded"), now).alias("freshness"), health.stale_source(F.col("success"), role, now).alias("stale"))


@query("SELECT count(*) AS n, max(ts) AS latest_collected, max(CASE WHEN ts + INTERVAL (event_id % 9) DAY <= TIMESTAMP '2024-02-02' THEN ts + INTERVAL (event_id % 9) DAY END) AS latest_published FROM events")
def status_extremes(t, spark):
    """F16: the latest of a state, dates too far ahead left out."""
    published = F.expr("ts + make_dt_interval(cast(event_id % 9 AS INT))")
    return health.status_extremes(t("events"), F.col("ts"), published, AS_OF)


@query(f"""
WITH e AS (SELECT event_type, props, {LEVEL_SQL} AS level FROM events)
SELECT kind, value, count(*) AS n FROM (SELECT 'level' AS kind, level AS value FROM e UNION ALL SELECT 'event_type', event_type FROM e UNION ALL SELECT 'k', coalesce(CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 50 THEN json_extract_string(props, '$.k') END, 'unknown') FROM e) GROUP BY 1, 2""")
def report_statistics(t, spark):
    """histograms of several kinds in one pass."""
    k = F.get_json_object("props", "$.k")
    return health.report_statistics(t("events"), level=level(), event_type=F.col("event_type"), k=F.when(k.cast("int") < 50, k))


@query("SELECT user_id, (array_agg(event_id ORDER BY ts, event_id))[1] AS event_id FROM events WHERE event_type = 'error' GROUP BY 1")
def first_errors(t, spark):
    """the first error of each source."""
    return health.first_errors(t("events").filter("event_type = 'error'"), "user_id", "event_id", "ts", "event_id")


@query(f"SELECT count(*) FILTER (level IN ('requires_attention', 'watchlist')) AS visible_total, count(*) FILTER (level = 'requires_attention') AS requires_attention, count(*) FILTER (level = 'watchlist') AS watchlist FROM (SELECT {LEVEL_SQL} AS level FROM events)")
def interface_summary(t, spark):
    """F15."""
    return health.interface_summary(t("events"), level())


@query("SELECT x AS event_type FROM (VALUES ('click'), ('view'), ('refund'), ('transfer')) v(x) WHERE x NOT IN (SELECT event_type FROM events)")
def missing_types(t, spark):
    """Required less present."""
    return health.missing(spark, ("click", "view", "refund", "transfer"), t("events"), "event_type")


@query("""
WITH e AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events)
SELECT event_id, strftime(ts, '%H:%M') IN ('09:00', '12:30', '18:15') AND event_id % 3 <> 0 AS due, coalesce(greatest(0, 10800 - (floor(epoch(ts)) - floor(epoch(last)))), 0)::BIGINT AS wait,
CASE WHEN event_id % 5 = 0 THEN last IS NULL OR floor(epoch(ts)) - floor(epoch(last)) > 3600 WHEN event_id % 5 = 1 THEN true ELSE coalesce(floor(epoch(ts)) - floor(epoch(last)) > 3600, false) END AS takeover,
least(30.0, 2.0 * pow(2, greatest(event_id % 7 - 1, 0))) AS delay FROM e""")
def gates(t, spark):
    """A slot due once, a cooldown, a lock that may be taken over, the wait before a retry."""
    from pyspark.sql import Window

    e = t("events").select("event_id", "ts", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("last"))
    done = F.when(F.col("event_id") % 3 == 0, F.array(F.date_format("ts", "yyyy-MM-dd HH:mm"))).otherwise(F.array().cast("array<string>"))
    alive = F.when(F.col("event_id") % 5 == 1, False).when(F.col("event_id") % 5 > 1, True)
    return e.select(
        "event_id", health.slot_due(F.col("ts"), ("09:00", "12:30", "18:15"), done).alias("due"), health.cooldown_left(F.col("last"), F.col("ts")).alias("wait"),
        health.lock_stale(alive, F.col("last"), F.col("ts")).alias("takeover"), health.retry_delay(F.col("event_id") % 7, 2, 30).alias("delay"),
    )


@query("""
WITH d AS (SELECT doc_id, length(text) AS n, doc_id % 12 AS pages FROM documents)
SELECT doc_id, coalesce(doc_id % 3 = 0 AND doc_id % 5 <> 0 AND (n = 0 OR doc_id % 11 = 0 OR (pages >= 3 AND n < pages * 120)), false) AS scan, coalesce(doc_id % 3 = 0 AND doc_id % 5 <> 0 AND (n = 0 OR n < 500 OR (pages >= 3 AND n < pages * 120)), false) AS again, n > 0 OR doc_id % 4 = 0 AS refresh FROM d""")
def work_predicates(t, spark):
    """Files to recognise before and after a first reading, addresses to read again."""
    d = t("documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "PDF").otherwise("html")
    seen, n, pages = F.col("doc_id") % 5 == 0, F.length("text"), F.col("doc_id") % 12
    return d.select(
        "doc_id", filters.scan_candidate(kind, seen, n, pages, F.col("doc_id") % 11 == 0).alias("scan"), filters.scan_candidate(kind, seen, n, pages, least=500).alias("again"),
        filters.should_refresh(F.col("text"), F.when(F.col("doc_id") % 4 == 0, "active_support_measures").otherwise("strategy")).alias("refresh"),
    )


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'skipped_empty_text' WHEN 1 THEN 'skipped_low_quality' END AS reason FROM orders""")
def backfill_reasons(t, spark):
    """Empty, short without the title, short with it, short with its first words, long enough."""
    old = F.repeat(F.lit("old words of a document "), 10)
    title = F.concat(F.lit("Rules of the third fund for orders "), F.col("o_orderkey").cast("string"))
    which = F.col("o_orderkey") % 5
    new = F.when(which == 0, "  ").when(which == 1, "a short text").when(which == 2, F.concat(F.lit("see  "), F.upper(title))).when(which == 3, "rules of the third fund for all").otherwise(F.repeat(F.lit("new words "), 15))
    return t("orders").select("o_orderkey", filters.backfill_reason(old, new, title).alias("reason"))


@query("""
WITH d AS (SELECT o_orderkey, DATE '2024-01-01' + (o_orderkey % 500)::INT AS day, DATE '2023-12-01' + (o_orderkey % 40)::INT AS other, o_orderkey % 4 AS form FROM orders)
SELECT o_orderkey, strftime(CASE WHEN form = 3 THEN other ELSE day END, '%Y-%m-%d') AS deadline, CASE WHEN date_diff('day', DATE '2024-06-01', CASE WHEN form = 3 THEN other ELSE day END) < 0 THEN 'expired' WHEN date_diff('day', DATE '2024-06-01', CASE WHEN form = 3 THEN other ELSE day END) <= 14 THEN 'near' ELSE 'future' END AS status FROM d""")
def regulation_deadlines(t, spark):
    """Dates in awkward forms, the first after the end of a discussion over the last of all."""
    d = t("orders").select("o_orderkey", F.expr("date_add(DATE '2024-01-01', cast(o_orderkey % 500 AS INT))").alias("day"), F.expr("date_add(DATE '2023-12-01', cast(o_orderkey % 40 AS INT))").alias("other"), (F.col("o_orderkey") % 4).alias("form"))
    names = F.array(*map(F.lit, "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()))
    wordy = F.concat(F.day("day").cast("string"), F.lit("  "), F.element_at(names, F.month("day")), F.lit(" "), F.year("day").cast("string"))
    iso, dotted = F.date_format("day", "yyyy-MM-dd"), F.date_format("day", "d.M.yyyy")
    last = F.date_format("other", "dd/MM/yyyy")
    # 31.02.2024 is no day, 2024-1-5 and 5 мартобря are no dates here, 112.03.2024 starts in a number
    c = (
        F.when(F.col("form") == 0, F.concat(F.lit("Проект от 31.02.2024. Окончание публичного обсуждения: "), wordy, F.lit(" г., затем "), last))
        .when(F.col("form") == 1, F.concat(F.lit("Начало 2024-1-5, КОНЕЦ обсуждения 31.02.2024 или "), dotted, F.lit("; принят "), last))
        .when(F.col("form") == 2, F.concat(last, F.lit(" внесён, 5 мартобря 2024, "), iso, F.lit(" рассмотрен")))
        .otherwise(F.concat(F.lit("Завершение обсуждения "), F.repeat(F.lit("пока не названо, "), 12), iso, F.lit(" — 112.03.20245, итог "), last))
    )
    return d.select("o_orderkey", dates.regulation_deadline(c).cast("string").alias("deadline"), dates.regulation_status(c, F.lit(dt.date(2024, 6, 1))).alias("status"))


@query("""
SELECT p_partkey, 'Порядок предоставления субсидий ' || p_name AS core, lower(trim(regexp_replace('порядок елки ' || lower(p_type), '[^0-9a-zа-я]+', ' ', 'g'))) AS key FROM part""")
def order_titles(t, spark):
    """K5, K6: the core of an order's title; a text as the topic rules see it."""
    quoted = F.concat(F.lit("№ 12-3 от 1.2.2024 Об утверждении «Положения» и «Порядок предоставления субсидий "), F.col("p_name"), F.lit("», в соответствии с законом"))
    plain = F.concat(F.lit(" Об утверждении Порядок предоставления субсидий "), F.col("p_name"), F.lit(" на основании приказа 5"))
    title = F.when(F.col("p_partkey") % 2 == 0, quoted).otherwise(F.regexp_replace(plain, "Об утверждении ", "№ 77 "))
    return t("part").select("p_partkey", text.order_core(title).alias("core"), text.ontology_text(F.lit(" Порядок"), F.lit(None), F.lit("№ ёлки:"), F.col("p_type")).alias("key"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 4 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events")
def answers_json(t, spark):
    """The object of an answer that is whole, fenced, amid words, or none."""
    which, p = F.col("event_id") % 5, F.col("props")
    c = F.when(which == 0, p).when(which == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(which == 2, F.concat(F.lit("Here: "), p, F.lit(" as asked"))).when(which == 3, F.concat(F.lit(" \n"), p, F.lit(" "))).otherwise("no {object")
    return t("events").select("event_id", F.get_json_object(text.json_object(c), "$.k").cast("int").alias("k"))


@query(r"""
WITH p AS (SELECT page_id, url, regexp_extract(regexp_extract(url, '^[^:/?#]*://[^/?#]*([^?#;]*)', 1), '([^/]*)/*$', 1) AS base FROM pages),
b AS (SELECT *, CASE WHEN base = '' THEN 'document.html' ELSE base END AS name FROM p)
SELECT page_id, CASE WHEN lower(name) LIKE '%.html' THEN name[:-6] ELSE name END || '_' || sha1(url)[:10] || '.html' AS file, (lower(url) LIKE '%.pdf' OR lower(url) LIKE '%.doc' OR lower(url) LIKE '%.docx')::INT AS direct,
CASE WHEN lower(url) LIKE '%example.com%' THEN 2 WHEN lower(url) LIKE '%example.net%' THEN 1 ELSE 0 END AS priority, CASE page_id % 4 WHEN 0 THEN 14 WHEN 1 THEN 10 ELSE 0 END AS boost FROM b""")
def file_names(t, spark):
    """Names of downloads, direct files, twins' order, what topics add."""
    family = F.when(F.col("page_id") % 4 == 0, "concessional_credit").when(F.col("page_id") % 4 == 1, "dairy").when(F.col("page_id") % 4 == 2, "other")
    sites = {"example.com": 2, "example.net": 1}
    return t("pages").select(
        "page_id", text.file_name(F.col("url"), ".html").alias("file"), health.direct_file(F.col("url")).alias("direct"), health.site_priority(F.col("url"), sites).alias("priority"), health.topic_boost(family).alias("boost")
    )


@query("""
SELECT period, count(*) AS n FROM (SELECT 'вчера, 30.01.2024' AS period FROM events WHERE ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31' UNION ALL SELECT 'последние 3 дня' FROM events WHERE ts >= TIMESTAMP '2024-01-28' UNION ALL SELECT 'последние 7 дней' FROM events WHERE ts >= TIMESTAMP '2024-01-24') GROUP BY 1""")
def period_counts(t, spark):
    """Periods by name with their labels."""
    spans = [periods.period(x, AS_OF.date()) for x in ("Yesterday ", "3", "?")]
    each = F.array_compact(F.array(*(F.when(p.holds(F.col("ts")), F.lit(p.label())) for p in spans)))
    return t("events").select(F.explode(each).alias("period")).groupBy("period").agg(F.count("*").alias("n"))
