"""Queries over events and the star-schema tables: users stand for sources, event types for signals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import aggregates, caps, filters, joins, latest, monitor, state
from .registry import query

AS_OF = dt.datetime(2024, 1, 31)
LEVEL_SQL = "CASE WHEN event_type = 'error' AND value >= 50 THEN 'requires_attention' WHEN event_type = 'purchase' THEN 'watchlist' WHEN event_type IN ('view', 'click') THEN 'background' ELSE 'irrelevant' END"
POINTS_SQL = "CASE level WHEN 'requires_attention' THEN 4 WHEN 'watchlist' THEN 3 WHEN 'background' THEN 2 WHEN 'irrelevant' THEN 1 ELSE 0 END"


def level():
    return F.expr(LEVEL_SQL)


def points():
    return F.expr(POINTS_SQL)


@query(f"""
WITH recent AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31'),
one AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM recent),
levelled AS (SELECT event_id, user_id, event_type, value, {LEVEL_SQL} AS level FROM one WHERE n = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY value DESC, event_id) AS place, count(*) OVER (PARTITION BY level) AS n FROM levelled)
SELECT event_id, user_id, event_type, value, level, place::INT AS place, greatest(n - 5, 0)::BIGINT AS left_out FROM placed WHERE place <= 5""")
def signal_digest(t, spark):
    """D1, G1, decision list, H9, G8: the latest signal per key of the last week, levelled, capped per level with what is left out."""
    recent = filters.rolling(t("events"), F.col("ts"), AS_OF, 7).filter(F.col("ts") < F.lit(AS_OF))
    one = latest.latest_row(recent, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("event_id", "user_id", "event_type", "value", level().alias("level"))
    return caps.bucket_caps(one, "level", dict.fromkeys(("requires_attention", "watchlist", "background", "irrelevant"), 5), F.desc("value"), F.col("event_id")).select("event_id", "user_id", "event_type", "value", "level", "place", "left_out")


@query("SELECT e.event_id, e.event_type FROM events e JOIN (SELECT event_type, max(ts) AS ts FROM events GROUP BY event_type) m ON e.event_type = m.event_type AND e.ts = m.ts")
def latest_per_key_ties(t, spark):
    return latest.latest_rows(t("events"), ["event_type"], "ts").select("event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key_row(t, spark):
    return latest.latest_row(t("events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("""
SELECT event_id, user_id FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events)
WHERE event_type <> 'error' OR seen <= 1""")
def running_flag_limit(t, spark):
    return latest.running_limit(t("events"), F.col("event_type") == "error", ["user_id"], 1, F.col("ts"), F.col("event_id")).select("event_id", "user_id")


@query("""
SELECT event_id, user_id, old, event_type AS new FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events) WHERE old IS NOT NULL AND old <> event_type""")
def status_changes(t, spark):
    return latest.changes(t("events"), ["user_id"], "event_type", F.col("ts"), F.col("event_id")).select("event_id", "user_id", "old", "new")


@query(f"""
WITH e AS (SELECT event_id, value, {LEVEL_SQL} AS level FROM events), u AS (SELECT count(*) AS n FROM e WHERE level = 'requires_attention')
SELECT event_id, level FROM e WHERE level = 'requires_attention'
UNION ALL SELECT event_id, level FROM (SELECT *, row_number() OVER (ORDER BY {POINTS_SQL} DESC, value DESC, event_id) AS place FROM e WHERE level <> 'requires_attention') WHERE place <= (SELECT greatest(1500 - n, 0) FROM u)""")
def budget_exempt_first(t, spark):
    e = t("events").select("event_id", "value", level().alias("level"))
    return caps.exempt_budget(e, F.col("level") == "requires_attention", 1500, points().desc(), F.desc("value"), F.col("event_id")).select("event_id", "level")


@query(f"""
WITH e AS (SELECT event_id, value, {LEVEL_SQL} AS level, event_type AS section FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY value DESC, event_id) AS place FROM e)
SELECT event_id, CASE WHEN level = 'requires_attention' AND place > 5 THEN 'overflow' ELSE section END AS section, (level = 'requires_attention' AND place > 5) AS routed FROM r""")
def urgent_cap_route(t, spark):
    e = t("events").select("event_id", "value", level().alias("level"), F.col("event_type").alias("section"))
    return caps.urgent_cap(e, F.col("level") == "requires_attention", 5, "section", F.lit("overflow"), "event_id", F.desc("value"), F.col("event_id")).select("event_id", "section", "routed")


@query("""
WITH w AS (SELECT *, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id) AS used, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 1 ELSE 0 END DESC, value DESC, event_id) AS place FROM events)
SELECT event_id, user_id, place::INT AS place FROM w WHERE event_type = 'error' OR place <= greatest(6, used)""")
def shared_cap_exempt(t, spark):
    return caps.shared_cap(t("events"), "user_id", F.col("event_type") == "error", 6, F.desc("value"), F.col("event_id")).select("event_id", "user_id", "place")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def calendar_day(t, spark):
    return filters.on_day(t("events"), F.col("ts"), dt.date(2024, 1, 10)).select("event_id")


@query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND event_type IN ('error', 'purchase') AND value >= 10")
def rolling_window(t, spark):
    return filters.where(filters.rolling(t("events"), F.col("ts"), AS_OF, 7), event_type=["error", "purchase"], user_id=None).filter("value >= 10").select("event_id", "value")


@query("""
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE value >= 50) AS large,
count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*) AS noisy_ratio FROM events GROUP BY user_id""")
def source_diagnostics(t, spark):
    e = F.col("event_type")
    return aggregates.counts(t("events"), ["user_id"], errors=e == "error", purchases=e == "purchase", large=F.col("value") >= 50).withColumn("noisy_ratio", aggregates.ratio("errors", "total"))


@query(f"""
SELECT coalesce(level, 'irrelevant') AS level, count(*) AS n FROM (SELECT CASE WHEN event_type = 'signup' THEN NULL ELSE {LEVEL_SQL} END AS level FROM events) GROUP BY 1""")
def level_totals(t, spark):
    """a row without a level counts as irrelevant in totals (but not in rows by source)."""
    got = t("events").select(F.when(F.col("event_type") != "signup", level()).alias("level"))
    return got.groupBy(F.coalesce("level", F.lit("irrelevant")).alias("level")).agg(F.count("*").alias("n"))


@query("""
SELECT user_id, floor(epoch(max(ts)))::BIGINT AS last_attempt, floor(epoch(max(CASE WHEN event_type <> 'error' THEN ts END)))::BIGINT AS last_success,
max(CASE WHEN event_type <> 'error' THEN ts END) IS NULL OR max(ts) > max(CASE WHEN event_type <> 'error' THEN ts END) AS failed,
max(CASE WHEN event_type <> 'error' THEN ts END) IS NULL OR max(CASE WHEN event_type <> 'error' THEN ts END) < TIMESTAMP '2024-01-29' AS stale FROM events GROUP BY user_id""")
def source_health(t, spark):
    e = t("events").withColumn("ok_ts", F.when(F.col("event_type") != "error", F.col("ts")))
    got = aggregates.health(e, "user_id", "ts", "ok_ts", AS_OF, 2)
    return got.withColumns({c: F.unix_timestamp(F.col(c).cast("timestamp")) for c in ("last_attempt", "last_success")})


@query("""
SELECT day, event_type, sum(n)::BIGINT AS n FROM (SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL
UNION ALL SELECT ts::DATE::VARCHAR, event_type, count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-14 12:00:00' GROUP BY ALL) GROUP BY ALL""")
def telemetry_merge(t, spark):
    """running counts of two runs (which overlap by half a day) added up without loss."""
    part = lambda c: t("events").filter(c).groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return aggregates.merged(part(F.col("ts") < F.lit(dt.datetime(2024, 1, 15))), part(F.col("ts") >= F.lit(dt.datetime(2024, 1, 14, 12))), ["day", "event_type"], ["n"])


@query("SELECT event_type AS value, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1 ORDER BY n DESC, first LIMIT 3")
def counter_topk(t, spark):
    return aggregates.top_values(t("events"), F.col("event_type"), F.col("event_id"), 3)


@query("""
SELECT CASE WHEN e > 0 THEN 'error' WHEN w > 20 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN e > 0 THEN 'errors seen' WHEN w > 20 THEN 'busy' ELSE 'quiet' END AS message
FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND value > 90) AS e, count(*) AS w FROM events GROUP BY 1) GROUP BY ALL""")
def notice_union(t, spark):
    """Threshold checks of several producers, distinct and in order of severity."""
    c = aggregates.counts(t("events"), ["user_id"], e=(F.col("event_type") == "error") & (F.col("value") > 90)).withColumn("key", F.col("user_id"))
    parts = [
        aggregates.warnings(c, [("error", "errors seen", F.col("e") > 0)]),
        aggregates.warnings(c, [("warning", "busy", (F.col("e") == 0) & (F.col("total") > 20))]),
        aggregates.warnings(c, [("info", "quiet", (F.col("e") == 0) & (F.col("total") <= 20))]),
    ]
    return aggregates.notices(parts, ("error", "warning", "info"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events WHERE event_type IN ('click', 'error', 'purchase') GROUP BY 1")
def outcome_pivot(t, spark):
    kinds = ["click", "error", "purchase"]
    return t("events").filter(F.col("event_type").isin(*kinds)).groupBy("user_id").pivot("event_type", kinds).count().na.fill(0)


@query("SELECT user_id, day, state, alert FROM (SELECT *, state = 'alerted' AND coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY day), 'ok') = 'ok' AS alert FROM (SELECT user_id, ts::DATE::VARCHAR AS day, CASE WHEN count(*) FILTER (WHERE event_type <> 'error') = 0 THEN 'alerted' ELSE 'ok' END AS state FROM events GROUP BY 1, 2))")
def alert_hysteresis(t, spark):
    """A day on which all of a source's events failed alerts once, until a good day."""
    days = t("events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg((F.count_if(F.col("event_type") != "error") == 0).alias("down"))
    return monitor.hysteresis(days, F.col("down"), "user_id", F.col("day")).select("user_id", "day", "state", "alert")


@query("SELECT day, event_id FROM (SELECT ts::DATE::VARCHAR AS day, event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase') WHERE n = 1")
def once_per_day(t, spark):
    bought = t("events").filter("event_type = 'purchase'")
    return monitor.once_per_day(bought, F.to_date("ts"), F.col("ts"), F.col("event_id")).select(F.to_date("ts").cast("string").alias("day"), "event_id")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN (props->>'$.k')::BIGINT >= 5 THEN 'high' ELSE 'low' END AS grade FROM events")
def props_json(t, spark):
    """A typed struct from JSON text; bad JSON gives null."""
    k = F.from_json("props", "k long")["k"]
    return t("events").select("event_id", k.alias("k"), F.when(k >= 5, "high").otherwise("low").alias("grade"))


@query("SELECT event_id, user_id::VARCHAR AS u, event_type AS e, '{\"e\":\"' || event_type || '\",\"u\":' || user_id || '}' AS packed FROM events")
def kv_details(t, spark):
    """L2, L4: `k=v; k=v` text to a map, and a struct to JSON with its keys in order."""
    text = F.concat(F.lit("u="), F.col("user_id"), F.lit("; e="), F.col("event_type"))
    m = F.str_to_map(text, F.lit(r";\s*"), F.lit("="))
    packed = F.to_json(F.struct(F.col("event_type").alias("e"), F.col("user_id").alias("u")), {"ignoreNullFields": "false"})
    return t("events").select("event_id", m["u"].alias("u"), m["e"].alias("e"), packed.alias("packed"))


@query("SELECT event_id, sha256(coalesce(event_type, '') || '||' || coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE user_id END::VARCHAR, '') || '||' || coalesce(props, '')) AS status_hash FROM events")
def tracking_hash(t, spark):
    return t("events").select("event_id", monitor.status_hash(F.col("event_type"), F.when(F.col("event_type") != "view", F.col("user_id")), F.col("props")).alias("status_hash"))


@query("""
SELECT o_orderkey, coalesce(n, 0) AS n FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) l ON l_orderkey = o_orderkey""")
def left_preserve_unmatched(t, spark):
    n = t("lineitem").filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return t("orders").filter("o_totalprice > 200000").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 350000)")
def not_audited(t, spark):
    """An anti join."""
    return joins.not_in(t("customer").select("c_custkey"), t("orders").filter("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def visible_unresolved(t, spark):
    """A semi join."""
    big = t("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.only_in(t("customer").select("c_custkey", "c_name"), big, ["c_custkey"])


@query("""
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type = 'error'""")
def unresolved_latest(t, spark):
    """First the newest row, then the condition."""
    return joins.unresolved(t("events"), "user_id", "event_id", F.col("event_type") == "error").select("user_id", "event_id")


@query("""
SELECT s_suppkey, CASE WHEN n IS NULL THEN 'NO DATA' WHEN n >= 5 THEN 'ok' ELSE 'thin' END AS status FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_discount > 0.09 GROUP BY 1) ON l_suppkey = s_suppkey""")
def source_coverage(t, spark):
    n = t("lineitem").filter("l_discount > 0.09").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return joins.coverage(t("supplier").select("s_suppkey"), n, "s_suppkey", F.when(F.col("n") >= 5, "ok").otherwise("thin")).select("s_suppkey", "status")


@query("""
WITH f AS (SELECT l_suppkey AS s, l_returnflag AS f, count(*) AS found, count(*) FILTER (WHERE l_linestatus = 'F') AS existing FROM lineitem GROUP BY ALL), a AS (SELECT l_suppkey AS s, l_returnflag AS f, count(*) AS audited FROM lineitem WHERE l_quantity <= 25 GROUP BY ALL)
SELECT s, f, found, existing, coalesce(audited, 0) AS audited, greatest(found - coalesce(audited, 0), 0) AS gap, least(greatest(found - coalesce(audited, 0), 0), existing) AS gap_existing, greatest(found - coalesce(audited, 0), 0) - least(greatest(found - coalesce(audited, 0), 0), existing) AS gap_new FROM f LEFT JOIN a USING (s, f)""")
def audit_gap(t, spark):
    li = t("lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f"), "l_linestatus", "l_quantity")
    found = li.groupBy("s", "f").agg(F.count("*").alias("found"), F.count_if(F.col("l_linestatus") == "F").alias("existing"))
    return joins.audit_gap(found, li.filter("l_quantity <= 25").groupBy("s", "f").agg(F.count("*").alias("audited")), ["s", "f"])


@query("""
WITH sel AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000), ren AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 150000)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderkey NOT IN (SELECT o_orderkey FROM sel) THEN 'selection' ELSE 'limit' END AS reason FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ren)""")
def suppression_reasons(t, spark):
    o = t("orders")
    got = joins.suppression(o, o.filter("o_totalprice > 100000"), o.filter("o_totalprice > 150000"), "o_orderkey", [("pending", F.col("o_orderstatus") == "P")])
    return got.select("o_orderkey", "reason")


@query("""
SELECT k, min(part)::INT AS part FROM (SELECT c_nationkey AS k, 0 AS part FROM customer UNION ALL SELECT s_nationkey, 1 FROM supplier UNION ALL SELECT n_nationkey, 2 FROM nation) GROUP BY 1""")
def recipients_union(t, spark):
    """A union in order, each key once where it came first."""
    parts = [t("customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("at")), t("supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("at")), t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").alias("at"))]
    return joins.union_distinct(parts, "k", "at").select("k", "part")


OLD = "SELECT user_id AS k, max(value) AS v, min(event_type) AS note, min(event_id) AS created FROM events WHERE ts < TIMESTAMP '2024-01-15' AND user_id % 3 <> 0 GROUP BY 1"
NEW = "SELECT user_id AS k, min(value) AS v, max(event_type) AS note, max(event_id) AS created FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND user_id % 3 <> 1 GROUP BY 1"


def _two(t):
    def part(where, v, note, created):
        return t("events").filter(where).groupBy(F.col("user_id").alias("k")).agg(v("value").alias("v"), note("event_type").alias("note"), created("event_id").alias("created"))

    cut = F.lit(dt.datetime(2024, 1, 15))
    return part((F.col("ts") < cut) & (F.col("user_id") % 3 != 0), F.max, F.min, F.min), part((F.col("ts") >= cut) & (F.col("user_id") % 3 != 1), F.min, F.max, F.max)


@query(f"WITH a AS ({OLD}), b AS ({NEW}) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN a.v ELSE b.v END AS v, CASE WHEN a.k IS NULL THEN b.note ELSE a.note END AS note, CASE WHEN a.k IS NULL THEN b.created ELSE a.created END AS created FROM a FULL JOIN b ON a.k = b.k")
def upsert_keep_status(t, spark):
    """Conflicts refresh some columns and keep others."""
    old, new = _two(t)
    return state.upsert(old, new, ["k"], keep_old=["note", "created"])


@query(f"WITH a AS ({OLD}), b AS ({NEW}) SELECT a.k, coalesce(CASE WHEN a.v > 95 THEN NULL ELSE a.v END, b.v) AS v, a.note, a.created FROM a LEFT JOIN b ON a.k = b.k")
def fill_missing(t, spark):
    """Set only where null."""
    old, new = _two(t)
    return state.fill_null(old.withColumn("v", F.when(F.col("v") <= 95, F.col("v"))), new, "k", ["v"])


@query(f"WITH a AS ({OLD}), b AS ({NEW}) SELECT a.k, CASE WHEN b.k IS NULL THEN a.v ELSE b.v END AS v, CASE WHEN b.k IS NULL THEN a.note ELSE coalesce(CASE WHEN b.note = 'view' THEN NULL ELSE b.note END, a.note) END AS note, a.created FROM a LEFT JOIN b ON a.k = b.k")
def overwrite_analysis(t, spark):
    """Matched rows take new columns, some only where the new value is known."""
    old, new = _two(t)
    return state.overwrite(old, new.withColumn("note", F.when(F.col("note") != "view", F.col("note"))), "k", ["v", "note"], keep_if_null=["note"])


@query(f"WITH a AS ({OLD}), b AS ({NEW}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a)")
def append_if_new(t, spark):
    """B1, E5."""
    return state.append_new(*_two(t), "k")


@query(f"WITH a AS ({OLD}), b AS ({NEW}) SELECT k, v, note, created FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY created DESC) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE n = 1")
def last_write_wins(t, spark):
    """B12, B14."""
    return state.last_write(*_two(t), ["k"], "created")


@query(f"WITH a AS ({OLD}), b AS ({NEW}) SELECT k, v, CASE WHEN k IN (SELECT k FROM b) THEN 'notified' ELSE note END AS note, created FROM a WHERE NOT (v < 60)")
def mark_and_delete(t, spark):
    """Delete by predicate, then set a column on a set of keys."""
    old, new = _two(t)
    return state.mark(state.delete(old, F.col("v") < 60), new, "k", "note", "notified")


@query("""
SELECT user_id AS item, event_id, concat_ws('; ', CASE WHEN old_type IS DISTINCT FROM event_type THEN 'status: ' || coalesce(old_type, '—') || ' → ' || event_type END, CASE WHEN old_props IS DISTINCT FROM props THEN 'props: ' || coalesce(old_props, '—') || ' → ' || props END) AS summary
FROM (SELECT *, lag(event_type) OVER w AS old_type, lag(props) OVER w AS old_props, lag(event_id) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE before IS NOT NULL AND (old_type <> event_type OR old_props <> props)""")
def change_events(t, spark):
    """The first sight of an item is a snapshot only; a differing hash is an event with a summary."""
    h = t("events").withColumn("hash", monitor.status_hash(F.col("event_type"), F.col("props")))
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = h.withColumns({"old_hash": F.lag("hash").over(w), "old_type": F.lag("event_type").over(w), "old_props": F.lag("props").over(w)})
    pairs = [("status", F.col("old_type"), F.col("event_type")), ("props", F.col("old_props"), F.col("props"))]
    return seen.filter(F.col("old_hash") != F.col("hash")).select(F.col("user_id").alias("item"), "event_id", monitor.change_summary(pairs).alias("summary"))
