"""Queries over documents: hashes, duplicates, searches, counts by source and language, marker rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, rules, text
from ..operators import aggregates, caps, filters, joins, latest, monitor, titles
from .registry import query

#: Neutral vocabularies for the invented prose of the driver's tables.
GROUPS = {"english": ["the ", "and ", "of "], "german": ["der ", "die ", "und "], "french": ["les ", "des ", "que "], "spanish": ["los ", "una ", "por "]}
MARKERS = ["the", "and", "der", "und", "que", "por"]
TYPES = [
    rules.Rule("listing", any_of=(" | ",)),
    rules.Rule("code", any_of=("&&&", "%%%", "###")),
    rules.Rule("short", where="n_chars < 300"),
    rules.Rule("contact", any_of=("@",), none_of=("password",)),
    rules.Rule("licence", all_of=("license", "released"), none_of=("&&&",)),
    rules.Rule("long", where="n_chars > 5000"),
]
FAMILIES = [
    rules.Family("legal", "Licences", exact=("mit license",), rules=(rules.Rule("", all_of=("license",), any_of=("apache", "gnu", "public")),)),
    rules.Family("secret", "Secrets", rules=(rules.Rule("", any_of=("password=", "token = ")),), veto=("example only",)),
    rules.Family("romance", "Romance", words=("que", "por"), veto=("und",)),
]


def _has(*markers: str, how: str = " OR ") -> str:
    return "(" + how.join(f"contains(lower(text), '{m}')" for m in markers) + ")"


@query("SELECT sha256(CASE WHEN trim(text, E' \\n\\t\\r') = '' THEN doc_id::VARCHAR ELSE trim(text, E' \\n\\t\\r') END) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def content_hash_dedup(t, spark):
    """H1, S12."""
    h = monitor.content_hash(F.col("text"), F.col("doc_id").cast("string"))
    return t("documents").groupBy(h.alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("""
WITH d AS (SELECT d.doc_id, sha256(text) AS k, coalesce(quality, -1) AS q, CASE WHEN length(trim(text)) >= 5000 THEN 3 WHEN length(trim(text)) >= 1000 THEN 2 WHEN length(trim(text)) >= 100 THEN 1 ELSE 0 END AS points FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, q, points, position FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY q DESC, points DESC, doc_id) AS n, min(doc_id) OVER (PARTITION BY k) AS position FROM d) WHERE n = 1""")
def best_of_duplicates(t, spark):
    """The best row of each group of equal texts, with the place of the first."""
    d = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    d = d.select("doc_id", F.sha2("text", 256).alias("k"), F.coalesce("quality", F.lit(-1)).alias("q"), text.quality_points(F.col("text")).alias("points"))
    return latest.best_of(d, F.col("k"), [F.col("q"), F.col("points")], F.col("doc_id")).select("doc_id", "q", "points", "position")


@query("""
WITH s AS (SELECT url, h FROM (SELECT source AS url, sha256(text) AS h, doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE r % 7 = 0),
f AS (SELECT doc_id, lang || n_chars AS url, sha256(text) AS h FROM documents),
st AS (SELECT lang || n_chars AS url, sha256(text) AS h FROM documents WHERE source = 'src0'),
a AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY doc_id) AS u FROM f WHERE url NOT IN (SELECT url FROM st)),
b AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS k FROM a WHERE u = 1)
SELECT doc_id FROM b WHERE k = 1 AND h NOT IN (SELECT h FROM st)""")
def new_items(t, spark):
    """Items whose url and content are neither stored nor earlier in the run."""
    d = t("documents").select("doc_id", F.concat("lang", "n_chars").alias("url"), F.sha2("text", 256).alias("h"), "source")
    return joins.new_items(d.drop("source"), d.filter("source = 'src0'"), "url", "h", "doc_id").select("doc_id")


@query("SELECT doc_id, lang, source, place::INT AS place FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 2")
def top_per_group(t, spark):
    """G5."""
    return latest.top_per_group(t("documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], 2, F.desc("n_chars"), F.col("doc_id")).select("doc_id", "lang", "source", "place")


@query("SELECT doc_id, lang, place::INT AS place, greatest(n - cap, 0)::BIGINT AS left_out FROM (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 5 WHEN 'fr' THEN 3 ELSE 3 END AS cap, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE place <= cap")
def section_caps(t, spark):
    """Caps by section with the hidden count."""
    got = caps.bucket_caps(t("documents").select("doc_id", "lang", "n_chars"), "lang", {"en": 5, "de": 5, "fr": 3, "es": 3}, F.desc("n_chars"), F.col("doc_id"))
    return got.select("doc_id", "lang", "place", "left_out")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NULL ORDER BY d.doc_id LIMIT 50")
def work_queue(t, spark):
    """Null means not analysed yet; first in, first out."""
    d = t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return filters.unprocessed(d, "quality", 50, F.col("doc_id")).select("doc_id")


@query("SELECT doc_id FROM documents d WHERE lang IN ('de', 'fr') AND source = 'src3'")
def conjunctive_filter(t, spark):
    """D5."""
    return filters.where(t("documents"), lang=["de", "fr"], source="src3", text=None).select("doc_id")


@query(f"""
SELECT doc_id, level_points, match_points FROM (SELECT doc_id, n_chars, CASE lang WHEN 'en' THEN 2 WHEN 'de' THEN 1 ELSE 0 END AS level_points, CASE WHEN lower(source) = 'src1' THEN 3 WHEN contains(lower(source), 'src1') THEN 2 WHEN contains(lower(text), 'src1') THEN 1 ELSE 0 END AS match_points FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(text), 'src1'))
ORDER BY level_points DESC, match_points DESC, n_chars DESC, doc_id DESC LIMIT 20""")
def search_ranked(t, spark):
    """D6, H8."""
    points = F.when(F.col("lang") == "en", 2).when(F.col("lang") == "de", 1).otherwise(0)
    return filters.search(t("documents"), "SRC1", ["source", "text"], 99, points, F.desc("n_chars"), F.desc("doc_id")).select("doc_id", "level_points", "match_points")


@query("""
SELECT lang, source, grouping_id(lang, source)::BIGINT AS grouping_level, count(*) AS total, count(*) FILTER (WHERE n_chars > 2000)::BIGINT AS long, count(*) FILTER (WHERE contains(text, '%%%'))::BIGINT AS noisy FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())""")
def role_rollup(t, spark):
    """F1, F2, F3 in one pass over the grouping sets."""
    got = aggregates.rollup(t("documents").select("lang", "source", "n_chars", "text"), [["lang", "source"], ["lang"], []], long=F.col("n_chars") > 2000, noisy=F.contains("text", F.lit("%%%")))
    return got.select("lang", "source", "grouping_level", "total", "long", "noisy")


@query("""
SELECT count(*) AS total, count(*) FILTER (WHERE quality IS NULL) AS pending, count(*) FILTER (WHERE quality = 1) AS done, count(*) FILTER (WHERE quality = 0) AS skipped, count(*) FILTER (WHERE toxic = 1) AS high, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS high_done, count(DISTINCT source)::BIGINT AS sources, sum(n_chars)::BIGINT AS chars
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def queue_summary(t, spark):
    """seven counts, distinct keys and a sum in one pass."""
    d = t("documents").join(t("labels"), "doc_id", "left")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    q, x = F.col("quality"), F.col("toxic")
    return d.agg(F.count("*").alias("total"), n(q.isNull()).alias("pending"), n(q == 1).alias("done"), n(q == 0).alias("skipped"), n(x == 1).alias("high"), n((x == 1) & (q == 1)).alias("high_done"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"))


@query("SELECT source, count(*) AS n FROM documents WHERE length(trim(text)) < 300 GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def top_missing(t, spark):
    """the sources with the most documents without much text."""
    return t("documents").filter(F.length(F.trim("text")) < 300).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


@query("SELECT l.doc_id, quality, d.n_chars > 1000 AS is_long FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE toxic = 1")
def dimension_join(t, spark):
    """A lookup join."""
    return t("labels").filter("toxic = 1").join(t("documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", "quality", (F.col("n_chars") > 1000).alias("is_long"))


@query(f"SELECT doc_id, list_filter(['the', 'and', 'der', 'und', 'que', 'por'], lambda m: contains(lower(text), m)) AS hits, list_filter(['english', 'german', 'french', 'spanish'], lambda g: CASE g WHEN 'english' THEN {_has('the ', 'and ', 'of ')} WHEN 'german' THEN {_has('der ', 'die ', 'und ')} WHEN 'french' THEN {_has('les ', 'des ', 'que ')} ELSE {_has('los ', 'una ', 'por ')} END) AS groups FROM documents")
def marker_hits(t, spark):
    """K21, K22, S13."""
    c = F.col("text")
    return t("documents").select("doc_id", text.matched(c, MARKERS).alias("hits"), text.in_groups(c, GROUPS).alias("groups"))


@query(f"""
SELECT doc_id, CASE WHEN {_has(' | ')} THEN 'listing' WHEN {_has('&&&', '%%%', '###')} THEN 'code' WHEN n_chars < 300 THEN 'short' WHEN {_has('@')} AND NOT {_has('password')} THEN 'contact' WHEN {_has('license', 'released', how=' AND ')} AND NOT {_has('&&&')} THEN 'licence' WHEN n_chars > 5000 THEN 'long' ELSE 'article' END AS page_type,
CASE WHEN {_has(' | ')} THEN 1 WHEN {_has('&&&', '%%%', '###')} THEN 2 WHEN n_chars < 300 THEN 3 WHEN {_has('@')} AND NOT {_has('password')} THEN 4 WHEN {_has('license', 'released', how=' AND ')} AND NOT {_has('&&&')} THEN 5 WHEN n_chars > 5000 THEN 6 ELSE 0 END::INT AS rule FROM documents""")
def page_type(t, spark):
    """M2–M5: an ordered decision list; the first rule that holds wins."""
    return t("documents").select("doc_id", rules.decide(TYPES, F.col("text"), "article").alias("page_type"), rules.decided_by(TYPES, F.col("text")).alias("rule"))


@query(f"""
SELECT doc_id, CASE WHEN {_has('mit license')} OR ({_has('license')} AND {_has('apache', 'gnu', 'public')}) THEN 'legal' WHEN {_has('password=', 'token = ')} AND NOT {_has('example only')} THEN 'secret'
WHEN (contains(p, ' que ') OR contains(p, ' por ')) AND NOT {_has('und')} THEN 'romance' END AS family FROM (SELECT *, ' ' || regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ' AS p FROM documents)""")
def topic_match(t, spark):
    """M6, M7."""
    return t("documents").select("doc_id", rules.topic(FAMILIES, F.col("text"))["family"].alias("family"))


@query("""
SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key FROM documents""")
def normalised_text(t, spark):
    """K1, K4, S9."""
    return t("documents").select("doc_id", text.squash(F.col("text")).alias("flat"), text.key_of(F.col("text")).alias("key"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN left_ < 0 THEN 'expired' WHEN left_ = 0 THEN 'today' WHEN left_ <= 7 THEN 'near' ELSE 'future' END AS status FROM (SELECT *, date_diff('day', DATE '1995-06-15', o_orderdate::DATE) AS left_ FROM orders)""")
def deadline_classes(t, spark):
    """Dates written in three forms are read back and classed around a fixed day."""
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 3
    months = F.array(*map(F.lit, "January February March April May June July August September October November December".split()))
    written = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "d.M.yyyy")).otherwise(F.concat_ws(" ", F.day(d).cast("string"), F.element_at(months, F.month(d)), F.year(d).cast("string")))
    o = t("orders").select("o_orderkey", F.concat(F.lit("Applications until "), written, F.lit(" at the office.")).alias("text"))
    o = o.withColumn("deadline", dates.parse_deadline(F.col("text")))
    return o.select("o_orderkey", F.col("deadline").cast("string").alias("day"), dates.deadline_class(F.col("deadline"), F.to_date(F.lit("1995-06-15"))).alias("status"))


@query(None)
def similar_titles(t, spark):
    """Greedy grouping of whole first lines by similarity. Documents have no url."""
    d = t("documents").select("doc_id", text.key_of(F.regexp_extract("text", r"^[^\n]*", 0)).alias("title"))
    return titles.similar_titles(d, "doc_id", "title", None, "doc_id")


@query(None)
def summaries(t, spark):
    """Extractive summaries."""
    c = F.col("text")
    return t("documents").select("doc_id", text.summary(c, ["the ", "der ", "que "]).alias("summary"), text.clip_words(c, 120).alias("clipped"))


@query("""
SELECT doc_id, lang, facts::INT AS facts, quality_points::INT AS quality_points, urgent, (facts * 5 + quality_points + CASE WHEN urgent THEN 100 ELSE 0 END)::INT AS score FROM (SELECT d.doc_id, lang,
3 * regexp_matches(text, 'password=|token')::INT + 2 * coalesce(quality = 1, false)::INT + coalesce(toxic = 1, false)::INT + contains(text, 'License')::INT AS facts, coalesce(toxic = 1, false) AS urgent,
CASE WHEN n >= 5000 THEN 3 WHEN n >= 1000 THEN 2 WHEN n >= 100 THEN 1 ELSE 0 END AS quality_points FROM (SELECT *, length(trim(text, E' \\n\\t\\r')) AS n FROM documents) d LEFT JOIN labels l ON l.doc_id = d.doc_id)""")
def display_priority(t, spark):
    """C8–C14, M20–M22 with neutral data: scores from facts, levels and text quality, ordered for display."""
    d = t("documents").join(t("labels"), "doc_id", "left")
    points = monitor.fact_points(F.regexp_extract("text", "password=|token", 0), F.when(F.col("quality") == 1, "open").otherwise("unknown"), F.when(F.col("toxic") == 1, "active"), F.regexp_extract("text", "License", 0))
    got = d.select("doc_id", "lang", points.alias("facts"), text.quality_points(F.col("text")).alias("quality_points"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("urgent"))
    return got.withColumn("score", F.col("facts") * 5 + F.col("quality_points") + F.when(F.col("urgent"), 100).otherwise(0))
