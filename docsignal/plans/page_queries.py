"""Queries over pages: listings, links, urls, titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import aggregates, latest, monitor
from ..sources import content, listing
from .registry import query

HOST_SQL = "lower(coalesce(regexp_extract(url, '^[^:]*://([^/?#]*)', 1), ''))"
PATH_SQL = "coalesce(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '')"
LABEL_SQL = f"coalesce(nullif(regexp_replace({HOST_SQL}, '^www\\.', ''), ''), 'page')"


@query(f"SELECT page_id, {HOST_SQL} AS host, {PATH_SQL} AS path, {LABEL_SQL} AS label, CASE lower(regexp_extract({PATH_SQL}, '\\.([A-Za-z0-9]{{1,5}})$', 1)) WHEN '' THEN 'html' WHEN 'html' THEN 'html' ELSE 'unknown' END AS type FROM pages")
def url_parts(t, spark):
    """C7, K19, K20."""
    u = F.col("url")
    return t("pages").select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.host_label(u, F.lit("page")).alias("label"), urls.document_type(u).alias("type"))


@query("""
SELECT page_id, lower(regexp_extract(b, '^[^:]*://[^/?]*', 0)) || regexp_replace(regexp_extract(substr(b, length(regexp_extract(b, '^[^:]*://[^/?]*', 0)) + 1), '^[^?]*', 0), '/+$', '') || regexp_extract(b, '\\?.*$', 0) AS key
FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS b FROM pages)""")
def url_canonical_key(t, spark):
    """H2."""
    return t("pages").select("page_id", urls.canonical_key(F.col("url")).alias("key"))


@query(f"SELECT {LABEL_SQL} AS value, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1 ORDER BY n DESC, first LIMIT 4")
def host_counts_topk(t, spark):
    """F9."""
    return aggregates.top_values(t("pages"), urls.host_label(F.col("url"), F.lit("page")), F.col("page_id"), 4)


@query(f"SELECT page_id, host FROM (SELECT page_id, {HOST_SQL} AS host, row_number() OVER (PARTITION BY {HOST_SQL} ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def first_of_host(t, spark):
    """G4."""
    p = t("pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return latest.first_wins(p, F.col("host"), F.col("page_id")).select("page_id", "host")


@query(f"""
WITH p AS (SELECT page_id, {LABEL_SQL} AS title, regexp_extract({PATH_SQL}, '^/([a-z]*)/', 1) AS a, {PATH_SQL} AS b FROM pages),
w AS (SELECT *, count(*) OVER w AS n, count(nullif(a, '')) OVER w AS na, count(nullif(b, '')) OVER w AS nb FROM p WINDOW w AS (PARTITION BY title)),
d AS (SELECT title, count(DISTINCT nullif(a, '')) AS da, count(DISTINCT nullif(b, '')) AS db FROM p GROUP BY 1)
SELECT page_id, CASE WHEN n > 1 AND na = n AND da = n THEN a WHEN n > 1 AND nb = n AND db = n THEN b END AS suffix, CASE WHEN n > 1 AND na = n AND da = n THEN 'lang' WHEN n > 1 AND nb = n AND db = n THEN 'path' END AS suffix_kind,
concat_ws(' — ', title, CASE WHEN n > 1 AND na = n AND da = n THEN a WHEN n > 1 AND nb = n AND db = n THEN b END) AS shown FROM w JOIN d USING (title)""")
def title_collisions(t, spark):
    """G9."""
    p = t("pages").select("page_id", urls.host_label(F.col("url"), F.lit("page")).alias("title"), "url")
    kinds = [("lang", F.regexp_extract(urls.path(F.col("url")), "^/([a-z]*)/", 1)), ("path", urls.path(F.col("url")))]
    return latest.collisions(p, "title", kinds).select("page_id", "suffix", "suffix_kind", "shown")


LINKS_SQL = r"SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)) AS title FROM pages"


@query(f"SELECT page_id, href, title, count(*) AS n FROM ({LINKS_SQL}) GROUP BY ALL")
def page_links(t, spark):
    """A3: anchors of listings, by a parser."""
    return listing.links(t("pages")).groupBy("page_id", "href", "title").agg(F.count("*").alias("n"))


@query(f"""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN trim(title) = '' THEN 'empty_title' WHEN title IN ('the', 'de', 'der') THEN 'stop_title' WHEN regexp_matches(title, '^[0-9]{{1,3}}$') THEN 'page_number' WHEN contains(lower(href), 'th') OR contains(lower(href), 'que') THEN 'denied' ELSE 'kept' END AS reason FROM ({LINKS_SQL})) GROUP BY 1""")
def link_filter_reasons(t, spark):
    """Why links are dropped, counted."""
    links = listing.links(t("pages"))
    reason = monitor.read_filters(F.concat(F.lit("http://"), urls.host(F.col("url")), F.col("href")), F.col("title"), urls.host(F.col("url")), [], ["the", "de", "der"])
    denied = F.contains(F.lower("href"), F.lit("th")) | F.contains(F.lower("href"), F.lit("que"))
    return links.select(F.coalesce(reason, F.when(denied, "denied"), F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""
WITH l AS (SELECT page_id, href, row_number() OVER (PARTITION BY page_id, href ORDER BY title) AS k, title FROM ({LINKS_SQL})), d AS (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY href) AS place FROM l WHERE k = 1)
SELECT page_id, count(*) AS n, list(href ORDER BY place) FILTER (WHERE place <= 2) AS samples FROM d GROUP BY 1""")
def reason_samples(t, spark):
    """Counts with at most two samples each."""
    distinct = listing.links(t("pages")).select("page_id", "href").dropDuplicates()
    return aggregates.samples(distinct, ["page_id"], "href", 2, F.col("href"))


@query(None)
def page_text(t, spark):
    """All text of a page without noise elements."""
    return listing.texts(t("pages")).select("page_id", "text", F.length("text").alias("n_chars"))


@query(f"""
SELECT page_id, strftime(try_strptime(CASE WHEN regexp_matches(url, '/(20[0-9]{{2}})/([0-9]{{1,2}})/([0-9]{{1,2}})(/|$)') THEN regexp_extract(url, '/(20[0-9]{{2}}/[0-9]{{1,2}}/[0-9]{{1,2}})(/|$)', 1) END, '%Y/%m/%d'), '%Y-%m-%d') AS day
FROM (SELECT page_id, replace({PATH_SQL}, '/en/', '/2024/' || (page_id % 14)::VARCHAR || '/') AS url FROM pages)""")
def url_dates(t, spark):
    """A date in the path; an impossible one gives null."""
    from ..functions import dates

    u = F.replace(urls.path(F.col("url")), F.lit("/en/"), F.concat(F.lit("/2024/"), (F.col("page_id") % 14).cast("string"), F.lit("/")))
    has = u.rlike(r"/(20\d{2})/(\d{1,2})/(\d{1,2})(/|$)")
    return t("pages").select("page_id", F.when(has, dates.date_from_url(u)).cast("string").alias("day"))


@query(None)
def page_content(t, spark):
    """K9: the main content of every page by scored elements, and its quality. tests/test_content.py compares it with a walk over trees."""
    return content.content(t("pages"), content.MARKET).select("page_id", "quality", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
