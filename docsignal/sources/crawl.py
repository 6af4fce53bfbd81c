"""A bounded crawl in rounds: listings and their next pages are visited, what they link to is harvested.

The frontier of a round is an anti join of new links against all addresses seen so far. A host gives at most
so many pages in all; which ones follows from depth and address, so that reruns agree. A host that answered
with server errors so often without a success in between is left alone from the next round on. Rounds are
cut by reliable checkpoints; what reaches the driver is whether a round is empty.

How a page is fetched is a function of a table of addresses, so that a local table of pages does as well as
requests from tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..session import cut
from . import listing

VISIT = "key string, url string, host string, round int, status int, found string"


def from_table(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetch that looks addresses up in a table (url, html, and status if there is one); what is not there answers 404."""
    known = pages.select(urls.canonical_key(F.col("url")).alias("key"), F.col("status").cast("int").alias("status") if "status" in pages.columns else F.lit(200).alias("status"), "html").dropDuplicates(["key"])
    return lambda frontier: frontier.join(known, "key", "left").select("key", "url", F.coalesce("status", F.lit(404)).alias("status"), "html")


def linked(pages: DataFrame) -> DataFrame:
    """base, href's absolute address, its key, title and place, of pages (url, html)."""
    numbered = pages.select(F.lit(0).cast("long").alias("page_id"), "url", "html")
    found = listing.links(numbered).select(F.col("url").alias("base"), F.col("absolute").alias("url"), "title", "ordinal")
    return found.filter("url rlike '^https?://'").withColumn("key", urls.canonical_key(F.col("url"))).filter("key is not null")


def crawl(
    seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], follow: Callable[[Column, Column, Column], Column], harvest: Callable[[Column, Column, Column], Column], rounds: int = 5, per_host: int = 50, failures: int = 3
) -> tuple[DataFrame, DataFrame]:
    """(visits, items) from seeds (url).

    follow and harvest say of a link's address, title and the page it stands on whether it is visited, and
    whether it is an item. visits: key, url, host, round (from 0), status. items: key, url, title, base, round,
    document_type, each address once: of the earliest round, then the first base and place. Null seeds are left out.
    """
    frontier = seeds.select("url", urls.canonical_key(F.col("url")).alias("key")).filter("key is not null").groupBy("key").agg(F.min("url").alias("url"))
    visits = items = None
    # of one host, how many visits there were and how many errors since the last round with a success
    spent = None
    for n in range(rounds):
        todo = frontier.withColumn("host", urls.host(F.col("url")))
        if visits is not None:
            todo = todo.join(visits.select("key"), "key", "left_anti").join(spent, "host", "left")
            todo = todo.filter(F.coalesce("errors", F.lit(0)) < failures).withColumn("left_", per_host - F.coalesce("n", F.lit(0)))
        else:
            todo = todo.withColumn("left_", F.lit(per_host))
        ranked = todo.withColumn("rank_", F.row_number().over(Window.partitionBy("host").orderBy("key")))
        # the first bound is a constant, so that Spark keeps that many rows a host before they move
        todo = ranked.filter(F.col("rank_") <= per_host).filter("rank_ <= left_").select("key", "url", "host")
        got = cut(fetch(todo).withColumns({"host": urls.host(F.col("url")), "round": F.lit(n)}))
        if not got.limit(1).count():
            break
        here = got.select("key", "url", "host", "round", "status")
        visits = here if visits is None else cut(visits.unionByName(here))
        links = cut(linked(got.filter("status < 400 and html is not null").select("url", "html")))
        as_ = lambda f: F.coalesce(f(F.col("url"), F.col("title"), F.col("base")), F.lit(False))
        fresh = links.filter(as_(harvest)).groupBy("key").agg(F.min_by(F.struct("url", "title", "base"), F.struct("base", "ordinal")).alias("l")).select("key", "l.*", F.lit(n).alias("round"))
        items = fresh if items is None else cut(items.unionByName(fresh.join(items.select("key"), "key", "left_anti")))
        frontier = links.filter(as_(follow)).groupBy("key").agg(F.min("url").alias("url"))
        by_round = visits.groupBy("host", "round").agg(F.count("*").alias("n"), F.count_if(F.col("status") >= 500).alias("bad"), F.count_if(F.col("status") < 500).alias("good"))
        last_good = F.coalesce(F.max(F.when(F.col("good") > 0, F.col("round"))).over(Window.partitionBy("host")), F.lit(-1))
        spent = by_round.withColumn("last", last_good).groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("round") > F.col("last"), F.col("bad")).otherwise(0)).alias("errors"))
    spark = seeds.sparkSession
    if visits is None:
        visits = spark.createDataFrame([], "key string, url string, host string, round int, status int")
        items = spark.createDataFrame([], "key string, url string, title string, base string, round int")
    return visits, items.withColumn("document_type", urls.document_type(F.col("url")))


def next_page(url: Column, title: Column, base: Column) -> Column:
    """A link to a further page of the listing it stands on: the same host and path, a page number in the query."""
    return (urls.host(url) == urls.host(base)) & (urls.path(url) == urls.path(base)) & url.rlike(r"(?i)[?&](?:page|PAGEN_\d+|p)=\d+")


def attachment(kinds: tuple[str, ...] = ("pdf", "doc", "docx", "xls", "xlsx", "zip")) -> Callable[[Column, Column, Column], Column]:
    """Links to files of the kinds."""
    return lambda url, title, base: urls.document_type(url).isin(*kinds)
