"""Rows from API payloads: bodies of pages in, typed items out, all by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import any_of, filled, squash

PAGED = "item1 struct<items:array<struct<title:string,shortName:string,pppItemName:string,regionName:string,recipientCategoryName:string,startDate:string,endDate:string,maxAmountForPersonInfo:string,isActive:boolean,activityId:string,competitionId:string,id:string,selectionAcceptingApplicationInfo:struct<acceptingApplicationsInfo:string>>>,totalPages:int>"
AUTHORITY = "items array<struct<eoNumber:string,complexName:string,name:string,number:string,documentDate:string,publishDateShort:string,pagesCount:int>>"
FLAT = "array<struct<href:string,title:string,num:string,type:struct<title:string>,authority1:struct<title:string>,date:array<int>,id:string,pubId:string,regId:string>>"
PROJECT = "struct<_id:string,title:string,publishDate:string,startDiscussion:string,endDiscussion:string,stage:string,department:string>"
COLUMNS = ("source_name", "title", "url", "published_on", "raw_text", "document_type", "ordinal")


def lines(*parts: tuple[str, Column]) -> Column:
    """`label: value` lines, blank values left out."""
    return F.concat_ws("\n", *(F.when(filled(v.cast("string")).isNotNull(), F.concat(F.lit(f"{k}: " if k else ""), squash(v.cast("string")))) for k, v in parts))


def iso_day(c: Column) -> Column:
    return F.coalesce(F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"), dates.parse_date(c))


def relevant(text: Column, strong: list[str], support: list[str], weak: list[str]) -> Column:
    """A strong marker, or a support and a weak one together."""
    return any_of(text, strong) | (any_of(text, support) & any_of(text, weak))


def _unique(items: DataFrame, most: int | None) -> DataFrame:
    """The first row of each url in reading order, at most so many."""
    one = items.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("ordinal"))).filter("_n = 1").drop("_n")
    return one.orderBy("ordinal").limit(most) if most else one


def paged_posts(bodies: DataFrame, base: str, keep: Column | None = None, most: int | None = None) -> DataFrame:
    """source_name, page, body in: items of item1.items[]."""
    it = bodies.select("source_name", "page", F.posexplode(F.from_json("body", PAGED)["item1"]["items"]).alias("at", "i"))
    title = squash(F.coalesce(filled(F.col("i.title")), filled(F.col("i.shortName")), filled(F.col("i.pppItemName"))))
    text = lines(("", title), ("Region", F.col("i.regionName")), ("Recipients", F.col("i.recipientCategoryName")), ("Start", F.col("i.startDate")), ("End", F.col("i.endDate")), ("Amount", F.col("i.maxAmountForPersonInfo")), ("Status", F.when(F.col("i.isActive"), "active").when(~F.col("i.isActive"), "closed")), ("Applications", F.col("i.selectionAcceptingApplicationInfo.acceptingApplicationsInfo")))
    key = F.coalesce(F.col("i.activityId"), F.col("i.competitionId"), F.col("i.id"))
    out = it.select("source_name", title.alias("title"), F.concat(F.lit(base), key).alias("url"), iso_day(F.col("i.startDate")).alias("published_on"), text.alias("raw_text"), F.lit("html").alias("document_type"), (F.col("page") * 1_000_000 + F.col("at")).cast("long").alias("ordinal")).filter("title is not null and url is not null")
    return _unique(out.filter(keep) if keep is not None else out, most)


def by_authority(bodies: DataFrame, base: str, most: int) -> DataFrame:
    """source_name, authority, body in: items with a quota of max(10, most / authorities) each."""
    it = bodies.select("source_name", "authority", F.posexplode(F.from_json("body", AUTHORITY)["items"]).alias("at", "i"))
    title = squash(F.coalesce(filled(F.col("i.complexName")), filled(F.col("i.name"))))
    text = lines(("", title), ("Number", F.col("i.number")), ("Date", F.col("i.documentDate")), ("Published", F.col("i.publishDateShort")), ("Pages", F.col("i.pagesCount")))
    n = bodies.select("authority").distinct().count()
    out = it.select("source_name", "authority", title.alias("title"), F.concat(F.lit(base), F.col("i.eoNumber")).alias("url"), iso_day(F.coalesce("i.publishDateShort", "i.documentDate")).alias("published_on"), text.alias("raw_text"), F.lit("pdf").alias("document_type"), F.col("at").cast("long").alias("ordinal")).filter("title is not null and url is not null")
    quota = max(10, most // max(1, n))
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("authority").orderBy("ordinal", "url"))).filter(F.col("_n") <= quota).drop("_n", "authority")


def flat_list(bodies: DataFrame, base: str, since: Column | None = None) -> DataFrame:
    """source_name, body in: items of a plain array; dates are [y, m, d]. since: the first day wanted."""
    it = bodies.select("source_name", F.posexplode(F.from_json("body", FLAT)).alias("at", "i"))
    day = dates.from_array(F.col("i.date"))
    title = squash(F.concat_ws(" ", F.col("i.type.title"), F.when(filled(F.col("i.num")).isNotNull(), F.concat(F.lit("№ "), F.col("i.num"))), F.col("i.title")))
    text = lines(("", title), ("Authority", F.col("i.authority1.title")), ("Date", day), ("Publication", F.col("i.pubId")), ("Registration", F.col("i.regId")))
    out = it.select("source_name", title.alias("title"), F.coalesce(filled(F.col("i.href")), F.concat(F.lit(base), F.col("i.id"))).alias("url"), day.alias("published_on"), text.alias("raw_text"), F.lit("html").alias("document_type"), F.col("at").cast("long").alias("ordinal"))
    out = _unique(out.filter("url is not null"), None)
    return out.filter(F.col("published_on").isNull() | (F.col("published_on") >= since)) if since is not None else out


def xml_projects(bodies: DataFrame, base: str) -> DataFrame:
    """source_name, page, body in: the `project` elements of an XML page."""
    one = F.regexp_extract_all("body", F.lit(r"(?s)<project\b.*?</project>"), F.lit(0))
    it = bodies.select("source_name", "page", F.posexplode(one).alias("at", "x"))
    it = it.withColumn("i", F.from_xml("x", PROJECT))
    text = lines(("", F.col("i.title")), ("Department", F.col("i.department")), ("Stage", F.col("i.stage")), ("Start of discussion", F.col("i.startDiscussion")), ("End of discussion", F.col("i.endDiscussion")))
    return it.select("source_name", squash(F.col("i.title")).alias("title"), F.concat(F.lit(base), F.col("i._id")).alias("url"), iso_day(F.col("i.publishDate")).alias("published_on"), text.alias("raw_text"), F.lit("html").alias("document_type"), (F.col("page") * 1_000_000 + F.col("at")).cast("long").alias("ordinal")).filter("title is not null and url is not null")


def with_details(items: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Items with a lookup's fields where there is one: details has key, detail_text and published_on."""
    d = details.select(key, "detail_text", F.col("published_on").alias("_day"))
    return items.join(d, key, "left").withColumns({"raw_text": F.concat_ws("\n", "raw_text", F.substring("detail_text", 1, 4000)), "published_on": F.coalesce("published_on", "_day")}).drop("_day", "detail_text")
