"""Collection of items into stored documents, and the queue of documents to recognise, both over keyed stores.

An item of a known address fills the document's date if it has none and, where its source may change, renews
its text; an item of a new address is stored unless its content is. A queue row is leased before it is
worked on and goes back with a note if the work fails; a lease that ran out is work again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.store import Store

#: Sources whose pages change under one address: a fixed value.
CHANGING = "active_support_measures"


def collect_batch(batch: DataFrame, documents: Store, contents: Store, number: int, ordinal: str = "id", reset: tuple[str, ...] = (), writer: str = "collect") -> dict[str, int]:
    """Puts a batch of items into the stores. Returns how many addresses were saved, duplicate, refreshed or existing.

    Items: the documents' columns, ordinal and source_role; documents are keyed by url, contents (content_hash,
    url) by content_hash. reset: columns that a renewed text empties. Of the items of one new url the first is
    stored, later ones count as of a known url. Null urls are left out.

    Contents are committed before documents: if the batch is lost in between and comes again, its own pairs are
    told from others' by their urls.
    """
    items = batch.filter("url is not null")
    names = documents.schema.names
    stored = documents.lookup(items.select("url"))
    one = items.groupBy("url").agg(F.min_by(F.struct(*items.columns), ordinal).alias("row"))
    new = one.join(stored.select("url"), "url", "left_anti").select("row.*")
    held = contents.lookup(new.filter("content_hash is not null")).select("content_hash", F.col("url").alias("_by"))
    # of new items with one content the first is stored, whatever their urls
    least = new.filter("content_hash is not null").groupBy("content_hash").agg(F.min(ordinal).alias("_least"))
    new = new.join(held, "content_hash", "left").join(least, "content_hash", "left")
    twin = (F.col("_by") != F.col("url")) | (F.col("_least") != F.col(ordinal))
    new = new.withColumn("_outcome", F.when(twin, "duplicate").otherwise("saved"))
    saved = new.filter("_outcome = 'saved'")

    # what items bring to an address that is known or stored before them: the first date, and the last text of a source that changes
    text = F.when((F.trim(F.coalesce("raw_text", F.lit(""))) != "") & (F.col("source_role") == CHANGING), F.col(ordinal))
    day = F.when(F.col("published_at").isNotNull(), F.col(ordinal))
    brought = items.groupBy("url").agg(F.min_by("published_at", day).alias("_day"), F.max_by(F.struct("raw_text", "content_hash"), text).alias("_text"))

    def renewed(rows: DataFrame) -> DataFrame:
        rows = rows.join(brought, "url", "left")
        changed = F.col("_text").isNotNull() & ~F.col("_text.content_hash").eqNullSafe(F.col("content_hash"))
        values = {"published_at": F.coalesce("published_at", "_day")} | {c: F.when(~changed, F.col(c)) for c in reset}
        values |= {c: F.when(changed, F.col(f"_text.{c}")).otherwise(F.col(c)) for c in ("raw_text", "content_hash")}
        return rows.select(*(values.get(c, F.col(c)).alias(c) for c in names))

    inserts = saved.select(*(F.col(c) if c in saved.columns else F.lit(None).cast(documents.schema[c].dataType).alias(c) for c in names))
    known = stored.select("url", "content_hash").join(brought, "url")
    refreshed = F.col("_text").isNotNull() & ~F.col("_text.content_hash").eqNullSafe(F.col("content_hash"))
    outcomes = new.select(F.col("_outcome").alias("outcome")).unionByName(known.select(F.when(refreshed, "refreshed").otherwise("existing").alias("outcome")))
    told = {r["outcome"]: r["n"] for r in outcomes.groupBy("outcome").agg(F.count("*").alias("n")).collect()}

    pairs = saved.filter("content_hash is not null").select("content_hash", "url")
    contents.merge(pairs, lambda old, more: old.unionByName(more.join(old.select("content_hash"), "content_hash", "left_anti")), writer, number)
    documents.merge(known.select("url").unionByName(saved.select("url")), lambda old, _: renewed(old.unionByName(inserts)), writer, number)
    return told


def collected(items: DataFrame, documents: Store, contents: Store, checkpoint: str, **how):
    """Starts a stream that collects items; it ends when what is there is taken in."""

    def one(batch: DataFrame, number: int) -> None:
        collect_batch(batch, documents, contents, number, **how)

    return items.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- the queue ----------------------------------------------------------------------------------

QUEUE = "document_url string, source_name string, title string, priority string, status string, created_at timestamp, updated_at timestamp, leased_until timestamp, attempts int, notes string"
RESULT = "document_url string, ok boolean, status string, raw_text string, page_count int, error string"
PRIORITIES = ("high", "medium", "low")
#: Notes by what became of the work, and how much of an error they quote: fixed values.
NOTES = {"success": "OCR completed automatically", "unavailable": "OCR unavailable: ", "failed": "OCR failed: ", "fetch": "OCR fetch failed: "}
QUOTE = 300


def due(queue: DataFrame, now: Column) -> DataFrame:
    """Rows that wait, and those whose lease ran out."""
    return queue.filter((F.col("status") == "pending") | ((F.col("status") == "leased") & (F.col("leased_until") < now)))


def work_off(queue: Store, documents: Store, extract: Callable[[str, str], tuple[str, str | None, int | None, str | None]], now, limit: int = 10, lease_minutes: int = 30, number: int | None = None, writer: str = "recognise") -> tuple[dict[str, int], DataFrame]:
    """One round over the queue: the most urgent rows that are due, oldest first, at most `limit` of them.

    extract(url, source) gives (status, text, pages, error), status being success, unavailable or another; it
    runs in tasks, and what it raises is noted. Rows are leased before and settled after, each in one commit, so
    that a run that is lost in between leaves leases that run out. Texts of successes are put into documents
    before the queue says done. Returns counts, and the audit rows of all work, failures among them.
    """
    spark, at = queue.spark, F.lit(now).cast("timestamp")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority")), F.lit(len(PRIORITIES) + 1))
    chosen = due(queue.read(), at).orderBy(F.when(rank > 0, rank).otherwise(len(PRIORITIES) + 1), "created_at", "document_url").limit(limit).select("document_url", "source_name").collect()
    if not chosen:
        return {}, spark.createDataFrame([], RESULT)
    work = spark.createDataFrame(chosen, "document_url string, source_name string")
    until = at + F.make_interval(mins=F.lit(lease_minutes))

    def leased(old: DataFrame, mine: DataFrame) -> DataFrame:
        hit = old.join(mine.select("document_url", F.lit(True).alias("_hit")), "document_url", "left")
        new = {"status": F.lit("leased"), "leased_until": until, "attempts": F.coalesce("attempts", F.lit(0)) + 1, "updated_at": at}
        return hit.select(*((F.when(F.col("_hit"), new[c]).otherwise(F.col(c)) if c in new else F.col(c)).alias(c) for c in queue.schema.names))

    queue.merge(work, leased)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, source in zip(pdf["document_url"], pdf["source_name"], strict=True):
                try:
                    status, text, pages, error = extract(url, source)
                except Exception as e:  # whatever it is, the row goes back with it
                    status, text, pages, error = "fetch", None, None, str(e)
                ok = status == "success" and bool((text or "").strip())
                rows.append((url, ok, status if ok or status != "success" else "failed", text, pages, error))
            yield pd.DataFrame(rows, columns=["document_url", "ok", "status", "raw_text", "page_count", "error"])

    # each row a task, as work takes long; written, so that no row is worked on twice
    at_path = f"{queue.path}/rounds/{uuid.uuid4().hex}"
    work.repartition(len(chosen)).mapInPandas(run, RESULT).write.parquet(at_path)
    done = spark.read.schema(RESULT).parquet(at_path)
    texts = done.filter("ok").select(F.col("document_url").alias("url"), F.col("raw_text").alias("_text"))

    def renewed(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.join(new, "url", "left")
        values = {"raw_text": F.coalesce("_text", "raw_text"), "content_hash": F.when(F.col("_text").isNotNull(), F.sha2(F.trim("_text"), 256)).otherwise(F.col("content_hash"))}
        return both.select(*(values.get(c, F.col(c)).alias(c) for c in documents.schema.names))

    if texts.limit(1).count():
        documents.merge(texts, renewed)
    note = F.when(F.col("_ok"), NOTES["success"])
    for status, words in NOTES.items():
        if status != "success":
            note = note.when(F.col("_status") == status, F.concat(F.lit(words), F.substring(F.coalesce("_error", F.lit("")), 1, QUOTE)))
    note = note.otherwise(F.concat(F.lit(NOTES["failed"]), F.substring(F.coalesce("_error", F.lit("")), 1, QUOTE)))

    def settled(old: DataFrame, new: DataFrame) -> DataFrame:
        told = new.select("document_url", F.col("ok").alias("_ok"), F.col("status").alias("_status"), F.col("error").alias("_error"))
        both = old.join(told, "document_url", "left")
        mine = F.col("_ok").isNotNull()
        values = {"status": F.when(F.col("_ok"), "done").otherwise("pending"), "notes": note, "leased_until": F.lit(None).cast("timestamp"), "updated_at": at}
        return both.select(*((F.when(mine, values[c]).otherwise(F.col(c)) if c in values else F.col(c)).alias(c) for c in queue.schema.names))

    queue.merge(done.select("document_url", "ok", "status", "error"), settled, writer, number)
    counts = {r["status"]: r["n"] for r in done.groupBy("status").agg(F.count("*").alias("n")).collect()}
    return counts, done


def enqueue(queue: Store, rows: DataFrame, now) -> int:
    """Adds rows (document_url, source_name, title, priority); known ones keep status, dates and notes. Returns the version."""
    at = F.lit(now).cast("timestamp")
    fresh = rows.filter("trim(document_url) <> ''").groupBy("document_url").agg(*(F.first(c).alias(c) for c in ("source_name", "title", "priority")))

    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("_known", F.lit(True)).join(new.select("document_url", F.struct("source_name", "title", "priority").alias("_new")), "document_url", "full")
        given = {c: F.coalesce(f"_new.{c}", c) for c in ("source_name", "title", "priority")}
        first = {"status": F.lit("pending"), "created_at": at, "updated_at": at, "attempts": F.lit(0)}
        return both.select(*((given[c] if c in given else F.when(F.col("_known"), F.col(c)).otherwise(first[c]) if c in first else F.col(c)).alias(c) for c in queue.schema.names))

    return queue.merge(fresh, change)
