import datetime as dt

import pytest
from pyspark.sql import functions as F

from docsignal.operators import state
from docsignal.operators.store import CommitConflict, Store
from docsignal.streaming import collect

SCHEMA = "k long, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def upserted(old, new):
    return state.upsert(old, new, ["k"])


def test_a_batch_rewrites_its_buckets_alone(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s", ["k"], SCHEMA, buckets=16)
    assert rows(s.read()) == [] and s.commit()["version"] == 0
    s.merge(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v")), upserted)
    before = s.commit()["folders"]
    assert len(before) == 16
    delta = spark.createDataFrame([(5, "b"), (500, "c")], SCHEMA)
    touched = s.touched(delta)
    read = {f for b in touched for f in s.read([b]).inputFiles()}
    assert 1 <= len(touched) <= 2 and len(read) < len(s.read().inputFiles())
    seen = []
    s.merge(delta, lambda old, new: (seen.extend(old.inputFiles()), upserted(old, new))[1])
    assert set(seen) == read
    after = s.commit()["folders"]
    assert {b for b in after if after[b] != before.get(b)} == set(map(str, touched))
    want = {k: "a" for k in range(200)} | {5: "b", 500: "c"}
    assert dict(rows(s.read())) == want and rows(s.lookup(spark.createDataFrame([(5,), (7,), (999,)], "k long"))) == [(5, "b"), (7, "a")]
    assert s.clean() == 0 and dict(rows(s.read())) == want


def test_deleted_buckets_and_strays(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s", ["k"], SCHEMA, buckets=4)
    s.merge(spark.range(40).select(F.col("id").alias("k"), F.lit("a").alias("v")), upserted)
    gone = s.read().filter(s.bucket() == 2)
    n = gone.count()
    s.merge(gone.select("k"), lambda old, new: old.join(new, "k", "left_anti"))
    assert s.read().count() == 40 - n and "2" not in s.commit()["folders"]
    with pytest.raises(Exception, match="does not touch"):
        s.merge(spark.createDataFrame([(0, "x")], SCHEMA), lambda old, new: spark.range(50).select(F.col("id").alias("k"), F.lit("y").alias("v")))
    assert s.read().count() == 40 - n and s.commit()["version"] == 2


def test_batches_count_once_and_writers_do_not_meet(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s", ["k"], SCHEMA, buckets=4)
    one = spark.createDataFrame([(1, "a")], SCHEMA)
    both = lambda old, new: old.unionByName(new)
    assert s.merge(one, both, "w", 0) == 1 and s.merge(one, both, "w", 0) == 1 and s.merge(one, both, "other", 0) == 2
    assert rows(s.read()) == [(1, "a")] * 2

    def meanwhile(old, new):
        Store(spark, f"{tmp_path}/s", ["k"], SCHEMA, buckets=4).merge(one, both)
        return both(old, new)

    with pytest.raises(CommitConflict):
        s.merge(one, meanwhile)
    assert rows(s.read()) == [(1, "a")] * 3
    assert s.clean() > 0 and rows(s.read()) == [(1, "a")] * 3


DOCS = "id long, url string, content_hash string, raw_text string, published_at date, source_role string, topic string"
D = dt.date


def stores(spark, path, buckets=8):
    return Store(spark, f"{path}/documents", ["url"], DOCS, buckets), Store(spark, f"{path}/contents", ["content_hash"], "content_hash string, url string", buckets)


ROLE = collect.CHANGING
FIRST = [
    (1, "a", "h1", "t1", None, ROLE, "x"), (2, "b", "h1", "t1", None, "news", "x"), (3, "a", "h9", "t9", D(2024, 1, 3), ROLE, "x"),
    (4, "c", "h2", "t2", D(2024, 1, 4), "news", "x"), (5, None, "h3", "t3", None, "news", "x"), (6, "d", None, "", None, "news", "x"),
]
SECOND = [(7, "c", "h7", "t7", D(2024, 1, 7), "news", None), (8, "d", None, None, D(2024, 1, 8), "news", None), (9, "e", "h2", "t2", None, "news", None), (10, "f", "h4", "t4", None, ROLE, "x"), (11, "f", "h5", "t5", None, ROLE, "x"), (12, "g", "h4", "t4", None, "news", None)]
WANT = [(1, "a", "h9", D(2024, 1, 3), None), (4, "c", "h2", D(2024, 1, 4), "x"), (6, "d", None, D(2024, 1, 8), "x"), (10, "f", "h5", None, None)]


def shown(documents):
    return [(r.id, r.url, r.content_hash, r.published_at, r.topic) for r in documents.read().orderBy("id").collect()]


def test_items_are_collected(spark, tmp_path):
    documents, contents = stores(spark, tmp_path)
    assert collect.collect_batch(spark.createDataFrame(FIRST, DOCS), documents, contents, 0, reset=("topic",)) == {"saved": 3, "duplicate": 1}
    assert collect.collect_batch(spark.createDataFrame(SECOND, DOCS), documents, contents, 1, reset=("topic",)) == {"saved": 1, "duplicate": 2, "existing": 2}
    assert shown(documents) == WANT
    more = [(20, "a", "h20", "t20", D(2024, 2, 2), ROLE, None), (21, "a", "h9", "t9", None, ROLE, None)]
    assert collect.collect_batch(spark.createDataFrame(more[:1], DOCS), documents, contents, 2) == {"refreshed": 1}
    assert shown(documents)[0] == (1, "a", "h20", D(2024, 1, 3), None)
    assert collect.collect_batch(spark.createDataFrame([], DOCS), documents, contents, 3) == {}


def test_a_lost_batch_comes_again(spark, tmp_path, monkeypatch):
    documents, contents = stores(spark, tmp_path)
    lost = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
    with monkeypatch.context() as m:
        m.setattr(documents, "merge", lost)
        with pytest.raises(RuntimeError):
            collect.collect_batch(spark.createDataFrame(FIRST, DOCS), documents, contents, 0, reset=("topic",))
    assert contents.read().count() == 2 and documents.read().count() == 0
    collect.collect_batch(spark.createDataFrame(FIRST, DOCS), documents, contents, 0, reset=("topic",))
    collect.collect_batch(spark.createDataFrame(SECOND, DOCS), documents, contents, 1, reset=("topic",))
    assert shown(documents) == WANT


def test_a_stream_goes_on_after_a_stop(spark, tmp_path):
    documents, contents = stores(spark, tmp_path, 4)
    for part in (FIRST, SECOND):
        spark.createDataFrame(part, DOCS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        collect.collected(spark.readStream.schema(DOCS).parquet(f"{tmp_path}/in"), documents, contents, f"{tmp_path}/check", reset=("topic",)).awaitTermination()
    assert shown(documents) == WANT


NOW = dt.datetime(2024, 3, 1, 12, 0)


def worker(url, source):
    if url == "broken":
        raise OSError("no answer " + "x" * 400)
    return {"good": ("success", " text of it ", 3, None), "empty": ("success", "  ", 1, None), "off": ("unavailable", None, None, "no runtime")}.get(url, ("timeout", None, 1, "slow"))


def test_queue_is_worked_off(spark, tmp_path):
    documents, contents = stores(spark, tmp_path)
    documents.merge(spark.createDataFrame([(1, "good", None, "", None, "r", None), (2, "broken", None, "old", None, "r", None)], DOCS), lambda old, new: old.unionByName(new))
    queue = Store(spark, f"{tmp_path}/queue", ["document_url"], collect.QUEUE, 4)
    todo = spark.createDataFrame([("good", "s", "t", "low"), ("broken", "s", "t", "high"), ("off", "s", "t", "medium"), ("empty", "s", "t", None), ("slow", "s", "t", "high"), ("  ", "s", "t", "high")], "document_url string, source_name string, title string, priority string")
    collect.enqueue(queue, todo, NOW)
    counts, audit = collect.work_off(queue, documents, worker, NOW, limit=3)
    assert counts == {"fetch": 1, "unavailable": 1, "timeout": 1} and audit.filter("not ok").count() == 3
    held = {r.document_url: r for r in queue.read().collect()}
    assert len(held) == 5 and {held[u].status for u in held} == {"pending"} and held["good"].attempts == 0 and held["broken"].attempts == 1
    assert held["broken"].notes == "OCR fetch failed: " + ("no answer " + "x" * 400)[:300] and held["off"].notes == "OCR unavailable: no runtime"
    counts, _ = collect.work_off(queue, documents, worker, NOW, limit=10)
    held = {r.document_url: r for r in queue.read().collect()}
    assert counts == {"success": 1, "failed": 1, "fetch": 1, "unavailable": 1, "timeout": 1}
    assert held["good"].status == "done" and held["empty"].status == "pending" and held["empty"].notes == "OCR failed: "
    texts = {r.url: r for r in documents.read().collect()}
    assert texts["good"].raw_text == " text of it " and texts["broken"].raw_text == "old" and len(texts["good"].content_hash) == 64
    collect.enqueue(queue, todo, NOW + dt.timedelta(days=1))
    assert {r.document_url: r.status for r in queue.read().collect()}["good"] == "done"


def test_a_lost_round_leaves_leases_that_run_out(spark, tmp_path, monkeypatch):
    documents, _ = stores(spark, tmp_path)
    queue = Store(spark, f"{tmp_path}/queue", ["document_url"], collect.QUEUE, 2)
    collect.enqueue(queue, spark.createDataFrame([("slow", "s", "t", "high")], "document_url string, source_name string, title string, priority string"), NOW)
    plain, calls = Store.merge, []

    def once(self, *a, **k):
        calls.append(self)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return plain(self, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(Store, "merge", once)
        with pytest.raises(RuntimeError):
            collect.work_off(queue, documents, worker, NOW)
    assert [(r.status, r.attempts) for r in queue.read().collect()] == [("leased", 1)]
    assert collect.work_off(queue, documents, worker, NOW)[0] == {}
    assert collect.work_off(queue, documents, worker, NOW + dt.timedelta(hours=1))[0] == {"timeout": 1}
    assert [(r.status, r.attempts) for r in queue.read().collect()] == [("pending", 2)]
