import pytest
from pyspark.sql import functions as F

from docsignal.streaming import ingest


def test_ingest_takes_each_item_once(spark, tmp_path):
    schema = "id long, url string, content_hash string"
    for n, rows in enumerate([[(1, "a", "h1"), (2, "a", "h2"), (3, "b", "h1")], [(4, "a", "h9"), (5, "c", "h3"), (6, "d", "h1")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        q = ingest.ingest(spark.readStream.schema(schema).json(f"{tmp_path}/in"), f"{tmp_path}/table", f"{tmp_path}/check")
        q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/table").collect()) == [1, 5]


def test_drained_equals_batch(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") % 7).alias("k")).repartition(5).write.parquet(f"{tmp_path}/t.parquet")
    df = spark.read.parquet(f"{tmp_path}/t.parquet")
    got = ingest.drained(df, ["k"], [F.count("*").alias("n")])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.groupBy("k").agg(F.count("*").alias("n")).collect()))


def test_change_detector(spark, tmp_path):
    pytest.importorskip("google.protobuf")  # Spark's Python state server speaks it
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "item long, ordinal long, status_hash string"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "x")], schema).coalesce(1).write.json(f"{tmp_path}/in")
    out = ingest.detected(spark.readStream.schema(schema).json(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("changes").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("changes").collect()] == [(1, 3, "a", "b")]


def test_notify_once(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, False), (3, False), (4, None)], "id long, quiet boolean")
    log = f"{tmp_path}/sent"

    def send(rows):
        with open(log, "a") as f:
            f.writelines(f"{r.id}\n" for r in rows)
        return True

    got = ingest.notify_once(df, send, F.col("quiet"), "id")
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4] and got.count() == 4
    with open(log) as f:
        assert sorted(f.read().split()) == ["2", "3", "4"]
    assert [r.id for r in ingest.notify_once(df, lambda rows: False, F.col("quiet"), "id").collect()] == [1]
