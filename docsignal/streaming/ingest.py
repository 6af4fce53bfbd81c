"""Incremental ingest and state: micro-batches over files with the table itself as the memory."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql import functions as F

from ..operators import joins
from ..session import cut


def shared_folder(spark: SparkSession) -> str:
    """A folder that executors see: under spark.checkpoint.dir, or a temporary one where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    return f"{at.rstrip('/')}/stream-{uuid.uuid4().hex}" if at else tempfile.mkdtemp(prefix="docsignal-stream-")


def ingest(items: DataFrame, table: str, checkpoint: str, url: str = "url", content: str = "content_hash", ordinal: str = "id"):
    """Starts a stream that appends to a Parquet table the items whose url and content are new to it and to the batch.

    An anti join against the table takes the place of de-duplication state, which would grow forever.
    A batch that runs again writes the same folder again.
    """
    spark = items.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        from pyspark.errors import AnalysisException

        try:
            stored = spark.read.schema(batch.schema).parquet(f"{table}/batch=*").filter(F.input_file_name().rlike(f"batch=(?!{number:010d}/)"))
        except AnalysisException:
            stored = spark.createDataFrame([], batch.schema)
        fresh = joins.new_items(batch, stored.select(url, content), url, content, ordinal)
        fresh.write.mode("overwrite").parquet(f"{table}/batch={number:010d}")

    return items.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """The rows of a file table read as a stream to its end and aggregated; what the last micro-batch left is returned."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 64).parquet(_parent(df))
    out = stream.groupBy(*keys).agg(*aggregates)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number:010d}")

    q = out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(p["batchId"] for p in q.recentProgress) if q.recentProgress else 0
    return spark.read.schema(out.schema).parquet(f"{folder}/out/{last:010d}")


def _parent(df: DataFrame) -> str:
    """A pattern that matches the table's files."""
    first = df.inputFiles()[0]
    root = first.rsplit("/", 1)[0]
    # the file source takes a single file only as a pattern
    return f"{root}/*.parquet" if root.endswith(".parquet") else f"{first[:-1]}[{first[-1]}]"


class ChangeDetector(StatefulProcessor):
    """Per item the last status hash; a row whenever it differs. The first sight is remembered only."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "hash string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        for pdf in rows:
            out = []
            for r in pdf.sort_values("ordinal").itertuples():
                old = self.last.get()[0] if self.last.exists() else None
                if old is not None and old != r.status_hash:
                    out.append((key[0], r.ordinal, old, r.status_hash))
                self.last.update((r.status_hash,))
            yield pd.DataFrame(out, columns=["item", "ordinal", "old_hash", "new_hash"])

    def close(self) -> None:
        pass


def detected(stream: DataFrame) -> DataFrame:
    """Stream of item, ordinal, status_hash in; change events out (needs a RocksDB state store)."""
    return stream.groupBy("item").transformWithStateInPandas(ChangeDetector(), outputStructType="item long, ordinal long, old_hash string, new_hash string", outputMode="append", timeMode="none")


def notify_once(pending: DataFrame, send: Callable[[list], bool], suppressed: Column, key: str) -> DataFrame:
    """Keys to mark as notified: suppressed ones without sending, others only if sending them succeeded. pending is a period's rows of the top level.

    Rows are sent from tasks, in batches of Arrow's size, and only batches that send() takes are marked; what was
    taken is written, so that nothing is sent twice by planning again.
    """
    rows = pending.withColumn("_quiet", F.coalesce(suppressed, F.lit(False)))
    kind = pending.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) and send(list(pdf.itertuples(index=False))):
                yield pdf[[key]]

    sent = cut(rows.filter("not _quiet").drop("_quiet").mapInPandas(run, f"`{key}` {kind}"))
    return rows.filter("_quiet").select(key).unionByName(sent)
