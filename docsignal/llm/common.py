"""What the operators share: scratch tables, Arrow passes, word splitting."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2000 rows unless the session asks for other than Spark's 10000: rows here hold whole texts, and both sides keep buffers of the largest batch."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "2000")


def trim() -> None:
    """Gives free memory back to the system, for processes that live on: workers between tasks, the driver after a fit."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(run: Callable) -> Callable:
    """A partition function that gives memory back at its end."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own if that is unset."""
    small_batches(spark)
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = tempfile.mkdtemp(prefix="docsignal-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/docsignal/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written[:] = [x for x in _written if not path.endswith(x[1].split("/docsignal/")[-1])]


def save(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it again. Lives until release(), clean() or the driver's end."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes a table that save() gave, when nothing will read it again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def clean() -> None:
    """Deletes the scratch tables of this driver."""
    for spark, path in list(_written):
        try:
            drop_path(spark, path)
        except Exception:  # the session may have ended before
            _written[:] = [x for x in _written if x[1] != path]


atexit.register(clean)


def arrow_type(schema: str, spark: SparkSession) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def map_rows(df: DataFrame, fn: Callable[[Iterable[tuple]], Iterator[tuple]], schema: str, batch: int = 2000) -> DataFrame:
    """fn turns an iterator over a partition's rows (tuples) into rows of the schema; batches pass through Arrow."""
    small_batches(df.sparkSession)
    out = arrow_type(schema, df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    piece = b.slice(at, 256)
                    yield from zip(*(c.to_pylist() for c in piece.columns), strict=True)

        def pack(held: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out, strict=True)], schema=out)

        held: list[tuple] = []
        size = 0
        for r in fn(rows()):
            held.append(r)
            size += sum(len(x) for x in r if isinstance(x, (bytes, str)))
            if len(held) >= batch or size >= 8 << 20:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return df.mapInArrow(tidied(run), schema)


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_interval(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts, the same in each run."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds each row's place (from 1) in the whole order: ranges sorted apart, then offsets from the ranges' counts.

    Only a count per range meets in one place.
    """
    from pyspark.sql import Window

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = save(sorted_.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "rank")
    counts = held.groupBy("_part").count()
    offsets = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return held.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", most: int = 200_000) -> DataFrame:
    """Joins by broadcast if the small side has at most so many rows, which is counted; else by a shuffle that Spark can split."""
    return df.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small, on, how)
