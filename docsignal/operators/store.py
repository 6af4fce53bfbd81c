"""Keyed state in plain files that a batch changes without reading or writing all of it.

Rows lie in buckets by a hash of their key. A version is a commit file that names the folder of every
bucket. A batch reads only the buckets that its keys fall into, writes these anew under a folder of its own
and commits; all other buckets stay where they are. Readers see the last commit whole or not at all. A batch
that runs again after its commit changes nothing, one that was lost before it leaves files that no commit
names. Two writers of one version: the second gets an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


class Store:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str | StructType, buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema

    # -- commits ---------------------------------------------------------------------------------

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _commit_path(self, version: int) -> str:
        return f"{self.path}/_commits/{version:010d}.json"

    def commit(self) -> dict:
        """The last one: version, batches (the last batch of every writer), folders by bucket."""
        fs, at = self._fs(f"{self.path}/_commits")
        if not fs.exists(at):
            return {"version": 0, "batches": {}, "folders": {}}
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))
        if not names:
            return {"version": 0, "batches": {}, "folders": {}}
        stream = fs.open(self._fs(f"{self.path}/_commits/{names[-1]}")[1])
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _write_commit(self, commit: dict) -> None:
        fs, at = self._fs(self._commit_path(commit["version"]))
        draft = self._fs(f"{self.path}/_commits/_{uuid.uuid4().hex}")[1]
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            raise CommitConflict(self._commit_path(commit["version"]))

    # -- reading ---------------------------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, only: Iterable[int] | None = None, commit: dict | None = None) -> DataFrame:
        """The rows of the last version, or of some of its buckets."""
        folders = (commit or self.commit())["folders"]
        wanted = [f for b, f in folders.items() if only is None or int(b) in set(only)]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in sorted(wanted)))

    def touched(self, delta: DataFrame) -> list[int]:
        """The buckets of a delta's keys; at most as many as there are buckets."""
        return sorted(r[0] for r in delta.select(self.bucket()).distinct().collect())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The stored rows of some keys (columns called as the store's), from their buckets alone."""
        return self.read(self.touched(keys)).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    # -- writing ---------------------------------------------------------------------------------

    def merge(self, delta: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], writer: str = "", batch: int | None = None) -> int:
        """Rewrites the buckets that the delta touches with change(their rows, delta). Returns the version.

        change must not give rows of other buckets: those would be lost, so that they raise an error. writer and
        batch: a batch up to the writer's last one is done already.
        """
        last = self.commit()
        if batch is not None and last["batches"].get(writer, -1) >= batch:
            return last["version"]
        touched = self.touched(delta)
        folders, version = dict(last["folders"]), last["version"] + 1
        if touched:
            new = change(self.read(touched, last), delta).select(*self.schema.names).withColumn("_bucket", self.bucket())
            strays = F.raise_error(F.lit("a changed row lies in a bucket that its delta does not touch"))
            new = new.withColumn("_bucket", F.when(F.col("_bucket").isin(touched), F.col("_bucket")).otherwise(strays.cast("int")))
            at = f"data/{version:010d}-{uuid.uuid4().hex}"
            new.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{at}")
            fs, _ = self._fs(self.path)
            for b in touched:
                here = f"{at}/_bucket={b}"
                folders.pop(str(b), None)
                if fs.exists(self._fs(f"{self.path}/{here}")[1]):
                    folders[str(b)] = here
        self._write_commit({"version": version, "batches": last["batches"] | ({writer: batch} if batch is not None else {}), "folders": folders})
        return version

    def clean(self) -> int:
        """Deletes folders that the last commit does not name, and older commits. Not while others write or read old versions."""
        last = self.commit()
        live = {f.split("/_bucket=")[0] for f in last["folders"].values()}
        fs, at = self._fs(f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(at) if f"data/{s.getPath().getName()}" not in live] if fs.exists(at) else []
        for p in gone:
            fs.delete(p, True)
        fs, at = self._fs(f"{self.path}/_commits")
        for s in fs.listStatus(at) if fs.exists(at) else []:
            if s.getPath().getName() != f"{last['version']:010d}.json":
                fs.delete(s.getPath(), False)
        return len(gone)
