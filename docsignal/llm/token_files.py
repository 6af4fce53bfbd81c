"""Token counts by separator scan (operator 1).

Texts are encoded with a given tokenizer into flat files of two-byte or four-byte token numbers, each
document followed by the end-of-document number, without any index. The scan reads the files in blocks
of bytes that know nothing of documents, searches each block for the separator with one vector
comparison, and stitches documents over block borders by a prefix scan over the blocks' summaries
(separators so far, place of the last one).

The blocks' summaries, a few numbers each, are all that windows see; a file of any size is cut into
blocks. The writer's files appear under their final name only when complete, so a task may run twice.

Defined results: null and empty texts count 0 tokens. A file that does not end with a separator has an
unfinished document after the last one (`finished` false). The separator's spelling inside a text is
ordinary text. Repeated rows are counted each. An empty table or file gives no rows. A null doc_id is
carried. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, new_path, save, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are split before the merges of a rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEPARATOR = 50256
FILE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20


@functools.lru_cache(maxsize=2)
def encoder(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def filesystem(path: str):
    """(file system, path in it) of a path or URI, by pyarrow."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path.split("/")[0] else f"file://{path}")


def write_token_files(docs: DataFrame, path: str, ranks: str = RANKS, separator: int = SEPARATOR, width: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the texts' tokens under path, each task its own files. Returns which document is where: doc_id, file, ordinal."""
    dtype = f"<u{width}"

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        task = TaskContext.get()
        to, at = filesystem(path)
        to.create_dir(at, recursive=True)
        encode = encoder(ranks).encode_ordinary
        stop = np.array([separator], dtype).tobytes()
        number, size, ordinal, out, name = 0, 0, 0, None, ""
        for doc_id, text in rows:
            if out is None:
                name = f"part-{task.partitionId():06d}-{number:04d}.bin"
                draft = f"{at}/_{name}.{task.taskAttemptId()}"
                out, size, ordinal = to.open_output_stream(draft), 0, 0
            body = np.array(encode(text or ""), dtype).tobytes() + stop
            out.write(body)
            size += len(body)
            yield doc_id, name, ordinal
            ordinal += 1
            if size >= file_bytes:
                out.close()
                to.move(draft, f"{at}/{name}")
                out, number = None, number + 1
        if out is not None:
            out.close()
            to.move(draft, f"{at}/{name}")

    return save(map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, file string, ordinal long"), "manifest")


def scan_token_files(spark: SparkSession, path: str, separator: int = SEPARATOR, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of the flat files under path: file, ordinal (from 0), start (token number in the file), n_tokens, finished."""
    dtype = f"<u{width}"
    step = block_bytes // width * width
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))).alias("block"))
    blocks = blocks.repartition("path", "block")

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for at, length, block in rows:
            store, inside = filesystem(at)
            with store.open_input_file(inside) as f:
                tokens = np.frombuffer(f.read_at(min(step, length - block * step), block * step), dtype)
            found = np.flatnonzero(tokens == separator) + block * (step // width)
            yield at, block, len(tokens), len(found), int(found[-1]) if len(found) else None, found.tolist()

    scanned = save(map_rows(blocks, run, "path string, block long, n long, n_found long, last long, found array<long>", batch=64), "scan")
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    edges = scanned.select(
        "path", "block", F.coalesce(F.sum("n_found").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.max("last").over(earlier) + 1, F.lit(0)).alias("begin")
    )
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("file")
    ends = scanned.join(edges, ["path", "block"]).select(name, "before", "begin", "found", F.posexplode("found").alias("at", "end"))
    start = F.when(F.col("at") == 0, F.col("begin")).otherwise(F.try_element_at("found", F.col("at")) + 1)
    whole = ends.select("file", (F.col("before") + F.col("at")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("finished"))
    tail = scanned.groupBy("path").agg(F.sum("n").alias("n"), F.sum("n_found").alias("ordinal"), (F.coalesce(F.max("last") + 1, F.lit(0))).alias("start")).filter("n > start")
    return whole.unionByName(tail.select(name, "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("finished")))


def token_counts(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Per document its number of tokens, counted from the flat files written for it."""
    path = new_path(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, path, ranks)
    if manifest.limit(1).count() == 0:
        return manifest.select("doc_id", "file", "ordinal", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("n_tokens"))
    found = scan_token_files(docs.sparkSession, path)
    return manifest.join(found, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
