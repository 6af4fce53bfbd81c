"""WARC archives, written and read back by boundary-chain verification (operator 13).

The writer turns pages into records; of equal payloads only the page with the largest id is kept whole, the
others become revisit records that refer to it. Tasks write files of their own under names of their attempt
and report them, so that a lost task leaves nothing that is read.

The reader cuts archives into blocks of bytes that know nothing of records. Each task searches its block for
the magic of a record, parses the header behind each and so gets candidates, whose length says where their
successor begins; it follows successors inside the block and emits where each candidate's chain leaves it.
Pointer jumping over these offsets from the start of every file keeps the blocks' true first records: a magic
inside a payload is no successor of a record and falls away. From there tasks read the records. The number of
rounds is the logarithm of a file's number of blocks, and only counts reach the driver.

Defined results: a null html is an empty payload. Rows that share the largest id of their payload are all
responses; a null id is smaller than all others. Line ends in an address are written as per cent codes, a
null address is left out. A chain that breaks (no record, or less than its length) gives a row with `damage`,
and what follows in that file is not reached. Empty files and tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_small, map_rows, new_path, release, save, table
from .token_files import filesystem

MAGIC = b"WARC/1."
END = b"\r\n\r\n"
FILE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
#: Bytes that a header is looked for in at first; the search goes on in larger steps.
HEADER_BYTES = 4096
RECORD = "path string, offset long, next long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, damage string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: a response with the payload, or a revisit with the response's headers alone."""
    named = lambda i: b"<urn:page:%s>" % (b"" if i is None else b"%d" % i)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + named(page_id), b"WARC-Date: " + date.encode()]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url).encode())
    if refers_to is not None:
        lines += [b"WARC-Refers-To: " + named(refers_to), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http if refers_to is not None else http + payload
    lines += [b"WARC-Payload-Digest: sha1:" + base32_sha1(payload).encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + END + block + END


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(key, refers_to) of pages whose payload, of at least so many bytes, a page with a larger id has as well."""
    ids = pages.filter(F.col("size") >= least).select("page_id", "digest", "key")
    top = save(ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("digest", "refers_to"), "responses")
    later = ids.join(top, "digest").filter("refers_to IS NOT NULL AND (page_id IS NULL OR page_id < refers_to)")
    return save(later.select("key", "refers_to").distinct(), "revisits")


def write_warc(pages: DataFrame, path: str, least: int = 0, date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html). Returns the files that count: path, length."""
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    known = known.withColumns({"size": F.octet_length("html"), "digest": F.sha1(F.encode("html", "UTF-8"))}).withColumn("key", F.concat_ws(":", "digest", F.col("page_id").cast("string")))
    decided = join_small(known, revisits(known, least), ["key"])

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        task = TaskContext.get()
        to, at = filesystem(path)
        to.create_dir(at, recursive=True)
        number, size, out, name = 0, 0, None, ""
        for page_id, url, html, refers_to in rows:
            if out is None:
                name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc"
                out, size = to.open_output_stream(f"{at}/{name}"), 0
            body = record(page_id, url, html.encode(), refers_to, date)
            out.write(body)
            size += len(body)
            if size >= file_bytes:
                out.close()
                yield f"{path}/{name}", size
                out, number = None, number + 1
        if out is not None:
            out.close()
            yield f"{path}/{name}", size

    return save(map_rows(decided.select("page_id", "url", "html", "refers_to"), run, "path string, length long"), "archives")


class Span:
    """A file's bytes from one place on, read as they are asked for."""

    def __init__(self, f, length: int, start: int, size: int) -> None:
        self.f, self.length, self.start = f, length, start
        self.held = bytearray()
        self.upto(start + size)

    def upto(self, end: int) -> None:
        have = self.start + len(self.held)
        end = min(end, self.length)
        if end > have:
            self.held += self.f.read_at(end - have, have)

    def record(self, at: int) -> tuple[dict[str, str], int, int] | None:
        """The fields of the record at a place, where its block begins and where its successor, or None if there is no record."""
        size = HEADER_BYTES
        while True:
            self.upto(at + size)
            end = self.held.find(END, at - self.start)
            if end >= 0 or at + size >= self.length:
                break
            size *= 2
        if end < 0 or not self.held.startswith(MAGIC, at - self.start):
            return None
        first, *lines = self.held[at - self.start : end].decode("utf-8", "replace").split("\r\n")
        if not re.fullmatch(r"WARC/1\.[0-9]+", first):
            return None
        fields: dict[str, str] = {}
        for line in lines:
            name, colon, value = line.partition(":")
            if colon:
                fields.setdefault(name.strip().lower(), value.strip())
        if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
            return None
        begin = self.start + end + len(END)
        return fields, begin, begin + int(fields["content-length"]) + len(END)

    def bytes(self, begin: int, end: int) -> bytes:
        self.upto(end)
        return bytes(self.held[begin - self.start : end - self.start])


def candidates(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, length, at, to) for every candidate record of files (path, length): the first offset of its chain beyond its block, null if the chain breaks before."""
    blocks = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes))).alias("block"))

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for path, length, block in rows:
            lo, hi = block * block_bytes, min(length, (block + 1) * block_bytes)
            store, inside = filesystem(path)
            with store.open_input_file(inside) as f:
                span = Span(f, length, lo, hi - lo + len(MAGIC) - 1)
                body = bytes(span.held)
                parsed = {lo + m.start(): span.record(lo + m.start()) for m in re.finditer(re.escape(MAGIC), body)}
            following = {at: r[2] if r and r[2] <= length else None for at, r in parsed.items()}
            leaves: dict[int, int | None] = {}
            for at in sorted(following, reverse=True):
                to = following[at]
                leaves[at] = to if to is None or to >= hi else leaves.get(to)
            yield from ((path, length, at, to) for at, to in leaves.items())

    return map_rows(blocks.repartition("path", "block"), run, "path string, length long, at long, to long", batch=4096)


def reachable(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, length, at): the first record of every block that holds the start of one, by pointer jumping from the start of each file."""
    found = save(found, "candidates")
    ends = found.filter("to IS NOT NULL AND to < length").select("path", F.col("to").alias("at")).distinct()
    # only what some chain leads to can be the first of a block
    jump = save(found.filter("to < length").join(ends.unionByName(found.filter("at = 0").select("path", "at")), ["path", "at"], "left_semi"), "jump")
    reached = save(files.filter("length > 0").select("path", "length", F.lit(0).cast("long").alias("at")), "reached")
    while True:
        far = jump.select("path", "at", "to")
        more = reached.join(far, ["path", "at"]).select("path", "length", F.col("to").alias("at"))
        new = save(more.join(reached, ["path", "at"], "left_anti"), "reached")
        if not new.limit(1).count():
            return reached
        reached = save(reached.unionByName(new), "reached")
        doubled = save(jump.join(far.select("path", F.col("at").alias("to"), F.col("to").alias("then")), ["path", "to"]).select("path", "length", "at", F.col("then").alias("to")), "jump")
        release(jump)
        jump = doubled


def http_length(head: bytes) -> int | None:
    m = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", head)
    return int(m[1]) if m else None


def read_warc(files: DataFrame, payload: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The records of archives (path, length), one row each: RECORD. payload_bytes and payload_digest of a response are those of the bytes read."""
    entries = reachable(files, candidates(files, block_bytes)).repartition("path", "at")

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for path, length, at in rows:
            hi = min(length, (at // block_bytes + 1) * block_bytes)
            store, inside = filesystem(path)
            with store.open_input_file(inside) as f:
                span = Span(f, length, at, hi - at)
                while at < hi:
                    found = span.record(at)
                    if found is None or found[2] > length or span.bytes(found[2] - len(END), found[2]) != END:
                        yield path, at, None, *[None] * 7, "no record" if found is None else "less than its length"
                        break
                    fields, begin, after = found
                    kind, block = fields.get("warc-type"), span.bytes(begin, after - len(END))
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    size, body, wrong = len(block), block, None
                    if fields.get("content-type", "").startswith("application/http"):
                        head, _, body = block.partition(END)
                        size = len(body)
                        if kind == "revisit":
                            size, body = http_length(head + b"\r\n"), None
                    if body is not None:
                        real = base32_sha1(body)
                        wrong = "digest differs" if digest is not None and digest != real else None
                        digest = real
                    yield path, at, after, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, size, body if payload else None, wrong
                    at = after

    return map_rows(entries.select("path", "length", "at"), run, RECORD, batch=1024)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under a folder, for read_warc()."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return read_warc(files, payload=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


ORACLE_SQL = """
WITH read AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform(range(0, 4), lambda j:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((CAST('0x' || h[5 * i + 1:5 * i + 5] AS BIGINT) >> (15 - 5 * j)) & 31 AS INTEGER) + 1]), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top OR top IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top OR page_id IS NULL THEN top END AS refers_to
FROM read
"""
