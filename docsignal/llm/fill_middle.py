"""Fill-in-the-middle transformation (operator 11).

One numpy kernel works on the UTF-8 buffer of a whole Arrow batch: a lookup gives every byte its class, a
mask over adjacent bytes marks where units (lines, words or characters) begin, cumulative sums that
restart with each document number the units, and one searchsorted finds the cuts of all rows together. The
outputs are gathered from the same buffer. Batches are worked off in slices of whole documents, so that
memory follows the slice, or the longest text if that is longer.

Where a document is cut, and its form, follow from a hash of its id alone, so that reruns agree.

Defined results: a null text is empty; a null id hashes as the empty word. Empty texts, texts that hold a
marker, and texts that the rate leaves out stay plain, and prefix_chars and middle_chars are null there.
Repeated rows are transformed alike. An empty table gives no rows. All columns are kept; one that is
called as the new column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARKERS = ("<P>", "<S>", "<M>")
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"
FORMS = np.array(["plain", "psm", "spm"])
#: Bytes of text that the kernel takes at once, in whole documents.
SLICE = 1 << 20


def unit_tables(unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, whether a unit begins between two classes)."""
    byte = np.arange(256)
    if unit == "line":  # with its end of line
        return (byte == 10).astype(np.uint8), np.array([[False, False], [True, True]])
    if unit == "word":  # with the white space before it; white space at the end is a unit
        return np.isin(byte, [9, 10, 11, 12, 13, 32]).astype(np.uint8), np.array([[False, True], [False, False]])
    if unit == "char":
        return ((byte & 0xC0) != 0x80).astype(np.uint8), np.array([[False, True], [False, True]])
    raise ValueError(f"unit {unit}: line, word or char")


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of many runs of a buffer, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def cut_slice(data: np.ndarray, edges: np.ndarray, plain: np.ndarray, draws: list[np.ndarray], tables: tuple[np.ndarray, np.ndarray], rate: int, spm: int, markers: tuple[str, ...]) -> pa.StructArray:
    """data: the texts' bytes; edges: where each begins, and the end; plain: texts that stay as they are."""
    begin, end = edges[:-1], edges[1:]
    kind, pair = tables
    of = kind[data]
    mask = np.ones(len(data), bool)
    mask[1:] = pair[of[:-1], of[1:]]
    mask[begin[begin < end]] = True
    units = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
    base = units[begin]
    n = units[end] - base
    one, two = draws[0] % (n + 1), draws[1] % (n + 1)
    cut = [np.searchsorted(units[1:], base + at + 1) for at in (np.minimum(one, two), np.maximum(one, two))]
    plain = plain | (n == 0) | (draws[2] % 100 >= rate)
    form = np.where(plain, 0, np.where(draws[3] % 100 < spm, 2, 1))
    # an output is up to six runs of the bytes and the markers behind them
    tags = [m.encode() for m in markers]
    source = np.concatenate((data, np.frombuffer(b"".join(tags), np.uint8)))
    at = len(data) + np.cumsum([0, *map(len, tags[:-1])])
    mark = [(np.full(len(n), a), np.where(plain, 0, len(t))) for a, t in zip(at, tags, strict=True)]
    prefix, middle = (begin, np.where(plain, end, cut[0]) - begin), (cut[0], np.where(plain, 0, cut[1] - cut[0]))
    suffix = (cut[1], np.where(plain, 0, end - cut[1]))
    psm, spm_ = (mark[0], prefix, mark[1], suffix, mark[2], middle), (mark[1], suffix, mark[0], prefix, mark[2], middle)
    pick = lambda i: np.stack([np.where(form == 2, b[i], a[i]) for a, b in zip(psm, spm_, strict=True)], axis=1)
    starts, sizes = pick(0), pick(1)
    out = source[spread(starts.reshape(-1), sizes.reshape(-1))]
    offsets = np.concatenate(([0], np.cumsum(sizes.sum(axis=1)))).astype(np.int32)
    count = lambda a, b: pa.array(chars[b] - chars[a], mask=plain)
    return pa.StructArray.from_arrays(
        [pa.array(n), pa.array(FORMS[form]), count(begin, cut[0]), count(cut[0], cut[1]), pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(out))], names=["n", "form", "prefix_chars", "middle_chars", "output"]
    )


def cut_batch(text: pa.Array, draws: list[pa.Array], unit: str = "line", rate: int = 100, spm: int = 50, markers: tuple[str, ...] = MARKERS) -> pa.Array:
    """The kernel over a batch: texts and their four hashed numbers in, structs of RESULT out."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    edges = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    plain = np.zeros(len(text), bool)
    for m in markers:
        plain |= pc.match_substring(text, m).to_numpy(zero_copy_only=False)
    numbers = [d.to_numpy(zero_copy_only=False).astype(np.int64) for d in draws]
    tables = unit_tables(unit)
    out, lo = [], 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + SLICE, "right")) - 1)
        out.append(cut_slice(data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo], plain[lo:hi], [d[lo:hi] for d in numbers], tables, rate, spm, markers))
        lo = hi
    if not out:
        return cut_slice(data[:0], np.zeros(1, np.int64), plain, numbers, tables, rate, spm, markers)
    return pa.concat_arrays(out)


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, markers: tuple[str, ...] = MARKERS, into: str = "fim") -> DataFrame:
    """docs (doc_id, text, ...) with a struct column: n units, form, prefix_chars, middle_chars, output.

    rate: per cent of the documents that are transformed; spm: per cent of these with the suffix first.
    """
    unit_tables(unit)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]

    def kernel(text: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        return cut_batch(text, [a, b, c, d], unit, rate, spm, markers)

    return docs.withColumn(into, F.arrow_udf(kernel, RESULT)(F.col("text").cast("string"), *draws))


def restored(output: Column, form: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    """The text that an output was made from. The text held no marker, so each stands in the output once."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in markers), -1)
    whole = lambda *at: F.concat(*(F.get(parts, i) for i in at))
    return F.when(form == "psm", whole(1, 3, 2)).when(form == "spm", whole(2, 3, 1)).otherwise(output)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    out, form = F.col("fim.output"), F.col("fim.form")
    return done.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", sha(out).alias("output_sha256"), sha(restored(out, form)).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines FROM documents
), numbered AS (
  SELECT doc_id, t, lines, CAST(len(lines) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(lines) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(lines) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(lines[1:least(a, b)], '') AS p, array_to_string(lines[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(lines[greatest(a, b) + 1:], '') AS s FROM numbered
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
