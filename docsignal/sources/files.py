"""Text of stored files by type: office formats and archives with the standard library, inside Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from .listing import parse_text

CELLS = 200_000
ARCHIVE_CHARS = 300_000
ENTRY_BYTES, UNPACKED_BYTES, ARCHIVE_BYTES = 15 << 20, 100 << 20, 25 << 20


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def docx_text(data: bytes) -> str:
    """Paragraphs, a line each."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    out = []
    for p in root.iter():
        if _name(p.tag) == "p":
            text = "".join((x.text or "") if _name(x.tag) == "t" else "\t" if _name(x.tag) == "tab" else "" for x in p.iter())
            if text.strip():
                out.append(text.strip())
    return "\n".join(out)


def xlsx_text(data: bytes) -> str:
    """Rows, a line each, cells joined by ` | `."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in si.iter() if _name(t.tag) == "t"))
    out = []
    number = lambda n: int((re.findall(r"\d+", n) or ["0"])[-1])
    for sheet in sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=lambda n: (number(n), n)):
        for row in ElementTree.fromstring(z.read(sheet)).iter():
            if _name(row.tag) != "row":
                continue
            cells = []
            for c in row:
                kind = c.get("t")
                v = next((x.text or "" for x in c if _name(x.tag) == "v"), "")
                if kind == "s" and v.isdigit() and int(v) < len(shared):
                    v = shared[int(v)]
                elif kind == "inlineStr":
                    v = "".join(x.text or "" for x in c.iter() if _name(x.tag) == "t")
                if v.strip():
                    cells.append(" ".join(v.split()))
            if cells:
                out.append(" | ".join(cells))
    return "\n".join(out)[:CELLS]


def zip_text(data: bytes) -> str:
    """Texts of an archive's members under their names; nested archives and hidden files are left out."""
    if len(data) > ARCHIVE_BYTES:
        raise ValueError("archive too large")
    out, total = [], 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for e in sorted(z.infolist(), key=lambda e: e.filename):
            name = e.filename.rsplit("/", 1)[-1]
            kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
            total += e.file_size
            if e.is_dir() or not name or name.startswith((".", "~")) or kind == "zip" or e.file_size > ENTRY_BYTES:
                continue
            if total > UNPACKED_BYTES:
                break
            text, problem = extract(kind, z.read(e))
            if text:
                out.append(f"[{e.filename}]\n{text}")
    return "\n\n".join(out)[:ARCHIVE_CHARS]


def _plain(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1251", "replace")


READERS = {
    "docx": docx_text, "xlsx": xlsx_text, "zip": zip_text, "html": lambda b: parse_text(_plain(b)), "htm": lambda b: parse_text(_plain(b)),
    "xml": lambda b: parse_text(_plain(b)), "txt": _plain, "csv": _plain,
}


def extract(kind: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of a file's bytes. PDF needs a reader: see `register`."""
    if kind not in READERS:
        return None, {"doc": "old binary format", "xls": "old binary format", "pdf": "no reader for pdf"}.get(kind, "unknown type")
    try:
        return READERS[kind](data), None
    except Exception as e:  # a broken file is a row with an error
        return None, f"{type(e).__name__}: {e}"[:200]


def register(kind: str, reader) -> None:
    """Adds a reader (bytes -> text), such as one for PDF or one that recognises scans."""
    READERS[kind] = reader


def extracted(files: DataFrame) -> DataFrame:
    """path and content (as the binaryFile source gives them) in; path, document_type, text, error, n_chars, needs_ocr out."""
    schema = pa.schema([("path", pa.string()), ("document_type", pa.string()), ("text", pa.string()), ("error", pa.string()), ("n_chars", pa.int64()), ("needs_ocr", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name = path.rsplit("/", 1)[-1]
                kind = name.rsplit(".", 1)[-1].lower() if "." in name else "unknown"
                text, error = extract(kind, content.as_py())
                n = len(text or "")
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((path, kind, text, error, n, kind == "pdf" and n < 500), schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, document_type string, text string, error string, n_chars long, needs_ocr boolean")


def merge_pages(pages: DataFrame, doc: str, ordinal: str, text: str, most: int = 3) -> DataFrame:
    """Texts of a document's pages in order, repeats (by the normalised first 1200 characters) left out, at most so many."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ..functions.text import squash

    signature = F.lower(F.substring(squash(F.col(text)), 1, 1200))
    one = pages.withColumn("_s", signature).filter("_s <> ''").withColumn("_n", F.row_number().over(Window.partitionBy(doc, "_s").orderBy(ordinal))).filter("_n = 1")
    few = one.withColumn("_n", F.row_number().over(Window.partitionBy(doc).orderBy(ordinal))).filter(F.col("_n") <= most)
    return few.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("_n", text))).alias("_p")).select(doc, F.concat_ws("\n\n", F.transform("_p", lambda x: x[text])).alias(text))
