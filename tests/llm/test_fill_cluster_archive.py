"""Operators 11 to 13 against plain Python."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsignal.llm import centroids, fill_middle, warc

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+\Z", "char": r"(?s)."}


def brute_fill(doc_id, text, unit="line", rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = re.findall(UNITS[unit], text)
    n = len(units)
    if not text or any(m in text for m in fill_middle.MARKERS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(11)
    pieces = ["one", " ", "\n", "\n\n", "é", "\U0001f600", "<", "<P", "S>", "<M>", "x\r\n", "tail", "\t", "漢字"]
    return [(100 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(900, "a<"), (901, "P>b"), (902, "\n"), (903, "<P"), (904, ">\n<S")]


@pytest.mark.parametrize("unit", ["line", "char", "word"])
def test_fill_in_middle(spark, documents, odd_rows, unit, monkeypatch):
    monkeypatch.setattr(fill_middle, "SLICE", 200)  # many slices; one text is longer than a slice
    rows = [r for r in odd_rows + texts() if unit == "line" or len(r[1] or "") < 10_000]
    df = documents(rows)
    done = fill_middle.fill_in_middle(df, unit=unit, rate=80, spm=30)
    assert done.columns == [*df.columns, "fim"] and done.filter("batch <> 'batch'").count() == 0
    got = done.select("doc_id", "text", "fim.*", fill_middle.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fill(r.doc_id, r.text, unit, 80, 30), r.doc_id
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing(spark, documents):
    assert fill_middle.fill_in_middle(documents([])).count() == 0
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(documents([]), unit="page")


def brute_clusters(rows, k, rounds, dim, scale=1024):
    kept = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    hashed = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    mids = [v for _, v in hashed[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(mids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        mids = [[sum(col) // len(col) for col in zip(*mine, strict=True)] if (mine := [v for (_, v), c in zip(kept, of, strict=True) if c == j]) else mids[j] for j in range(len(mids))]
    return sorted(((i, near(v)[1], min(near(v)[0], centroids.LARGEST)) for i, v in kept), key=repr), mids


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, vec array<double>, own string, computed int, cluster int")


def grid(n, dim, seed, step=0.25):
    """Vectors on a coarse grid: many ties and equal rows."""
    rng = random.Random(seed)
    return [(i, [rng.randint(-2, 2) * step for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize(("rows", "k", "dim"), [(grid(400, 3, 1), 8, 3), (grid(300, 8, 2, 0.37), 5, 8), (grid(60, 4, 3) + grid(60, 4, 3), 12, 4), (grid(5, 2, 4), 8, 2)])
def test_elkan_is_the_plain_algorithm(spark, rows, k, dim):
    odd = [(1000, None), (1001, [float("nan")] * dim), (1002, [None] + [1.0] * (dim - 1)), (1003, [1.0] * (dim + 1)), (None, [0.5] * dim), (1004, [float("inf")] * dim), (1005, [0.0] * dim)]
    found, mids = centroids.clustered(vectors(spark, rows + odd), k=k, rounds=6, dim=dim)
    want, want_mids = brute_clusters(rows + odd, k, 6, dim)
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert mids == want_mids


def test_elkan_with_large_numbers_and_none(spark):
    rows = [*grid(50, 3, 5), *((100 + i, [1e6 * i, -3e9, 0.1]) for i in range(20)), (200, [1e300, 0.0, 0.0])]
    found, mids = centroids.clustered(vectors(spark, rows), k=4, rounds=4, dim=3)
    cut = [(i, [max(-(2.0**52), min(2.0**52, x)) for x in v]) for i, v in rows]
    want, want_mids = brute_clusters(cut, 4, 4, 3)
    assert sorted(map(tuple, found.collect()), key=repr) == want and mids == want_mids
    done = centroids.elkan(vectors(spark, rows), k=4, rounds=2, dim=3)
    assert done.filter(f"inertia > {centroids.LARGEST}").count() == 0 and done.count() == len(rows)
    empty = centroids.elkan(vectors(spark, []), dim=3)
    assert empty.count() == 0 and empty.columns == done.columns


def test_bounds_skip_distances(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(8, 16))
    rows = [(i, (centers[i % 8] + 0.05 * rng.normal(size=16)).tolist()) for i in range(2000)]
    seen = {}
    centroids.clustered(vectors(spark, rows), k=8, rounds=6, dim=16, trace=lambda n, computed: seen.__setitem__(n, computed))
    assert seen[1] <= 2000 * 9  # one more than the plain algorithm's
    assert min(seen.values()) < 2000 * 8 / 3


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", "d", 1) for i, u, h in rows], "page_id long, url string, html string, key string, digest string, size int")


def trap(n):
    """A payload that holds whole records, with lengths that lead anywhere."""
    inner = warc.record(5, "http://trap/", b"x" * n, None, "2000-01-01T00:00:00Z").decode()
    return f"<p>{inner}</p>\r\n\r\nWARC/1.1\r\nContent-Length: {n}\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 7\r\n\r\nWARC/1."


ROWS = [
    *((i, f"http://h/{i}", f"<p>page {i % 17}</p>" * (i % 5)) for i in range(120)),
    *((200 + i, f"http://t/{i}\r\nX: y", trap(i * 37)) for i in range(40)),
    (300, None, None), (301, "http://é/", ""), (302, "u", "é\U0001f600" * 4000), (303, "u", "é\U0001f600" * 4000), (None, "u", "<p>none</p>"), (None, "u", "é\U0001f600" * 4000), (304, "same", "twice"), (304, "same", "twice"),
]


def brute_records(rows, least=0):
    top = {}
    for i, _, h in rows:
        top[h or ""] = max((x for x in (top.get(h or ""), i) if x is not None), default=None)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        response = len(body) < least or i == top[h or ""]
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else top[h or ""]))
    return sorted(out, key=repr)


def read(files, **how):
    page = lambda c: F.regexp_extract(c, r"page:(\d+)", 1).try_cast("long").alias(c)
    return warc.read_warc(files, **how).select("*", page("record_id").alias("page"), page("refers_to").alias("to"))


@pytest.mark.parametrize(("block", "size", "least"), [(64, 5000, 0), (700, 1 << 20, 0), (4 << 20, 64 << 20, 10)])
def test_archives_come_back(spark, tmp_path, block, size, least):
    files = warc.write_warc(pages(spark, ROWS), str(tmp_path / "warc"), least=least, file_bytes=size)
    got = read(files, block_bytes=block).collect()
    assert sorted(((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.to) for r in got), key=repr) == brute_records(ROWS, least)
    assert not any(r.damage for r in got)
    by = {(r.page, r.record_type): r for r in got}
    for i, _, h in ROWS:
        if (i, "response") in by and i is not None:
            assert by[i, "response"].payload.decode() == (h or "")
    assert by[200, "response"].target_uri == "http://t/0%0D%0AX: y"
    assert warc.archives(spark, str(tmp_path / "warc")).agg(F.sum("length")).first()[0] == files.agg(F.sum("length")).first()[0]


def test_candidates_inside_payloads_are_rejected(spark, tmp_path):
    files = warc.write_warc(pages(spark, ROWS), str(tmp_path / "warc"))
    assert warc.candidates(files, 300).count() > 3 * len(ROWS) / 2
    assert read(files, block_bytes=300).count() == len(ROWS)


def test_damaged_archives(spark, tmp_path):
    whole = b"".join(warc.record(i, "u", b"text %d" % i, None, "2000-01-01T00:00:00Z") for i in range(20))
    one = len(whole) // 20
    (tmp_path / "cut.warc").write_bytes(whole[:-30])
    (tmp_path / "torn.warc").write_bytes(whole[: 5 * (one - 1)] + b"?" * 40 + whole[5 * (one - 1) :])
    (tmp_path / "none.warc").write_bytes(b"no archive at all")
    (tmp_path / "empty.warc").write_bytes(b"")
    for block in (50, 1000, 1 << 20):
        got = read(warc.archives(spark, str(tmp_path)), block_bytes=block).collect()
        of = lambda name: [r for r in got if r.path.endswith(name)]  # noqa: B023, E731
        assert [r.page for r in sorted(of("cut.warc"), key=lambda r: r.offset)] == [*range(19), None]
        assert sum(r.damage is None for r in of("torn.warc")) <= 5 and sum(r.damage is not None for r in of("torn.warc")) == 1
        assert [r.damage for r in of("none.warc")] == ["no record"] and not of("empty.warc")
    changed = whole.replace(b"text 7", b"tent 7")
    (tmp_path / "empty.warc").write_bytes(changed)
    assert [r.page for r in read(warc.archives(spark, str(tmp_path / "empty.warc"))).filter("damage = 'digest differs'").collect()] == [7]


def test_no_pages(spark, tmp_path):
    assert warc.read_warc(warc.write_warc(pages(spark, []), str(tmp_path / "warc"))).count() == 0
