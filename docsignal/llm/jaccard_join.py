"""Similarity join on word shingles by token-combination prefixes (operator 7).

A document's set holds its distinct 5-word shingles. Two documents link when their sets' Jaccard
similarity reaches 0.8; the result gives each document the smallest doc_id that links reach.

1. Sets become sorted arrays of 64-bit hashes. Documents with equal sets are one class from here on.
2. Shingles are counted over all documents, in blocks of delta-coded hashes. The most frequent ones
   (at most FREQUENT of them) and a bit map of those that occur more than once, both of fixed size, go
   to all tasks. They set the global order, rare before frequent; any order gives the same result.
3. Index. With overlap o needed, two similar sets share a shingle among the first n - o + 1 of either
   (prefix). A set needs an overlap of 4/5 of its size with any similar set, but of 8/9 with one of its size
   or larger: the smaller of a pair brings its short prefix, the larger its long one. So every entry says
   whether it is of the short prefix, and a list makes only pairs whose smaller member has such an entry;
   sets that miss the similarity by their own rare shingles never meet. Rare shingles are indexed singly. If the first shared shingle is frequent,
   all shared ones are; then the prefix is extended by g to share g + 1 of them, of which two must lie
   in one of g hash classes, so that pairs inside a class (2-combinations) are indexed. g grows with
   the tier of sizes. A set of a tier meets only sets of the tier.
4. Candidates. In the list of a key, every member is paired with a leader (a star), verified on whole
   sets, and linked sets form components; so again, with other leaders, for members left outside the
   largest component of their list. Then all pairs of a list that still lie in different components are
   verified as well, each made once, by the least key that its members share. Pairs inside a component
   are never made, so that a group of near copies costs about its size and not its square, and no link
   between components is missed. The list of a key that may have many members is spread over several
   groups, which are compared in pairs at last.
5. Components of the links, by labels and pointer jumping.

Exact up to hash collisions (64 bits for classes, 48 for the comparison of two whole sets). Defined results: null text, or text without
words, has no set (n_shingles 0) and component_id is its own doc_id; with 1 to 4 words the whole
sequence is the one shingle. Repeated rows are copies of each other. A row with a null doc_id links and
carries links as any other, but names no component: its component_id is the smallest doc_id that its
links reach, null if there is none. An empty table gives an empty result. Columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import join_small, release, save, table, tidied, trim
from .components import components, extended

WORDS = 5
#: Similarity of 4 / 5, as whole numbers.
NUM, DEN = 4, 5
#: Shingles whose exact count class is known to all tasks, and the class (log2 of the count) from which combinations are indexed.
FREQUENT = 1 << 20
COMBINE_FROM = 6
#: The class from which the list of a combination is spread over several groups, of about 2 ** HOT_FROM members each.
HOT_FROM = 12
#: Bits of the map of shingles that occur more than once, and of the map of documents whose sets are needed.
MAP_BITS = 27
BITS = 40
#: Bits of the hashes by which whole sets are compared.
SET_BITS = 48
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; A-Z lower-cased, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < WORDS:
        return mix((h * ODD[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    n = len(h) - WORDS + 1
    total = h[:n] * ODD[0]
    for i in range(1, WORDS):
        total = total + h[i : i + n] * ODD[i]
    return np.unique(mix(total))


def fingerprint(s: np.ndarray) -> int:
    """Of a whole set, as a signed 64-bit number."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def overlap(n: int) -> int:
    """The least overlap of a set of n with any similar set."""
    return -(-NUM * n // DEN)


def overlap_upward(n: int) -> int:
    """The least overlap of a set of n with any similar set of its size or larger."""
    return -(-2 * NUM * n // (NUM + DEN))


def tiers(n: int) -> list[tuple[int, int]]:
    """(tier, g) of a set of n. Two sets that may be similar share a tier; g + 1 is at most the overlap of each set in it."""
    out, j, upper, lower = [], 0, 32, 2
    while lower <= n:
        if n <= upper:
            out.append((j, 1 if j == 0 else 8 << j))
        lower, upper, j = NUM * upper // DEN, upper * 4, j + 1
    return out


def pack(h: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences, byte planes apart."""
    d = np.diff(h, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(raw).view("<u8").reshape(-1), dtype=np.uint64)


def _parts(docs: DataFrame) -> int:
    """Bits of the number of parts that hashes and keys are dealt to: by the tables' size on disk, where Spark knows it, and the shuffle's partitions."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = (size >> 24).bit_length() if size < 1 << 60 else 0
    return min(18, max(6, by_size, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None]]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            piece = b.slice(at, 256)
            yield from zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)


# -- 1 and 2: sets and counts -------------------------------------------------------------------

SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("part", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
SETS_SQL = "doc_id long, n long, fp long, part int, hashes binary, counts binary"


def survey(docs: DataFrame, part_bits: int) -> DataFrame:
    """Rows of documents (doc_id, n, fp) and blocks of counted hashes (part, hashes, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch | None:
            if not held:
                return None
            h, n = np.unique(np.concatenate(held) >> np.uint64(64 - BITS), return_counts=True)
            cuts = np.searchsorted(h, np.arange(1 << part_bits, dtype=np.uint64) << np.uint64(BITS - part_bits))
            out = []
            for p, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(h)], strict=True)):
                if hi > lo:
                    k = n[lo:hi].astype("<u4")
                    out.append((p, pack(h[lo:hi]), zstandard.compress(k.tobytes(), 1) if (k > 1).any() else b""))
            held.clear()
            p, hashes, counts = zip(*out, strict=True)
            none = pa.nulls(len(p), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(p, pa.int32()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], schema=SETS)

        def told() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            k = len(rows)
            rows.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], schema=SETS)

        for doc_id, text in _texts(batches):
            s = shingles(text)
            fp = fingerprint(s)
            rows.append((doc_id, len(s), fp))
            if fp not in seen and len(s):
                seen.add(fp)
                held.append(s)
                size += len(s)
            if len(rows) >= 5000:
                yield told()
            if size >= max(1_000_000, 64 << part_bits):
                yield flush()
                size = 0
        if rows:
            yield told()
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), SETS_SQL)


COUNTED = pa.schema([("part", pa.int32()), ("log2", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary()), ("bits", pa.binary())])


def count(blocks: DataFrame, part_bits: int) -> DataFrame:
    """Per part: its section of the bit map (log2 null), and the hashes of each count class from 4 on."""
    section = 1 << (MAP_BITS - part_bits)

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        hs, ns = [], []
        for h, n in zip(t.column("hashes").to_pylist(), t.column("counts").to_pylist(), strict=True):
            hs.append(unpack(h))
            ns.append(np.frombuffer(zstandard.decompress(n), "<u4") if n else np.ones(len(hs[-1]), "<u4"))
        h, at = np.unique(np.concatenate(hs), return_inverse=True)
        n = np.bincount(at, np.concatenate(ns)).astype(np.int64)
        bits = np.zeros(section, np.uint8)
        bits[(mix(h[n > 1]) % np.uint64(section)).astype(np.int64)] = 1
        rows = [(part, None, 0, None, np.packbits(bits, bitorder="little").tobytes())]
        log2 = np.log2(n).astype(np.int64)
        for c in np.unique(log2[log2 >= 2]):
            rows.append((part, int(c), int((log2 == c).sum()), pack(h[log2 == c]), None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COUNTED, strict=True)], schema=COUNTED)

    return blocks.groupBy("part").applyInArrow(run, "part int, log2 int, n long, hashes binary, bits binary")


class Order:
    """The global order of shingles, of fixed size: frequent ones with their class, and the bit map."""

    def __init__(self, known: np.ndarray, known_class: np.ndarray, bits: np.ndarray, part_bits: int) -> None:
        self.known, self.known_class, self.bits, self.part_bits = known, known_class, bits, part_bits

    def classes(self, s: np.ndarray) -> np.ndarray:
        short = s >> np.uint64(64 - BITS)
        if not len(self.known):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.known, short), len(self.known) - 1)
        return np.where(self.known[at] == short, self.known_class[at], 0).astype(np.int64)

    def repeated(self, s: np.ndarray) -> np.ndarray:
        """False only where a shingle occurs in one class of documents at most."""
        short = s >> np.uint64(64 - BITS)
        section = np.uint64(1 << (MAP_BITS - self.part_bits))
        at = (short >> np.uint64(BITS - self.part_bits)) * section + mix(short) % section
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def order_of(counted: DataFrame, part_bits: int) -> Order:
    """Collects at most FREQUENT hashes, the most frequent classes first, and a map of 2 ** MAP_BITS bits, in a job each."""
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    width = len(bits) >> part_bits
    for r in counted.filter("log2 is null").select("part", "bits").collect():
        bits[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    sizes = {r["log2"]: r["n"] for r in counted.filter("log2 is not null").groupBy("log2").agg(F.sum("n").alias("n")).collect()}
    least, room = 99, FREQUENT
    for c in sorted(sizes, reverse=True):
        if sizes[c] > room:
            break
        least, room = c, room - sizes[c]
    hs, cs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for r in counted.filter(F.col("log2") >= least).select("log2", "hashes").collect():
        hs.append(unpack(r["hashes"]))
        cs.append(np.full(len(hs[-1]), r["log2"], np.uint8))
    h, c = np.concatenate(hs), np.concatenate(cs)
    at = np.argsort(h)
    return Order(h[at], c[at], bits, part_bits)


# -- 3: the index -------------------------------------------------------------------------------


def keys(s: np.ndarray, order: Order, hot_from: int = HOT_FROM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The index keys of a set, over how many lists each is spread (the rarer shingle of a combination bounds the list), and which are of the short prefix."""
    n = len(s)
    if n < 2:  # a set of one is similar only to equal sets, which are one class
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    known = order.classes(s)
    at = np.lexsort((s, known))
    s, known = s[at], known[at]
    prefix, least = n - overlap(n) + 1, n - overlap_upward(n) + 1
    first_frequent = int(np.searchsorted(known, COMBINE_FROM))
    rare = min(prefix, first_frequent)
    again = order.repeated(s[:rare])
    out = [mix(s[:rare][again] + np.uint64(1))]
    spread = [np.ones(len(out[0]), np.int64)]
    short = [np.arange(rare)[again] < least]
    if first_frequent < prefix:
        for tier, g in tiers(n):
            f, c = s[first_frequent : prefix + g], known[first_frequent : prefix + g]
            which = mix(f) % np.uint64(g)
            at = np.argsort(which, kind="stable")
            f, which, c = f[at], which[at], c[at]
            # if the first shared shingle can be frequent at all
            inside = (at + first_frequent < least + g) & (first_frequent < least)
            for step in range(1, len(f)):
                same = which[:-step] == which[step:]
                if not same.any():
                    break
                # the global order inside a class makes (first, second) the same for both sets
                out.append(mix(mix(f[:-step][same] + np.uint64(tier + 2)) * ODD[1] + f[step:][same]))
                spread.append(1 << np.maximum(0, c[:-step][same] - hot_from))
                short.append((inside[:-step] & inside[step:])[same])
    # of a key that comes twice the entry of the short prefix stays
    k, first = np.concatenate(out), ~np.concatenate(short)
    at = np.lexsort((first, k))
    new = np.ones(len(at), bool)
    new[1:] = k[at][1:] != k[at][:-1]
    at = at[new]
    return k[at], np.concatenate(spread)[at], ~first[at]


ENTRIES = pa.schema([("grp", pa.int64()), ("key", pa.int64()), ("sub", pa.int32()), ("keys", pa.binary()), ("fps", pa.binary()), ("ns", pa.binary())])
ENTRIES_SQL = "grp long, key long, sub int, keys binary, fps binary, ns binary"


def index(docs: DataFrame, order, part_bits: int, hot_from: int = HOT_FROM) -> DataFrame:
    """Blocks of (key, fp, n), dealt to groups by the key's first bits; n is negative where the key is of the long prefix only. order: a broadcast Order.

    A key whose list may be long is spread over groups of its own (columns key and sub), by fp.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            k, spread, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            fp = np.repeat(np.array([x[3] for x in held], np.int64), [len(x[0]) for x in held])
            held.clear()
            rows = []
            hot = spread > 1
            if hot.any():
                hk, hf, hn = k[hot], fp[hot], n[hot]
                sub = mix(hf.view(np.uint64) + ODD[3]) % spread[hot].astype(np.uint64)
                at = np.lexsort((sub, hk))
                hk, hf, hn, sub = hk[at], hf[at], hn[at], sub[at]
                cuts = [0, *(np.flatnonzero((hk[1:] != hk[:-1]) | (sub[1:] != sub[:-1])) + 1).tolist(), len(hk)]
                own = (mix(hk + ODD[4] * (sub + np.uint64(1))) | np.uint64(1 << 63)).view(np.int64)
                rows += [(int(own[lo]), int(hk[lo].view(np.int64)), int(sub[lo]), hk[lo:hi].tobytes(), hf[lo:hi].tobytes(), hn[lo:hi].tobytes()) for lo, hi in zip(cuts, cuts[1:], strict=False)]
                k, fp, n = k[~hot], fp[~hot], n[~hot]
            at = np.argsort(k)
            k, fp, n = k[at], fp[at], n[at]
            cuts = np.searchsorted(k, np.arange(1 << part_bits, dtype=np.uint64) << np.uint64(64 - part_bits))
            rows += [(p, None, None, k[lo:hi].tobytes(), fp[lo:hi].tobytes(), n[lo:hi].tobytes()) for p, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], len(k)], strict=True)) if hi > lo]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ENTRIES, strict=True)], schema=ENTRIES)

        for _, text in _texts(batches):
            s = shingles(text)
            if len(s) < 2 or (fp := fingerprint(s)) in seen:
                continue
            seen.add(fp)
            k, spread, short = keys(s, order.value, hot_from)
            if len(k):
                held.append((k, spread, np.where(short, len(s), -len(s)).astype(np.int32), fp))
                size += len(k)
            if size >= max(500_000, 32 << part_bits):
                yield flush()
                size = 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), ENTRIES_SQL)


def signature(s: np.ndarray) -> bytes:
    """A bit map of a set, of 8 bits a shingle about."""
    bits = min(1 << 15, max(64, 1 << (8 * len(s) - 1).bit_length()))
    out = np.zeros(bits, np.uint8)
    out[(mix(s) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(signatures: list[bytes]) -> np.ndarray:
    """Signatures as rows of 64-bit words, all folded to the shortest one's length."""
    width = min(map(len, signatures)) // 8
    out = []
    for b in signatures:
        w = np.frombuffer(b, "<u8")
        while len(w) > width:
            w = w[: len(w) // 2] | w[len(w) // 2 :]
        out.append(w)
    return np.stack(out)


# -- 4: candidates ------------------------------------------------------------------------------


def similar_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of signed sizes."""
    a, b = np.abs(a), np.abs(b)
    return DEN * np.minimum(a, b) >= NUM * np.maximum(a, b)


def may_meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sizes are similar and the smaller member's entry is of its short prefix (positive)."""
    return similar_sizes(a, b) & ((a > 0) & (a <= np.abs(b)) | (b > 0) & (b <= np.abs(a)))


CANDIDATES = pa.schema([("a", pa.int64()), ("b", pa.int64()), *ENTRIES])
CANDIDATES_SQL = f"a long, b long, {ENTRIES_SQL}"
LIST = ("grp", "key", "sub", "keys", "fps", "ns")


def _lists(t: pa.Table, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A group's entries, without repeats, in order of key and fp, and the lists' starts; lists of fewer than `least`, and with least > 1 those without a short prefix, are left out."""
    k = np.concatenate([np.frombuffer(x, "<u8") for x in t.column("keys").to_pylist()])
    fp = np.concatenate([np.frombuffer(x, "<i8") for x in t.column("fps").to_pylist()])
    n = np.concatenate([np.frombuffer(x, "<i4") for x in t.column("ns").to_pylist()])
    at = np.lexsort((fp, k))
    k, fp, n = k[at], fp[at], n[at]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (fp[1:] != fp[:-1])
    k, fp, n = k[new], fp[new], n[new]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    size = np.diff(np.append(np.flatnonzero(first), len(k)))
    good = size >= least
    if least > 1 and len(k):
        good &= np.maximum.reduceat(n, np.flatnonzero(first)) > 0
    keep = np.repeat(good, size)
    size = size[good]
    return k[keep], fp[keep], n[keep], np.cumsum(size) - size


def leaders(k: np.ndarray, fp: np.ndarray, start: np.ndarray, salt: int, among: np.ndarray | None = None) -> np.ndarray:
    """The place of each list's first member under one of four random orders, which the key chooses.

    Few orders, so that the lists of a small group agree on their leaders; more than one, so that
    members of a large group meet several. among: the members that may lead, at least one a list.
    """
    order = mix(fp.view(np.uint64) + ODD[2] * ((k & np.uint64(3)) + np.uint64(4 * salt + 1)))
    if among is not None:
        order = np.where(among, order >> np.uint64(1), order | np.uint64(1 << 63))
    number = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(k))))
    return np.lexsort((order, number))[start]


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs as rows, the smaller number first."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    code = np.unique(np.minimum(x, y).astype(np.uint64) << np.uint64(32) | np.maximum(x, y).astype(np.uint64))
    return np.stack((names[(code >> np.uint64(32)).astype(np.int64)], names[(code & np.uint64(0xFFFFFFFF)).astype(np.int64)]), axis=1) if len(code) else np.zeros((0, 2), np.int64)


def _told(pairs: np.ndarray) -> pa.Table:
    """Pairs as candidates."""
    k = len(pairs)
    return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *(pa.nulls(k, f.type) for f in ENTRIES)], schema=CANDIDATES)


def stars(entries: DataFrame) -> DataFrame:
    """Per group: pairs (a, b) of each list's leader with the others; and the lists of three or more, or of spread keys, packed."""

    def run(t: pa.Table) -> pa.Table:
        grp, key, sub = (t.column(c)[0].as_py() for c in ("grp", "key", "sub"))
        k, fp, n, start = _lists(t, 1 if key is not None else 2)
        if not len(k):
            return CANDIDATES.empty_table()
        size = np.diff(np.append(start, len(k)))
        lead = np.repeat(leaders(k, fp, start, 0, n > 0), size)
        good = (fp[lead] != fp) & may_meet(n[lead], n)
        out = [_told(distinct_pairs(fp[lead][good], fp[good]))]
        big = np.repeat(size > 2, size) | (key is not None)
        if big.any():
            values = (grp, key, sub, k[big].tobytes(), fp[big].tobytes(), n[big].tobytes())
            out.append(pa.Table.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.array([v], f.type) for v, f in zip(values, ENTRIES, strict=True))], schema=CANDIDATES))
        return pa.concat_tables(out)

    return entries.groupBy("grp").applyInArrow(run, CANDIDATES_SQL)


def members(lists: DataFrame) -> DataFrame:
    """Columns grp, node: the members of each row of lists, each once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for grp, fps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fp = np.unique(np.frombuffer(fps, "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), grp), pa.int64()), pa.array(fp)], names=["grp", "node"])

    return lists.select("grp", "fps").mapInArrow(tidied(run), "grp long, node long")


def labelled(fp: np.ndarray, right: pa.Table) -> np.ndarray:
    """The components of the members, from rows (node, label); a member without a row is one of its own."""
    node, label = right.column("node").to_numpy(), right.column("label").to_numpy()
    if not len(node):
        return fp.copy()
    order = np.argsort(node)
    node, label = node[order], label[order]
    at = np.minimum(np.searchsorted(node, fp), len(node) - 1)
    return np.where(node[at] == fp, label[at], fp)


def main_component(comp: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which members are of the largest component of their list."""
    size = np.diff(np.append(start, len(comp)))
    number = np.repeat(np.arange(len(start)), size)
    order = np.lexsort((comp, number))
    turn = np.ones(len(order), bool)
    turn[1:] = (number[order][1:] != number[order][:-1]) | (comp[order][1:] != comp[order][:-1])
    run_size = np.diff(np.append(np.flatnonzero(turn), len(order)))
    weight = np.empty(len(order), np.int64)
    weight[order] = np.repeat(run_size, run_size)
    first = np.lexsort((comp, -weight, number))[start]
    return comp == np.repeat(comp[first], size)


def across(lists: DataFrame, labels: DataFrame, salt: int) -> DataFrame:
    """Candidates as stars() gives them: pairs of a further leader, out of the largest component of its list, with members of others;
    and the lists that hold several components.

    labels: node, label of the sets that have links. Each group gets the labels of its own members.
    """
    need = members(lists).join(labels, "node").select("grp", "node", "label")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return CANDIDATES.empty_table()
        grp, key, sub = (left.column(c)[0].as_py() for c in ("grp", "key", "sub"))
        k, fp, n, start = _lists(left, 1 if key is not None else 2)
        comp = labelled(fp, right)
        size = np.diff(np.append(start, len(k)))
        mixed = np.maximum.reduceat(comp, start) != np.minimum.reduceat(comp, start)
        keep = np.repeat(mixed, size)
        out = []
        if keep.any() or key is not None:  # whether a spread key's list is mixed shows over all its groups
            stay = keep | (key is not None)
            values = (grp, key, sub, k[stay].tobytes(), fp[stay].tobytes(), n[stay].tobytes())
            out.append(pa.Table.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.array([v], f.type) for v, f in zip(values, ENTRIES, strict=True))], schema=CANDIDATES))
        if keep.any():
            k, fp, n, comp, size = k[keep], fp[keep], n[keep], comp[keep], size[mixed]
            start = np.cumsum(size) - size
            main = main_component(comp, start)
            lead = np.repeat(leaders(k, fp, start, salt, main), size)
            good = ~main & may_meet(n[lead], n)
            out.append(_told(distinct_pairs(fp[lead][good], fp[good])))
        return pa.concat_tables(out) if out else CANDIDATES.empty_table()

    return lists.groupBy("grp").cogroup(need.groupBy("grp")).applyInArrow(run, CANDIDATES_SQL)


def units(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that hold several components, in units that are compared apart (columns unit, side, keys, fps, ns).

    Lists of usual length stay grouped. The groups of a spread key meet in pairs: side 1 and 2 of a
    unit are two of them, side 0 is one by itself.
    """
    usual = lists.filter("key is null").select(F.col("grp").alias("unit"), F.lit(0).alias("side"), "keys", "fps", "ns")
    spread = lists.filter("key is not null")
    if not spread.limit(1).count():
        return usual
    found = members(spread).join(labels, "node", "left").groupBy("grp").agg(F.min(F.coalesce("label", "node")).alias("low"), F.max(F.coalesce("label", "node")).alias("high"))
    parts = save(spread.select("grp", "key", "sub").join(found, "grp"), "spread")
    # a struct per group of a key: as many as its count class asks for, not as it has members
    of_key = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("sub", "low", "high"))).alias("subs")).filter("array_min(transform(subs, x -> x.low)) < array_max(transform(subs, x -> x.high))")
    rows = spread.join(parts.select("grp", "low", "high"), "grp").join(of_key, "key").withColumn("other", F.explode("subs"))
    rows = rows.filter("other.sub = sub and low < high or other.sub <> sub and least(low, other.low) < greatest(high, other.high)")
    first, second = F.least("sub", "other.sub"), F.greatest("sub", "other.sub")
    side = F.when(first == second, 0).when(F.col("sub") == first, 1).otherwise(2)
    # units of usual lists are small numbers, those of spread keys have the sign bit
    name = F.xxhash64("key", first, second).bitwiseOR(F.lit(-(1 << 63)))
    return usual.unionByName(rows.select(name.alias("unit"), side.alias("side"), "keys", "fps", "ns"))


def remaining(parts: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of one list that lie in different components and may be similar by their
    signatures. A pair is made once, by the least key that its members share.

    Bits that differ between two bit maps are at most the shingles that differ between the sets, so
    that the signatures bound the overlap from above and no similar pair is left out.
    """
    spec = pa.schema([("unit", pa.int64()), ("node", pa.int64()), ("own", pa.binary()), ("short", pa.binary())])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit, ks, fps, ns in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k, fp, n = np.frombuffer(ks, "<u8"), np.frombuffer(fps, "<i8"), np.frombuffer(ns, "<i4")
                at = np.lexsort((k, fp))
                k, fp, n = k[at], fp[at], n[at]
                cuts = [0, *(np.flatnonzero(fp[1:] != fp[:-1]) + 1).tolist(), len(fp)]
                each = [slice(lo, hi) for lo, hi in zip(cuts, cuts[1:], strict=False)]
                own, short = ([x.tobytes() for x in xs] for xs in ([k[c] for c in each], [k[c][n[c] > 0] for c in each]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts) - 1, unit), pa.int64()), pa.array(fp[cuts[:-1]]), pa.array(own, pa.binary()), pa.array(short, pa.binary())], schema=spec)

    need = save(parts.select("unit", "keys", "fps", "ns").mapInArrow(tidied(told), "unit long, node long, own binary, short binary"), "need")
    own = need.groupBy("node").agg(*(F.array_distinct(F.collect_list(c)).alias(c) for c in ("own", "short")))
    known = own.join(sets.select(F.col("fp").alias("node"), "signature"), "node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "signature", "own", "short")
    need = need.select("unit", "node").distinct().join(known, "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        sides = sorted(set(left.column("side").to_pylist()))
        tables = [_lists(left.filter(pc.equal(left.column("side"), s)), 1) for s in sides]
        node = right.column("node").to_pylist()
        maps = dict(zip(node, right.column("signature").to_pylist(), strict=True))
        whole = lambda c: {x: np.unique(np.concatenate([np.frombuffer(y, "<u8") for y in ys])) for x, ys in zip(node, right.column(c).to_pylist(), strict=True)}
        own, short = whole("own"), whole("short")
        found: list[np.ndarray] = []
        if len(tables) == 1:
            k, fp, n, start = tables[0]
            comp = labelled(fp, right)
            size = np.diff(np.append(start, len(k)))
            main = main_component(comp, start)
            mixed = np.maximum.reduceat(comp, start) != np.minimum.reduceat(comp, start)
            for lo, m in zip(start[mixed], size[mixed], strict=True):
                at = slice(lo, lo + m)
                found += compared(int(k[lo]), fp[at], n[at], comp[at], main[at], None, maps, own, short)
        elif sides == [1, 2]:  # two groups of one key
            (k, fp, n, _), (_, fp2, n2, _) = tables
            comp, comp2 = labelled(fp, right), labelled(fp2, right)
            found += compared(int(k[0]), fp, n, comp, np.zeros(len(fp), bool), (fp2, n2, comp2), maps, own, short)
        if not found:
            return schema.empty_table()
        got = np.concatenate(found)
        return pa.Table.from_arrays([pa.array(np.minimum(got[:, 0], got[:, 1])), pa.array(np.maximum(got[:, 0], got[:, 1]))], schema=schema)

    return parts.groupBy("unit").cogroup(need.groupBy("unit")).applyInArrow(run, "a long, b long")


def compared(key: int, fp: np.ndarray, n: np.ndarray, comp: np.ndarray, main: np.ndarray, others: tuple | None, maps: dict, own: dict, short: dict) -> list[np.ndarray]:
    """The pairs of a list, or of a list with others, that differ in component, may be similar and meet under no key less than this one."""
    words = folded([maps[x] for x in fp.tolist()])
    fp2, n2, comp2 = others or (fp, n, comp)
    words2 = folded([maps[x] for x in fp2.tolist()]) if others else words
    if words.shape[1] != words2.shape[1]:  # fold the wider side once more
        width = min(words.shape[1], words2.shape[1])
        words, words2 = (np.bitwise_or.reduce(w.reshape(len(w), -1, width), axis=1) for w in (words, words2))
    at2 = np.arange(len(fp2))
    rest = np.flatnonzero(~main)
    out = []
    for cut in range(0, len(rest), 256):
        i = rest[cut : cut + 256, None]
        ok = (comp[i] != comp2[None, :]) & may_meet(n[i], n2[None, :])
        if not others:  # pairs with the largest component, and among the others each once
            ok &= main[None, :] | (at2[None, :] > i)
        x, y = np.nonzero(ok)
        one = i[x, 0]
        differ = np.concatenate([np.bitwise_count(words[one[q : q + 20_000]] ^ words2[y[q : q + 20_000]]).sum(axis=1, dtype=np.int64) for q in range(0, len(x), 20_000)] or [np.zeros(0, np.int64)])
        size, size2 = np.abs(n[one].astype(np.int64)), np.abs(n2[y].astype(np.int64))
        total = size + size2
        near = (NUM + DEN) * ((total - differ) // 2) >= NUM * total
        pairs = [(a, b) for a, b, m, m2 in zip(fp[one[near]].tolist(), fp2[y[near]].tolist(), size[near].tolist(), size2[near].tolist(), strict=True) if first_meeting(a, m, b, m2, own, short) == key]
        if pairs:
            out.append(np.array(pairs, np.int64))
    return out


def first_meeting(a: int, n: int, b: int, m: int, own: dict, short: dict) -> int:
    """The least key under which two sets of n and m meet: it is of the smaller one's short prefix."""
    found = [least_shared(short[a], own[b])] if n <= m else []
    found += [least_shared(short[b], own[a])] if m <= n else []
    return min((x for x in found if x >= 0), default=-1)


def least_shared(a: np.ndarray, b: np.ndarray) -> int:
    """The least number in both of two sorted arrays, -1 if there is none."""
    if not len(a) or not len(b):
        return -1
    if len(a) > len(b):
        a, b = b, a
    for lo in range(0, len(a), 64):
        piece = a[lo : lo + 64]
        at = np.minimum(np.searchsorted(b, piece), len(b) - 1)
        same = np.flatnonzero(b[at] == piece)
        if len(same):
            return int(piece[same[0]])
    return -1


def whole_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """fp, set and signature of the classes whose first document (column rep, null if none has a doc_id) is needed.

    The documents are found by a bit map of fixed size, so that no text is shuffled; what it lets
    through beyond them is left out by the join that follows. All rows without a doc_id are looked at.
    """
    at = F.pmod(F.xxhash64("rep"), F.lit(1 << MAP_BITS))
    # Spark's bit maps count from 1
    maps = needed.groupBy(F.bitmap_bucket_number(at + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("map"))
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in maps.collect():
        lo = (r["bucket"] - 1) * len(r["map"])
        bits[lo : lo + len(r["map"])] = np.frombuffer(r["map"], np.uint8)[: len(bits) - lo]
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    del bits
    trim()
    schema = pa.schema([("rep", pa.int64()), ("fp", pa.int64()), ("set", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2).to_numpy()
            want = ((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1) | b.column(0).is_null().to_numpy(zero_copy_only=False)
            b = b.filter(pa.array(want))
            for lo in range(0, b.num_rows, 256):
                piece = b.slice(lo, 256)
                sets = [shingles(x) for x in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([pack(s >> np.uint64(64 - SET_BITS)) for s in sets], pa.binary()), pa.array([signature(s) for s in sets], pa.binary())], schema=schema)

    found = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string")).withColumn("at", at)
    found = found.mapInArrow(tidied(run), "rep long, fp long, set binary, signature binary")
    sets = join_small(found, needed.filter("rep is not null"), ["rep", "fp"], "inner").select("fp", "set", "signature")
    nameless = needed.filter("rep is null").select("fp")
    if nameless.limit(1).count():
        sets = sets.unionByName(join_small(found.filter("rep is null"), nameless, ["fp"], "inner").select("fp", "set", "signature"))
    out = save(sets.dropDuplicates(["fp"]), "sets")
    shared.destroy()
    trim()
    return out


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = unpack(b.column(2)[i].as_py()), unpack(b.column(3)[i].as_py())
                both = np.concatenate((x, y))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                good[i] = DEN * same >= NUM * (len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=schema).filter(pa.array(good))

    # the pairs go to the members' sets if they are few, and only the sets of first members move
    members = join_small(sets.select(F.col("fp").alias("b"), F.col("set").alias("y")), pairs, ["b"], "inner")
    firsts = join_small(sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), pairs.select("a").distinct(), ["a"], "left_semi")
    return members.join(firsts, "a").select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long")


#: Further leaders that lists get before what is left is compared pair by pair.
SALTS = (1,)


def joined(docs: DataFrame, hot_from: int = HOT_FROM) -> DataFrame:
    """Per row of docs: doc_id, n, fp (of its set), component_id."""
    spark = docs.sparkSession
    part_bits = _parts(docs)
    seen = save(survey(docs, part_bits), "survey")
    known = save(seen.filter("n is not null").select("doc_id", "n", "fp"), "known")
    classes = save(known.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    counted = save(count(seen.filter("part is not null").select("part", "hashes", "counts"), part_bits), "counted")
    release(seen)  # the blocks of hashes, its bulk, are counted
    order = spark.sparkContext.broadcast(order_of(counted, part_bits))
    trim()
    found = save(stars(index(docs, order, part_bits, hot_from)), "stars")
    order.destroy()  # what it gave is written

    pairs = save(found.filter("a is not null").select("a", "b").dropDuplicates(), "pairs")
    lists = found.filter("grp is not null").select(*LIST)
    involved = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).union(members(lists).select("node")).dropDuplicates()
    needed = save(classes.join(involved, "fp"), "needed")
    sets = whole_sets(docs, needed)

    labels = components(save(verified(pairs, sets), "links"))

    def linked(more: DataFrame) -> None:
        nonlocal labels
        new = save(verified(more, sets), "links")
        if new.limit(1).count():
            labels = extended(labels, new)

    # more leaders for what the first ones left apart, in ever fewer lists
    for salt in SALTS:
        again = save(across(lists, labels, salt), "across")
        more = save(again.filter("a is not null").select("a", "b").dropDuplicates().join(pairs, ["a", "b"], "left_anti"), "more")
        lists = again.filter("grp is not null").select(*LIST)
        pairs = pairs.union(more)
        linked(more)
    # then all pairs that are still across components
    rest = save(units(lists, labels), "units")
    linked(save(remaining(rest, labels, sets).join(pairs, ["a", "b"], "left_anti"), "more"))

    named = classes.join(labels.withColumnRenamed("node", "fp"), "fp")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_class = classes.join(named.join(least, "label").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return known.join(save(by_class, "by_class"), "fp", "left").select("doc_id", "n", "fp", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_join(docs: DataFrame, hot_from: int = HOT_FROM) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id."""
    return joined(docs, hot_from).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that link to one of smaller doc_id; of rows alike in doc_id and set one stays.

    Rows without a doc_id and rows without words stay. Rows of one doc_id with different sets are judged apart.
    """
    known = save(joined(docs), "joined").filter("doc_id is not null")
    goes = (F.col("component_id") != F.col("doc_id")) & (F.col("n") > 0)
    ids = save(known.groupBy("doc_id").agg(F.bool_and(goes).alias("goes"), F.count("*").alias("n")).filter("goes or n > 1"), "ids")
    kept = join_small(docs, ids.filter("goes").select("doc_id"), ["doc_id"], "left_anti")
    again = ids.filter("not goes").select("doc_id")
    if not again.limit(1).count():
        return kept

    at, out = docs.columns.index("text"), StructType([*docs.schema.fields, StructField("_set", LongType()), StructField("_n", LongType())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fingerprint(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64())], names=[*b.schema.names, "_set", "_n"])

    rows = join_small(kept, again, ["doc_id"], "left_semi").mapInArrow(tidied(sets), out)
    leave = known.join(again, "doc_id").filter(goes).select("doc_id", F.col("fp").alias("_set")).distinct()
    rows = rows.join(leave, ["doc_id", "_set"], "left_anti").select(*out.names)
    rows = rows.filter("_n > 0").dropDuplicates(["doc_id", "_set"]).unionByName(rows.filter("_n = 0"))
    return join_small(kept, again, ["doc_id"], "left_anti").unionByName(rows.select(*docs.columns))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r(a, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1"""
