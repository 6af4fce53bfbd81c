"""Greedy grouping of rows by similar titles, in order, over whole titles."""

from __future__ import annotations

import math
import tempfile
from collections import Counter
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Titles that meet in one task, on each side. A block of more is compared in pairs of tiles.
TILE = 16384
#: Characters are counted by their code modulo this; counts that fall together only weaken the bound.
BINS = 64
#: Pairs of characters are counted likewise.
PAIR_BINS = 256
#: Bins that every pair is compared in, the most telling ones first, before the pairs that are left are compared in all.
FIRST_BINS = 24
#: From this length of the second text on, difflib passes over its frequent characters.
FREQUENT_FROM = 200
#: (length of a shared piece, length of the gram that stands for it), the longest first.
PIECES = ((16, 12), (13, 9), (10, 6))
#: Counts of grams by hash, which say which gram of a piece is the rarest; they have no influence on what is found.
BUCKETS = 1 << 18
#: Bits that say which keys leaders have: one for each character of theirs (some eight a key), at least and at most so many; keys that fall together are only written in vain.
FEWEST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 29
#: Titles whose grams are written together.
AT_ONCE = 200


def similar_titles(df: DataFrame, key: str, title_key: str, url_key: str | None, ordinal: str, ratio: float = 0.92, least: int = 24) -> DataFrame:
    """Per row: key and leader, the key of the row that leads its group.

    In the order of ordinal (ties: key, then title), a row joins the group of its url, if an earlier
    row had that url; else the first group whose leader has the same title or, with the same numbers in
    it, one of at least `ratio`, where both have at least `least` characters; else it leads a new group.
    Null titles are empty ones, null and empty urls are none. Repeated rows join the first of them.

    Which titles can be similar shows without a loss: their numbers agree, their lengths are near, and
    either they share a rare piece (_by_pieces), which holds for a long leader, or the characters they share
    suffice. For the latter, blocks of equal numbers and lengths in one band or in neighbouring ones are
    compared in tiles of fixed size, so that no block has to fit into a task; that work still grows with the
    square of a block of short titles. Leaders are found in rounds, as many as the longest chain that needs them.
    """
    spark = df.sparkSession
    if not (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docsignal-titles-"))
    url = F.nullif(F.col(url_key).cast("string"), F.lit("")) if url_key else F.lit(None).cast("string")
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(title_key), F.lit("")).alias("t"), url.alias("u"), F.col(ordinal).alias("o"))
    # ids order as rows do and tell unlike titles of one key apart
    rows = rows.select("t", "u", F.struct("o", "k", F.xxhash64("t").alias("h")).alias("id")).checkpoint()
    long_enough = F.length("t") >= least

    # only the first row of a url is judged by its title
    heads = rows.filter("u is not null").groupBy("u").agg(F.min(F.struct("id", "t")).alias("first")).select("u", "first.*")
    free = heads.unionByName(rows.filter("u is null").select("u", "id", "t"))
    classes = free.filter(long_enough).groupBy("t").agg(F.min("id").alias("id")).checkpoint()
    led = _followers(_links(classes, ratio))
    leaders = classes.join(led, "id", "left").select("t", F.coalesce("leader", "id").alias("leader"))

    judged = free.filter(long_enough).join(leaders, "t").select("u", "id", "leader")
    judged = judged.unionByName(free.filter(~long_enough).select("u", "id", F.col("id").alias("leader")))
    out = judged.filter("u is null").select("id", "leader")
    if url_key:
        out = out.unionByName(rows.filter("u is not null").select("u", "id").join(judged.select("u", "leader"), "u").select("id", "leader"))
    return out.select(F.col("id.k").alias(key), F.col("leader.k").alias("leader"))


def _piece(title: str, ratio: float) -> tuple[int, int, int]:
    """Of a leader: the characters that must agree, in how many blocks at most, and how long the longest is at least (0: not known).

    difflib starts a block at a character of the second text that is not frequent in it, or at both starts, so
    that there are no more blocks than such characters and one.
    """
    n = len(title)
    if n < FREQUENT_FROM:
        return 0, 0, 0
    blocks = 1 + sum(c for c in Counter(title).values() if c <= n // 100 + 1)
    agree = math.ceil(ratio / (2 - ratio) * n - 1e-6)
    return agree, blocks, -(-agree // blocks)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an odd number and of its inverse modulo 2 ** 64."""
    up, down = np.full(n, 1000003, np.uint64), np.full(n, pow(1000003, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _grams(title: str, size: int) -> np.ndarray:
    """Hashes of 53 bits."""
    codes = np.frombuffer(title.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = max(len(codes) - size + 1, 0)
    if not n:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(len(codes), 1 << 12).bit_length())
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * down[: len(codes)], out=sums[1:])
    h = (sums[size:] - sums[:n]) * up[size - 1 : size - 1 + n] + np.uint64(size)
    for shift, by in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return (h ^ (h >> np.uint64(32))) >> np.uint64(11)


def _rarity(classes: DataFrame) -> np.ndarray:
    """Per size of grams and bucket of their hashes how frequent they are, on a logarithmic scale below 1024."""
    wide = 1 << 14

    def run(batches):
        out = np.zeros((len(PIECES), BUCKETS), np.int64)
        for rows in batches:
            for t in rows["t"]:
                for k, (_, size) in enumerate(PIECES):
                    np.add.at(out[k], _grams(t, size) % np.uint64(BUCKETS), 1)
        if out.any():
            chunks = np.minimum(out, (1 << 32) - 1).astype("<u4").reshape(-1, wide)
            yield pd.DataFrame({"chunk": np.arange(len(chunks)), "n": [x.tobytes() for x in chunks]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(wide)
        for x in rows["n"]:
            n += np.frombuffer(x, "<u4")
        return pd.DataFrame({"chunk": rows["chunk"][:1], "n": [np.minimum(np.log2(n + 1) * 24, 1023).astype("<u2").tobytes()]})

    schema = "chunk long, n binary"
    got = classes.select("t").mapInPandas(run, schema).groupBy("chunk").applyInPandas(merge, schema).toPandas()
    out = np.zeros((len(PIECES) * BUCKETS // wide, wide), np.uint64)
    for chunk, x in zip(got["chunk"], got["n"]):
        out[chunk] = np.frombuffer(x, "<u2")
    return out.reshape(len(PIECES), BUCKETS)


def _keys(title: str, kind: int, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rarest gram of each piece of a title, the rarest first, of how many pieces it is that, and its first and last place as such. Equal pieces have equal ones at equal places in them."""
    size, gram = PIECES[kind]
    h = _grams(title, gram)
    n = len(h) - (size - gram)
    if n <= 0:
        none = np.zeros(0, np.int64)
        return h[:0], none, none, none
    h |= rarity[kind][h % np.uint64(BUCKETS)] << np.uint64(53)
    best, at = h[:n].copy(), np.arange(n)
    for i in range(1, size - gram + 1):
        less = np.flatnonzero(h[i : i + n] < best)
        best[less], at[less] = h[i + less], i + less
    order = np.argsort(best, kind="stable")
    best, at = best[order], at[order]  # places of equal grams rise
    first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    last = np.r_[first[1:], n] - 1
    return best[first], last - first + 1, at[first], at[last]


def _sought(title: str, kind: int, pieces: np.ndarray, ratio: float) -> tuple[np.ndarray, int]:
    """Which keys of a leader are looked for, the rarest, and for how many pieces those that are found must stand."""
    agree, blocks, _ = _piece(title, ratio)
    agree -= (PIECES[kind][0] - 1) * blocks
    sought = np.cumsum(pieces[::-1])[::-1] > (agree - 1) * 3 // 4
    return sought, agree - pieces[~sought].sum()


def _leaders_keys(leaders: DataFrame, rarity, ratio: float) -> np.ndarray:
    """Two rows of bits by slot: keys that are looked for by a leader at least, and by two."""
    chars = leaders.agg(F.sum(F.length("t"))).first()[0] or 0
    slots = min(max(FEWEST_SLOTS, 1 << (chars - 1).bit_length() if chars else 0), MOST_SLOTS)

    def run(batches):
        def pack(held):
            at = np.sort(np.concatenate(held))
            chunks, first = np.unique(at >> 20, return_index=True)
            return pd.DataFrame({"chunk": chunks, "slots": [x.astype("<u4").tobytes() for x in np.split(at & 0xFFFFF, first[1:])]})

        held, n = [], 0
        for part in batches:
            for t, numbers, kind in zip(part["t"], part["hn"], part["kind"]):
                keys, pieces, _, _ = _keys(t, kind, rarity.value)
                held.append((keys[_sought(t, kind, pieces, ratio)[0]].astype(np.int64) ^ numbers) & (slots - 1))
                n += len(held[-1])
                if n >= 1 << 22:
                    yield pack(held)
                    held, n = [], 0
        if n:
            yield pack(held)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(1 << 20, np.uint8)
        for x in rows["slots"]:
            n = np.minimum(n + np.minimum(np.bincount(np.frombuffer(x, "<u4"), minlength=1 << 20), 2), 2)
        return pd.DataFrame({"chunk": rows["chunk"][:1], "once": [np.packbits(n > 0, bitorder="little").tobytes()], "twice": [np.packbits(n > 1, bitorder="little").tobytes()]})

    got = leaders.mapInPandas(run, "chunk long, slots binary").groupBy("chunk").applyInPandas(merge, "chunk long, once binary, twice binary").toPandas()
    out = np.zeros((2, slots >> 20, 1 << 17), np.uint8)
    for chunk, *bits in zip(got["chunk"], got["once"], got["twice"]):
        for k in (0, 1):
            out[k, chunk] = np.frombuffer(bits[k], np.uint8)
    return out.reshape(2, -1)


def _by_pieces(rows: DataFrame, ratio: float) -> DataFrame:
    """Pairs n, leader of rows that share a piece which shows that they can be similar, leader before n, for all leaders that have a kind.

    A leader's longest block is at least as long as its kind of pieces, so that both titles hold a piece, and
    hence its rarest gram. All pieces inside blocks agree, so that their number has a least; a leader
    gives away its most frequent grams as long as they stand for less than three quarters of it, and the rest must be found.
    A block shifts a piece by no more characters than are left unmatched before it, and the rest of both titles by
    no more than after it, so that grams at far places do not count: most that agree by chance are. Keys
    that no other leader looks for are not written.
    """
    given = rows.select("n", "t", "hn", "kind")
    shared = rows.sparkSession.sparkContext.broadcast(_rarity(rows))
    wanted = rows.sparkSession.sparkContext.broadcast(_leaders_keys(given.filter("kind >= 0"), shared, ratio))

    def run(batches, leads: bool):
        for part in batches:
            for at in range(0, len(part), AT_ONCE):
                some = part.iloc[at : at + AT_ONCE]
                found, times, places, of = [], [], [], []
                for row, t, numbers, kind in zip(some["n"], some["t"], some["hn"], some["kind"]):
                    for k in [kind] if leads else range(len(PIECES)):
                        keys, pieces, first, last = _keys(t, k, shared.value)
                        sought, least = _sought(t, k, pieces, ratio) if k == kind else (np.zeros(len(keys), bool), 0)
                        keys = (keys.astype(np.int64) ^ numbers) & ((1 << 48) - 1)  # shorter to write
                        if not leads:
                            slots = keys & (8 * wanted.value.shape[1] - 1)
                            # one's own does not count
                            sought = (wanted.value[sought.astype(np.int64), slots >> 3] >> (slots & 7)) & 1 > 0
                        keys, pieces, first, last = keys[sought], pieces[sought], first[sought], last[sought]
                        found.append(keys)
                        times.append(pieces)
                        places.append((first, last - first))
                        of.append((row, len(t), least, len(keys)))
                n, size, least, many = np.array(of).T
                first, more = np.concatenate(places, axis=1)
                yield pd.DataFrame({"key": np.concatenate(found), "n": np.repeat(n, many), "size": np.repeat(size, many), "first": first, "more": more, "pieces": np.concatenate(times), "least": np.repeat(least, many)})

    schema = "key long, n long, size int, first int, more int, pieces int, least int"
    leaders = given.filter("kind >= 0").mapInPandas(lambda b: run(b, True), schema).withColumnsRenamed({"n": "leader", "size": "of", "first": "first_of", "more": "more_of"})
    least = FREQUENT_FROM * ratio / (2 - ratio) - 1
    others = given.filter(F.length("t") >= least).mapInPandas(lambda b: run(b, False), schema).select("key", "n", "size", "first", "more")
    # by how much a place in the leader lies beyond that in the other: from low to high; without unmatched characters besides the longer one's: from 0 to longer
    longer, zero = F.col("of") - F.col("size"), F.lit(0)
    low, high = F.col("first_of") - F.col("first") - F.col("more"), F.col("first_of") + F.col("more_of") - F.col("first")
    unmatched = F.abs(longer) + 2 * F.greatest(zero, low - F.greatest(zero, longer), F.least(zero, longer) - high)
    near = (F.col("leader") < F.col("n")) & (unmatched <= (1 - ratio) * (F.col("of") + F.col("size")) + 1e-6)
    met = others.join(leaders, "key").filter(near).groupBy("n", "leader").agg(F.sum("pieces").alias("pieces"), F.first("least").alias("least"))
    return met.filter("pieces >= least").select("n", "leader")


def _tiles(rows: DataFrame, ratio: float) -> DataFrame:
    """Columns unit, side, id, t, plain: the tiles that meet, of plain rows with each other and with the rest. A unit has one side 0, or a side 1 and a side 2."""
    # 2 min >= ratio (a + b), so that the longer one has at most this many times the length of the shorter
    step = math.log((2 - ratio) / ratio * (1 + 1e-9))
    rows = rows.withColumns({"band": F.floor(F.log(F.length("t")) / step), "plain": F.col("kind") < 0})
    at = ["numbers", "band", "plain"]
    n = rows.groupBy(*at).agg(F.ceil(F.count("*") / TILE).alias("parts")).checkpoint()
    rows = rows.join(n, at).withColumn("p", F.pmod(F.xxhash64("t"), "parts"))
    parts = n.select("numbers", "band", "plain", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"))
    one = parts.filter("plain").select("numbers", F.col("band").alias("b1"), F.col("p").alias("p1"), F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("b2"))
    two = parts.select("numbers", F.col("band").alias("b2"), F.col("plain").alias("plain2"), F.col("p").alias("p2"))
    met = one.join(two, ["numbers", "b2"]).filter(~F.col("plain2") | (F.struct("b1", "p1") <= F.struct("b2", "p2")))
    same = F.col("plain2") & (F.col("b1") == F.col("b2")) & (F.col("p1") == F.col("p2"))

    def side(band: str, plain: Column, p: str, k: int) -> Column:
        return F.struct(F.col(band).alias("band"), plain.alias("plain"), F.col(p).alias("p"), F.when(same, 0).otherwise(k).alias("side"))

    first, second = side("b1", F.lit(True), "p1", 1), side("b2", F.col("plain2"), "p2", 2)
    met = met.select("numbers", F.struct("numbers", "b1", "p1", "b2", "plain2", "p2").alias("unit"), F.explode(F.when(same, F.array(first)).otherwise(F.array(first, second))).alias("s"))
    return rows.join(met.select("numbers", "unit", "s.*"), [*at, "p"]).select("unit", "side", "id", "t", "plain")


def _counts(titles: list[str]) -> np.ndarray:
    out = np.zeros((len(titles), BINS), np.int32)
    for i, t in enumerate(titles):
        out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") % BINS, minlength=BINS)
    return out


def _pair_counts(titles: list[str]) -> np.ndarray:
    """Pairs of neighbouring characters; more than 255 count as 255, which only weakens the bound."""
    out = np.zeros((len(titles), PAIR_BINS), np.uint8)
    for i, t in enumerate(titles):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        out[i] = np.minimum(np.bincount((codes[:-1] * 31 + codes[1:]) % PAIR_BINS, minlength=PAIR_BINS), 255)
    return out


def _near(counts: np.ndarray, pairs: np.ndarray, leads: np.ndarray, ratio: float, high: int = 32, wide: int = 8192):
    """Pairs i, j in arrays, i before j and leading, of rows that share characters, and pairs of them, enough."""
    size = counts.sum(axis=1)
    least, span = counts.min(axis=0), np.ptp(counts, axis=0)
    bins = np.argsort(-counts.std(axis=0))[:FIRST_BINS]
    bins = bins[span[bins] > 0]
    kind = np.uint8 if len(bins) == 0 or span[bins].max() <= 255 else np.int32
    few = np.ascontiguousarray((counts - least)[:, bins].T.astype(kind))
    # sums of bytes that cannot overflow
    groups, room = [], -1
    for g, b in enumerate(bins.tolist()):
        room -= span[b]
        if room < 0 and kind is np.uint8 or not groups:
            groups.append([])
            room = 255 - span[b]
        groups[-1].append(g)
    sums = np.uint16 if kind is np.uint8 else np.int32
    most = np.floor((1 - ratio) * size * (1 + (2 - ratio) / ratio) + 1e-6)
    most = np.minimum(most, np.iinfo(sums).max).astype(sums)
    who = np.flatnonzero(leads)
    for at in range(0, len(who), high):
        a = who[at : at + high]
        for x in range(int(a[0]) + 1, len(counts), wide):
            y = min(x + wide, len(counts))
            whole = np.zeros((len(a), y - x), sums)
            up, down = np.empty(whole.shape, kind), np.empty(whole.shape, kind)
            for group in groups:
                part = np.zeros(whole.shape, kind)
                for g in group:
                    np.maximum(few[g, a][:, None], few[g, x:y][None], out=up)
                    np.minimum(few[g, a][:, None], few[g, x:y][None], out=down)
                    np.subtract(up, down, out=up)
                    np.add(part, up, out=part)
                np.add(whole, part, out=whole)
            i, j = np.nonzero(whole <= most[a][:, None])
            i, j = a[i], j + x
            i, j = i[j > i], j[j > i]
            for z in range(0, len(i), 1 << 16):
                u, v = i[z : z + (1 << 16)], j[z : z + (1 << 16)]
                both = size[u] + size[v]
                fits = both - np.abs(counts[u] - counts[v]).sum(axis=1) >= ratio * both - 1e-6
                u, v, both = u[fits], v[fits], both[fits]
                # putting in a character takes away one pair and adds two
                unlike = np.concatenate([(np.maximum(pairs[s], pairs[r]) - np.minimum(pairs[s], pairs[r])).sum(axis=1, dtype=np.int64) for s, r in ((u[w : w + 4096], v[w : w + 4096]) for w in range(0, len(u) or 1, 4096))])
                fits = unlike <= 3 * (1 - ratio) * both + 1e-6
                yield u[fits], v[fits]


class _Leader:
    """Compares titles with one that leads."""

    def __init__(self, title: str, ratio: float):
        from difflib import SequenceMatcher

        self.title, self.ratio = title, ratio
        self.matcher = SequenceMatcher(None, "", title)  # the leader is the second one
        self.at: dict[str, int] = {}
        for i, c in enumerate(title):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def common(self, title: str) -> int:
        """Length of the longest common subsequence, by bits."""
        whole = (1 << len(self.title)) - 1
        v = whole
        for c in title:
            u = v & self.at.get(c, 0)
            v = ((v + u) | (v - u)) & whole
        return len(self.title) - v.bit_count()

    def similar(self, title: str) -> bool:
        # what difflib matches is a common subsequence
        if 2 * self.common(title) < self.ratio * (len(title) + len(self.title)) - 1e-6:
            return False
        # what difflib's ratio() does, the widest gaps first, until the rest cannot change the answer
        self.matcher.set_seq1(title)
        both = len(title) + len(self.title)
        gaps = [(-min(len(title), len(self.title)), 0, len(title), 0, len(self.title))]
        matched, open_ = 0, -gaps[0][0]
        while 2.0 * (matched + open_) / both >= self.ratio:
            if 2.0 * matched / both >= self.ratio:
                return True
            if not gaps:
                break
            least, alo, ahi, blo, bhi = heappop(gaps)
            open_ += least
            i, j, n = self.matcher.find_longest_match(alo, ahi, blo, bhi)
            if n:
                matched += n
                for a0, a1, b0, b1 in ((alo, i, blo, j), (i + n, ahi, j + n, bhi)):
                    if a0 < a1 and b0 < b1:
                        heappush(gaps, (-min(a1 - a0, b1 - b0), a0, a1, b0, b1))
                        open_ += min(a1 - a0, b1 - b0)
        return False


def _links(classes: DataFrame, ratio: float) -> DataFrame:
    """Pairs a, b of ids whose titles are similar, a before b."""
    of_id = classes.schema["id"].dataType.simpleString()
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema["id"].dataType.fields}
    schema = ", ".join(f"{s}{c} {kind}" for s in "ab" for c, kind in kinds.items())

    @F.pandas_udf("int")
    def kind(titles: pd.Series) -> pd.Series:
        longest = (_piece(t, ratio)[2] for t in titles)
        return pd.Series([next((k for k, (size, _) in enumerate(PIECES) if size <= n), -1) for n in longest], dtype="int32")

    # n orders as ids do; work by the row is long and its bytes are few, so that Spark would put it into too few tasks
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.repartitionByRange(tasks, "id").sortWithinPartitions("id").withColumn("numbers", F.concat_ws(" ", F.regexp_extract_all("t", F.lit(r"(?U)\d+"), F.lit(0))))
    rows = rows.withColumns({"hn": F.xxhash64("numbers"), "kind": kind("t"), "n": F.monotonically_increasing_id()}).checkpoint()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["o", "k", "h"], ignore_index=True)
        titles, side = rows["t"].tolist(), rows["side"].to_numpy()
        found, leader, who = [], None, -1
        for i, j in _near(_counts(titles), _pair_counts(titles), rows["plain"].to_numpy(), ratio):
            met = (side[i] != side[j]) | (side[i] == 0)
            for a, b in zip(i[met].tolist(), j[met].tolist()):
                if a != who:
                    leader, who = _Leader(titles[a], ratio), a
                if leader.similar(titles[b]):
                    found.append((a, b))
        a, b = (rows.iloc[[x[s] for x in found]][["o", "k", "h"]].reset_index(drop=True) for s in (0, 1))
        return pd.concat([a.add_prefix("a"), b.add_prefix("b")], axis=1)

    @F.pandas_udf("boolean")
    def similar(leaders: pd.Series, titles: pd.Series) -> pd.Series:
        out, leader = [], None
        for a, b in zip(leaders, titles):
            na, nb = _counts([a, b])
            both = len(a) + len(b)
            ok = both - np.abs(na - nb).sum() >= ratio * both - 1e-6
            if ok and (leader is None or leader.title != a):
                leader = _Leader(a, ratio)
            out.append(bool(ok and leader.similar(b)))
        return pd.Series(out, dtype=bool)

    by_tiles = _tiles(rows, ratio).select("unit", "side", F.col("id.*"), "t", "plain").repartition(2 * tasks, "unit").groupBy("unit").applyInPandas(run, schema)
    by_tiles = by_tiles.select(*(F.struct(*(F.col(f"{s}{c}").alias(c) for c in kinds)).cast(of_id).alias(s) for s in "ab"))
    of = lambda n, s: rows.select(F.col("n").alias(n), F.col("id").alias(s), F.col("t").alias(f"t{s}"), F.col("numbers").alias(f"numbers{s}"))
    # pairs of a leader lie together, in its task one after the other
    pairs = _by_pieces(rows, ratio).join(of("n", "b"), "n").repartition(tasks, "leader")
    pairs = pairs.join(of("leader", "a").repartition(tasks, "leader").hint("merge"), "leader").filter("a < b AND numbersa = numbersb")
    by_pieces = pairs.filter(similar("ta", "tb")).select("a", "b")
    return by_tiles.unionByName(by_pieces).checkpoint()


def _followers(links: DataFrame) -> DataFrame:
    """id, leader of all that do not lead. The first in order of those that are linked leads; who is linked to a leader before it follows."""
    left = links
    led = None
    while left.limit(1).count():
        heads = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        new = left.join(heads, "a", "left_semi").select("b").distinct().checkpoint()
        led = new if led is None else led.unionByName(new)
        left = left.join(new, "b", "left_anti").join(new.select(F.col("b").alias("a")), "a", "left_anti").checkpoint()
    if led is None:
        return links.select(F.col("b").alias("id"), F.col("a").alias("leader"))
    to_leaders = links.join(led.select(F.col("b").alias("a")), "a", "left_anti")
    return to_leaders.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
