"""URL filters by association rules (operator 10), DataFrame functions only.

Fixed rules (host, path prefix) judge the urls that they fit, the longest rule winning. Their verdicts,
and those of labelled urls where such are given, are the labels. A labelled url is a transaction: its tokens
(host families, the host labels before them and their words, path segments, query keys) and its label. Spark's
FP-growth finds the frequent combinations, and those that imply a verdict are rules. Rules pruned by support,
confidence, chance and redundancy judge the urls without a fixed rule, through an inverted index from token to
rules. A rule needs a token that no fixed rule tests, lest it restate a fixed rule more broadly than it was
written. A url that no rule fits is allowed.

Tokens that stand in the same urls are one item, and a token that settles a verdict by itself is none, so that
a transaction holds few items: the whole url's tokens, and frequent ones among them only.

Defined results: a null url, or one without ://, has empty host and path, fits no rule and is allowed.
Ties between mined rules go to the greater confidence, then support, then to block. Repeated rows are
judged alike. An empty table gives an empty result; without labelled urls nothing is mined. Columns
other than page_id and url are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, save, table

#: (host, path prefix, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LABEL = "label="
VERDICTS = ("allow", "block")
INDEX = "map<string,array<struct<rule:int,need:int,confidence:double,support:double,verdict:string,name:string>>>"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, AFTER, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AFTER, 2), F.lit(""))


def fixed(rules: tuple[tuple[str, str, str], ...], of: int) -> Column:
    """The longest fitting rule's text (of=0) or verdict (of=1), else null. Columns host and path."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        value = F.lit((h + p, verdict)[of])
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("string")


def tested(rules: tuple[tuple[str, str, str], ...]) -> list[str]:
    """The tokens that fixed rules test."""
    out = set()
    for h, p, _ in rules:
        labels = h.split(".")
        out |= {f"h:{labels[-1]}", *([f"d:{'.'.join(labels[-2:])}"] if len(labels) > 1 else []), *(f"s:{x}" for x in labels[:-2])}
        out |= {f"p:{x}" for x in p.split("/") if x}
    return sorted(out)


def tokens() -> Column:
    """Distinct tokens of a whole url: last label of the host, last two, all before them and their words, path segments without digits, query keys."""
    labels = F.filter(F.split("host", r"\."), lambda s: s != "")
    n = F.size(labels)
    first = F.when(n > 1, F.slice(labels, 1, F.greatest(n - 2, F.lit(1))))
    words = F.flatten(F.transform(F.filter(first, lambda s: F.contains(s, F.lit("-"))), lambda s: F.split(s, "-")))
    segments = F.filter(F.split("path", "/"), lambda s: (s != "") & ~s.rlike("[0-9]"))
    keys = F.regexp_extract_all(F.regexp_extract("url", r"(?s)\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    keys = F.when(F.size(keys) > 0, F.array(F.array_join(F.array_sort(F.array_distinct(keys)), "&")))
    named = lambda kind, items: F.coalesce(F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x)), F.array())
    family = F.when(n > 1, F.array(F.concat_ws(".", F.slice(labels, -2, 2))))
    return F.array_distinct(F.concat(named("h:", F.when(n > 0, F.slice(labels, -1, 1))), named("d:", family), named("s:", F.when(n > 2, first)), named("w:", words), named("p:", segments), named("q:", keys)))


def implies(n: int, any_: int, share: float, least: int, confidence: float, deviations: float) -> bool:
    """Whether n of the any_ urls that a combination fits speak well enough for a verdict of this share."""
    return n >= least and n >= confidence * any_ and n / any_ > share + deviations * math.sqrt(share * (1 - share) / any_)


def mine(known: DataFrame, support: float, confidence: float, least: int = 20, deviations: float = 3.0, plain: tuple[str, ...] = ()) -> list[dict]:
    """Rules over columns tokens and verdict (null: no label, not looked at) whose consequent is a verdict.

    A rule holds in at least `least` labelled urls and the share `support` of them, at the confidence asked,
    and its verdict is likelier with it than without it by so many standard deviations. It goes if one with
    part of its tokens and the same verdict is as confident, and if all its tokens are plain.
    """
    rows = known.filter(F.col("verdict").isin(*VERDICTS)).select(F.array_distinct("tokens").alias("tokens"), "verdict")
    total, *by_verdict = rows.agg(F.count("*"), *(F.count_if(F.col("verdict") == v) for v in VERDICTS)).first()
    share = {v: n / total for v, n in zip(VERDICTS, by_verdict, strict=True) if n}
    least = max(least, math.ceil(support * total))
    if not share or total < least:
        return []
    # urls of a token by a sum of hashes: the same sum, the same urls
    each = rows.select(F.explode("tokens").alias("t"), "verdict", F.xxhash64(F.array_sort("tokens")).bitwiseAND((1 << 40) - 1).alias("h"))
    counts = each.groupBy("t").agg(F.count("*").alias("n"), F.sum("h").alias("h"), *(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS))
    item_of: dict[tuple, str] = {}
    items: dict[str, str] = {}
    for r in sorted(counts.filter(F.greatest(*VERDICTS) >= least).collect(), key=lambda r: (r["t"] not in plain, r["t"])):
        # of tokens in the same urls the first stands for all, a plain one if there is one
        items[r["t"]] = item_of.setdefault((r["n"], r["h"], *(r[v] for v in VERDICTS)), r["t"])
    pure = {key[:2]: t for key, t in item_of.items() if any(n == key[0] for n in key[2:])}
    settled = {t for t in pure.values() if t not in plain}
    found = [(frozenset([t]), v, key[2 + i], key[0]) for key, t in item_of.items() for i, v in enumerate(VERDICTS)]
    mixed = {t: i for t, i in items.items() if i not in settled}
    if mixed:
        at = F.from_json(F.lit(json.dumps(mixed)), "map<string,string>")
        baskets = rows.select(F.array_compact(F.array_distinct(F.transform("tokens", lambda t: F.try_element_at(at, t)))).alias("tokens"), "verdict")
        baskets = save(baskets.select(F.array_append("tokens", F.concat(F.lit(LABEL), "verdict")).alias("items")), "baskets")
        parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        held = {frozenset(r["items"]): r["freq"] for r in FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, numPartitions=parts).fit(baskets).freqItemsets.collect()}
        release(baskets)
        for whole, n in held.items():
            label = [x for x in whole if x.startswith(LABEL)]
            own = frozenset(x for x in whole if not x.startswith(LABEL))
            if label and len(own) > 1:
                found.append((own, label[0][len(LABEL) :], n, held[own]))
    kept: list[dict] = []
    by_token: dict[str, list[dict]] = {}
    for own, v, n, any_ in sorted(found, key=lambda x: (len(x[0]), sorted(x[0]), x[1])):
        if own <= set(plain) or v not in share or not implies(n, any_, share[v], least, confidence, deviations):
            continue
        if any(k["verdict"] == v and k["confidence"] >= n / any_ and own.issuperset(k["tokens"]) for t in own for k in by_token.get(t, [])):
            continue
        rule = {"tokens": sorted(own), "verdict": v, "confidence": n / any_, "support": n / total}
        kept.append(rule)
        by_token.setdefault(rule["tokens"][0], []).append(rule)
    return kept


def judged(rules: list[dict]) -> Column:
    """struct(verdict, name) of the best mined rule for column tokens, null if none fits: each token gives the rules that hold it; a rule fits if all its tokens gave it."""
    if not rules:
        return F.lit(None).cast("struct<verdict:string,name:string>")
    index: dict[str, list[dict]] = {}
    for i, r in enumerate(rules):
        for t in r["tokens"]:
            index.setdefault(t, []).append({"rule": i, "need": len(r["tokens"]), "confidence": r["confidence"], "support": r["support"], "verdict": r["verdict"], "name": " ".join(r["tokens"])})
    at = F.from_json(F.lit(json.dumps(index)), INDEX)
    hits = F.flatten(F.array_compact(F.transform("tokens", lambda t: F.try_element_at(at, t))))
    whole = F.filter(hits, lambda h: F.size(F.filter(hits, lambda x: x["rule"] == h["rule"])) == h["need"])
    best = F.array_max(F.transform(whole, lambda h: F.struct(h["confidence"].alias("c"), h["support"].alias("s"), h["verdict"].alias("verdict"), h["name"].alias("name"))))
    return F.when(best.isNotNull(), F.struct(best["verdict"].alias("verdict"), best["name"].alias("name")))


def read(urls: DataFrame) -> DataFrame:
    return urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumn("tokens", tokens())


def url_rules(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, labels: DataFrame | None = None, support: float = 0.001, confidence: float = 0.8) -> DataFrame:
    """page_id, host, path, rule, verdict, and mined: the mined rule that decided, if one did.

    labels: further labelled urls (url, verdict), which count as rows of their own where the rules are mined.
    """
    known = read(pages.select("page_id", "url")).withColumns({"rule": fixed(rules, 0), "fixed": fixed(rules, 1)})
    rows = known.select("tokens", F.col("fixed").alias("verdict"))
    if labels is not None:
        rows = rows.unionByName(read(labels.select("url", "verdict")).select("tokens", "verdict"))
    own = judged(mine(rows, support, confidence, plain=tuple(tested(rules))))
    found = known.withColumn("own", F.when(F.col("fixed").isNull(), own))
    return found.select("page_id", "host", "path", "rule", F.coalesce("fixed", "own.verdict", F.lit("allow")).alias("verdict"), F.col("own.name").alias("mined"))


def held_out(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, support: float = 0.001, confidence: float = 0.8, folds: int = 5) -> DataFrame:
    """How rules that are mined without a fold of the urls with a fixed rule judge that fold: verdict, mined, n."""
    known = read(pages.select("page_id", "url")).withColumn("verdict", fixed(rules, 1)).filter("verdict is not null")
    fold = F.pmod(F.xxhash64("url"), F.lit(folds))
    own = judged(mine(known.filter(fold != 0), support, confidence, plain=tuple(tested(rules))))
    return known.filter(fold == 0).groupBy("verdict", own["verdict"].alias("mined")).agg(F.count("*").alias("n"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules(table(spark, sf_dir, "pages"))
