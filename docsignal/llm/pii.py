"""Personal data by weak-supervision aggregation (operator 5), DataFrame functions only.

Base spans come from fixed patterns and checks and always stay. Wider patterns propose further spans
(written-out addresses, cards and numbers in other spellings). Five labelers, pattern, gazetteer,
checksum, context words and borders, vote on every span or abstain; expectation-maximisation over the
counted vote patterns of all documents estimates their reliabilities; the posteriors train a logistic
classifier of spans, which adds those proposals that it takes for personal data. The pattern counts are
at most kinds x 3 ** labelers rows, and the two fits run over them on the driver.

Offsets count code points. Defined results: null text counts as empty and has no spans. Proposals that
touch a base span are left out, of overlapping proposals the first by (start, kind) stays. Repeated
rows get equal results. An empty table gives an empty result. A null doc_id is carried. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import weak
from .common import save, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. \G or a look-behind lets a match start only where a run starts, which finds the
#: same leftmost matches without trying each place inside a long run; possessive repeats do not recurse.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": r"(?i)(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]{1,3}+(?:\[\.\][0-9]{1,3}){3}",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20./-]?[0-9]){12,18}",
    "phone": r"(?:\G|(?<![0-9+]))(?:00[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: A cheap test that a text must pass to be searched.
HINT = {"email": "@", "phone": "+"}
WIDER_HINT = {"email": r"(?i)[\[(]at[\])]", "ip": r"\[\.\]", "card": r"[0-9][\x20./-]?[0-9][\x20./-]?[0-9][\x20./-]?[0-9]", "phone": r"[0-9]{3}"}
LABELERS = ("pattern", "gazetteer", "checksum", "context", "borders")
#: Where the labelers' reliabilities start: pattern and checksum are exact tests, the others hints.
START = (0.9, 0.7, 0.95, 0.7, 0.7)
TOP_DOMAINS = "com org net edu gov mil int info biz io de fr es it uk nl pl ru cn jp br in eu ch at be se no dk fi pt mx ar ca au us"
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel|schreib",
    "ip": r"\bip\b|host|server|addr|login|client",
    "card": "card|visa|master|karte|tarjeta|carte|credit|pay",
    "phone": r"phone|\btel|call|mobil|fax|ruf|llam|appel",
}
AGAINST = r"isbn|version|\bv\.?$|invoice|order|serial|\bart\b|\bref\b|\bsku\b|build|doi"
CHUNK = 128
LOW = -(1 << 31)
#: Code points of the pieces that a text is cut into where its spans are replaced.
PIECE = 1024


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substr(digits, i, F.lit(1)).cast("int") + 1) * F.pmod(n - i, F.lit(2)) + F.substr(digits, i, F.lit(1)).cast("int") * F.pmod(n - i + 1, F.lit(2)),
    )
    return total % 10 == 0


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def valid(kind: str, match: Column) -> Column:
    """The base check of a match."""
    n = F.length(digits_of(match))
    if kind == "ip":
        return match.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits_of(match))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def found(df: DataFrame, patterns: dict[str, str], hints: dict[str, Column], prefix: str) -> DataFrame:
    """Adds a column of spans for each kind: the leftmost non-overlapping matches with their places and surroundings.

    A place is the sum of the lengths of what the pattern leaves between matches and of the matches
    before it, summed in chunks so that thousands of matches in a text stay cheap; the surroundings are
    taken from those gaps too, so that no text is walked through again for a match. Each step is a
    column of its own that is named twice after, for expressions that lambdas name once would be
    evaluated again for each element.
    """
    text = F.col("text")
    none = F.array().cast("array<string>")
    df = df.withColumns({f"{prefix}m_{k}": F.when(hints[k], F.regexp_extract_all(text, F.lit(patterns[k]), F.lit(0))).otherwise(none) for k in KINDS})
    df = df.withColumns({f"{prefix}g_{k}": F.when(F.size(f"{prefix}m_{k}") > 0, F.split(text, patterns[k], -1)).otherwise(none) for k in KINDS})
    df = df.withColumns({f"{prefix}l_{k}": F.zip_with(F.slice(f"{prefix}g_{k}", F.lit(1), F.size(f"{prefix}m_{k}")), f"{prefix}m_{k}", lambda g, m: F.length(g) + F.length(m)) for k in KINDS})

    def offsets(lens: Column) -> Column:
        chunks = F.floor(F.size(lens) / CHUNK).cast("int")
        step = lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(F.slice(lens, (c - 1) * CHUNK + 1, F.lit(CHUNK)), F.lit(0), lambda a, x: a + x)))
        return F.aggregate(F.when(chunks > 0, F.sequence(F.lit(1), chunks)).otherwise(F.array().cast("array<int>")), F.array(F.lit(0)), step)

    df = df.withColumns({f"{prefix}o_{k}": offsets(F.col(f"{prefix}l_{k}")) for k in KINDS})

    def place(k: str) -> Column:
        m, gaps, lens, before = (F.col(f"{prefix}{x}_{k}") for x in "mglo")

        def one(match: Column, i: Column) -> Column:
            chunk = F.floor(i / CHUNK).cast("int")
            end = F.element_at(before, F.least(chunk + 1, F.size(before))) + F.aggregate(F.slice(lens, chunk * CHUNK + 1, i - chunk * CHUNK + 1), F.lit(0), lambda a, x: a + x)
            gap, after = F.element_at(gaps, i + 1), F.element_at(gaps, i + 2)
            # where two matches touch, each is the other's border
            left = F.when((gap == "") & (i > 0), F.right(F.element_at(m, F.greatest(i, F.lit(1))), F.lit(1))).otherwise(F.right(gap, F.lit(1)))
            right = F.when((after == "") & (i + 1 < F.size(m)), F.left(F.element_at(m, F.least(i + 2, F.size(m))), F.lit(1))).otherwise(F.left(after, F.lit(1)))
            return F.struct(
                (end - F.length(match)).alias("start"), F.lit(KINDS.index(k)).alias("ord"), end.alias("end"), F.lit(k).alias("kind"), match.alias("match"),
                F.lower(F.right(gap, F.lit(24))).alias("before"), left.alias("left"), right.alias("right"),
            )

        return F.transform(m, one)

    df = df.withColumns({f"{prefix}{k}": place(k) for k in KINDS})
    return df.drop(*(f"{prefix}{step}_{k}" for step in "mglo" for k in KINDS))


def max_before(df: DataFrame, values: str, out: str) -> DataFrame:
    """Adds out: for each of an array of whole numbers the greatest of those before it, LOW for the first; by chunks, as in found()."""
    a, tops = F.col(values), F.col(f"{out}_tops")
    chunks = F.floor(F.size(a) / CHUNK).cast("int")
    none = F.array().cast("array<int>")
    each = F.transform(F.when(chunks > 0, F.sequence(F.lit(1), chunks)).otherwise(none), lambda c: F.array_max(F.slice(a, (c - 1) * CHUNK + 1, F.lit(CHUNK))))
    df = df.withColumn(f"{out}_tops", F.aggregate(each, F.array(F.lit(LOW)), lambda acc, x: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), x)))))

    def one(x: Column, i: Column) -> Column:
        chunk = F.floor(i / CHUNK).cast("int")
        return F.greatest(F.element_at(tops, F.least(chunk + 1, F.size(tops))), F.array_max(F.slice(a, chunk * CHUNK + 1, i - chunk * CHUNK)))

    return df.withColumn(out, F.transform(a, one)).drop(f"{out}_tops")


def apart(df: DataFrame) -> DataFrame:
    """Column wider without the spans that touch one of base, or an earlier one of wider. Both are in order."""
    tagged = lambda c, w: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(w).alias("wide"), s.alias("span")))
    some = F.size("wider") > 0
    both = F.array_sort(F.concat(tagged("base", 0), tagged("wider", 1)))
    df = df.withColumn("both", F.when(some, both).otherwise(F.slice(tagged("wider", 1), F.lit(1), F.lit(0))))
    df = df.withColumns({
        "ends": F.transform("both", lambda s: F.when(s["wide"] == 0, s["span"]["end"]).otherwise(LOW)),
        "starts": F.reverse(F.transform("both", lambda s: F.when(s["wide"] == 0, -s["start"]).otherwise(LOW))),
    })
    df = max_before(max_before(df, "ends", "held"), "starts", "next")
    free = F.filter(F.arrays_zip("both", "held", F.reverse("next").alias("next")), lambda x: (x["both"]["wide"] == 1) & (x["held"] <= x["both"]["start"]) & ((x["next"] == LOW) | (-x["next"] >= x["both"]["span"]["end"])))
    df = df.withColumn("wider", F.transform(free, lambda x: x["both"]["span"])).drop("both", "ends", "starts", "held", "next")
    df = max_before(df.withColumn("ends", F.transform("wider", lambda s: s["end"])), "ends", "held")
    first = F.filter(F.arrays_zip("wider", "held"), lambda x: x["held"] <= x["wider"]["start"])
    return df.withColumn("wider", F.transform(first, lambda x: x["wider"])).drop("ends", "held")


def text_of(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, 0).otherwise(-1)


def voted(span: Column, base: bool) -> Column:
    """The labelers' votes on a span, as a struct with its place. The context reaches back to the last match of the kind."""
    kind, match = span["kind"], span["match"]
    digits = digits_of(match)
    of = lambda by_kind: F.when(kind == "email", by_kind["email"]).when(kind == "ip", by_kind["ip"]).when(kind == "card", by_kind["card"]).otherwise(by_kind["phone"])
    before, left, right = span["before"], span["left"], span["right"]
    top = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1))
    known = of({
        "email": F.array_contains(F.split(F.lit(TOP_DOMAINS), " "), top),
        "ip": ~match.rlike(r"^(?:0+|22[4-9]|2[3-5][0-9])[.\[]"),
        "card": digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
        "phone": match.rlike(r"^(?:\+|00)") | digits.rlike(r"^[2-9][0-9]{2}[2-9][0-9]{6}$"),
    })
    checked = of({
        "email": F.length(match).between(6, 254),
        "ip": ~match.rlike(r"(?:^|[.\]])0[0-9]"),
        "card": F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(10, 15),
    })
    # a proposal spelled like a base match failed the base check
    plain = of({k: match.rlike(f"^(?:{v})$") for k, v in BASE.items()})
    edge = r"[A-Za-z0-9_/\\=]"
    return F.struct(
        span["start"].alias("start"), span["ord"].alias("ord"), span["end"].alias("end"), kind.alias("kind"), F.lit(base).alias("base"),
        (F.lit(1) if base else F.when(plain, 0).otherwise(-1)).alias("pattern"), vote(known, ~known).alias("gazetteer"), vote(checked, ~checked).alias("checksum"),
        vote(of({k: before.rlike(v) for k, v in CUES.items()}), before.rlike(AGAINST)).alias("context"),
        vote(~(left.rlike(edge) | right.rlike(edge)), left.rlike(edge) | right.rlike(edge)).alias("borders"),
    )


def train(patterns: list[tuple[str, tuple[int, ...], float]], steps: int = 300, rate: float = 0.5) -> tuple[dict[str, weak.LabelModel], dict[tuple, float]]:
    """Label models per kind from (kind, votes, count), and the span classifier: weights of (kind,) and (labeler, vote).

    The classifier is logistic regression on the posteriors, by gradient steps over the counted patterns.
    """
    models = {k: weak.fit({v: n for kind, v, n in patterns if kind == k}, len(LABELERS), right=START, smooth=5.0) for k in KINDS}
    w: dict[tuple, float] = dict.fromkeys([(k,) for k in KINDS] + [(name, v) for name in LABELERS for v in (0, 1)], 0.0)
    rows = [([(k,), *((name, v) for name, v in zip(LABELERS, votes, strict=True) if v >= 0)], models[k].posterior(votes), math.log1p(n)) for k, votes, n in patterns]
    # a pattern of each vote alone keeps labelers known that the data never contradict
    rows += [([(k,), (name, v)], p if v else 1 - p, 0.5) for k in KINDS for name, p in zip(LABELERS, START, strict=True) for v in (0, 1)]
    total = sum(n for _, _, n in rows)
    for _ in range(steps):
        grad = dict.fromkeys(w, 0.0)
        for keys, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[k] for k in keys)))))
            for k in keys:
                grad[k] += n * (y - p)
        for k in w:
            w[k] += rate * (grad[k] / total * 10 - 0.001 * w[k])
    return models, w


def probability(span: Column, w: dict[tuple, float]) -> Column:
    odds = F.lit(0.0)
    for k in KINDS:
        odds = odds + F.when(span["kind"] == k, w[(k,)]).otherwise(0.0)
    for name in LABELERS:
        odds = odds + F.when(span[name] == 1, w[(name, 1)]).when(span[name] == 0, w[(name, 0)]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def searched(docs: DataFrame) -> DataFrame:
    """The rows of docs, text never null, with n_<kind>, base and wider: the spans with the labelers' votes."""
    df = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumn("digit", F.col("text").rlike("[0-9]"))
    df = found(df, BASE, {k: F.contains("text", F.lit(HINT[k])) if k in HINT else F.col("digit") for k in KINDS}, "b_")
    passing = lambda k: lambda s: valid(k, s["match"])
    df = df.withColumns({f"b_{k}": F.filter(f"b_{k}", passing(k)) for k in KINDS})
    df = df.withColumn("base", F.array_sort(F.concat(*(F.col(f"b_{k}") for k in KINDS))))
    # cheap tests first: most texts hold neither digits nor brackets, and a pattern makes a copy of the text
    bracket = F.contains("text", F.lit("[")) | F.contains("text", F.lit("("))
    df = found(df, WIDER, {k: (bracket if k in ("email", "ip") else F.col("digit")) & F.col("text").rlike(WIDER_HINT[k]) for k in KINDS}, "w_").drop("digit")
    df = apart(df.withColumn("wider", F.array_sort(F.concat(*(F.col(f"w_{k}") for k in KINDS)))))
    df = df.withColumns({"base": F.transform("base", lambda s: voted(s, True)), "wider": F.transform("wider", lambda s: voted(s, False))})
    return df.withColumns({f"n_{k}": F.size(f"b_{k}").cast("long") for k in KINDS}).drop(*(f"{p}_{k}" for p in "bw" for k in KINDS))


def classifier(held: DataFrame) -> dict[tuple, float]:
    """The span classifier's weights from all rows' spans (columns base and wider)."""
    each = held.filter((F.size("base") > 0) | (F.size("wider") > 0)).select(F.explode(F.concat("base", "wider")).alias("s"))
    counted = each.groupBy("s.kind", *(f"s.{n}" for n in LABELERS)).count().collect()
    return train(sorted((r["kind"], tuple(r[n] for n in LABELERS), r["count"]) for r in counted))[1]


def every(w: dict[tuple, float], threshold: float) -> Column:
    """Base spans and the proposals that the classifier takes, in order."""
    added = F.filter("wider", lambda s: probability(s, w) >= threshold)
    return F.transform(F.array_sort(F.concat("base", added)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), (~s["base"]).alias("added")))


def spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, counts of base spans (n_<kind>), base (their text form), all_spans (array of start, end, kind, added)."""
    counts = [f"n_{k}" for k in KINDS]
    held = save(searched(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", *counts, "base", "wider"), "spans")
    return held.select("doc_id", *counts, text_of(F.col("base")).alias("base"), every(classifier(held), threshold).alias("all_spans"))


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with every span replaced in text and n_chars, where there is such a column, counted anew. Null texts stay null."""
    # no filter before the write, as the optimizer would push the search into it
    held = save(searched(docs.select("text")).select("base", "wider"), "spans")
    w = classifier(held)
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))  # apart from working columns, whose names may clash
    df = searched(rows).withColumn("all_spans", every(w, threshold))
    none = F.size("all_spans") == 0
    df = redacted(df.select("row", "text", "all_spans")).select("row", "all_spans", F.when(none, F.col("row.text")).otherwise(F.col("new_text")).alias("new_text"))
    length = F.when(none, F.col("row.n_chars")).otherwise(F.length("new_text").cast("long")) if "n_chars" in docs.columns else None
    return df.select(*(F.col("new_text").alias("text") if c == "text" else length.alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns))


def redacted(df: DataFrame) -> DataFrame:
    """Adds new_text: text with each of all_spans replaced by <KIND>. Overlapping spans of two kinds are replaced as one, named after the first.

    The text is cut into pieces once, and what lies between spans is put together from them.
    """
    spans_, pieces = F.col("all_spans"), F.col("pieces")
    df = max_before(df.withColumn("ends", F.transform(spans_, lambda s: s["end"])), "ends", "held")
    df = df.withColumn("pieces", F.when(F.size(spans_) > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def between(lo: Column, hi: Column) -> Column:
        """Code points lo to hi (exclusive), lo < hi."""
        first, last = F.floor(lo / PIECE).cast("int"), F.floor((hi - 1) / PIECE).cast("int")
        held = F.concat_ws("", F.slice(pieces, first + 1, F.least(last - first + 1, F.size(pieces))))
        return F.substr(held, lo - first * PIECE + 1, hi - lo)

    def one(x: Column) -> Column:
        at = F.greatest(x["held"], F.lit(0))
        tag = F.concat(F.lit("<"), F.upper(x["all_spans"]["kind"]), F.lit(">"))
        start = x["all_spans"]["start"]
        return F.when(start > at, F.concat(between(at, start), tag)).when(start == at, tag).otherwise("")

    last, length = F.array_max("ends"), F.length("text")
    tail = F.when(length > last, between(last, length)).otherwise("")
    df = df.withColumn("parts", F.transform(F.arrays_zip("all_spans", "held"), one)).withColumn("tail", tail)
    return df.withColumn("new_text", F.concat(F.concat_ws("", "parts"), "tail")).drop("ends", "held", "pieces", "parts", "tail")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spans(table(spark, sf_dir, "documents"))
    return got.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), text_of(F.col("all_spans")).alias("spans"))
