"""Text expressions. Patterns get Unicode case folding and classes, as Java's defaults are ASCII."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(pattern: str) -> str:
    """A pattern with Unicode case folding, word and space classes."""
    return "(?iuU)" + pattern


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c worked out once, however often use names it."""
    return F.get(F.transform(F.array(c), lambda x: use(x)), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends; trim() takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Runs of white space become one space."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def filled(c: Column) -> Column:
    """Null for blank text."""
    return F.when(blank(c), F.lit(None).cast("string")).otherwise(c)


def key_of(c: Column) -> Column:
    """Lower case letters and digits, all else one space: for comparing titles."""
    return strip(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}]+", " "))


def any_of(c: Column, markers: list[str]) -> Column:
    """Whether lower-cased text holds a marker as a substring."""
    low = F.lower(c)
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(low, F.lit(m.lower()))
    return F.coalesce(out, F.lit(False))


def matched(c: Column, markers: list[str]) -> Column:
    """The markers that the text holds, in their order."""
    low = F.lower(c)
    return F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(low, F.lower(m)))


def in_groups(c: Column, groups: dict[str, list[str]]) -> Column:
    """Names of the marker groups of which the text holds any."""
    return F.array_compact(F.array(*(F.when(any_of(c, m), F.lit(g)) for g, m in groups.items())))


def sentences(c: Column) -> Column:
    return F.filter(F.split(squash(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def first_with(c: Column, markers: list[str], most: int) -> Column:
    """The first sentence that holds a marker, at most so many characters."""
    return F.substring(F.try_element_at(F.filter(sentences(c), lambda s: any_of(s, markers)), F.lit(1)), 1, most)


def summary(c: Column, markers: list[str], most: int = 300) -> Column:
    """The first sentence with a marker, else the first two sentences."""
    all_ = sentences(c)
    return clip_sentence(F.coalesce(F.try_element_at(F.filter(all_, lambda s: any_of(s, markers)), F.lit(1)), F.concat_ws(" ", F.slice(all_, 1, 2))), most)


def clip_words(c: Column, most: int, end: str = "…") -> Column:
    """Cut at the last space that leaves room for the ending, if the text is too long."""
    text = squash(c)
    head = F.substring(text, 1, most - len(end))
    whole = F.regexp_replace(head, r"\s+\S*$", "")
    whole = F.when(F.substr(text, F.lit(most - len(end) + 1), F.lit(1)) == " ", head).otherwise(whole)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(whole, r"[\s,;:.–-]+$", ""), F.lit(end)))


def clip_sentence(c: Column, most: int) -> Column:
    """Cut at the last end of a sentence inside the limit, else at a word."""
    text = squash(c)
    whole = F.regexp_extract(F.substring(text, 1, most), r"^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(text) <= most, text).when(whole != "", whole).otherwise(clip_words(text, most))


def distinct_sentences(c: Column) -> Column:
    """Sentences without those whose key came before, joined by a space."""
    keyed = F.transform(sentences(c), lambda s: F.struct(key_of(s).alias("k"), s.alias("s")))
    start = F.array().cast("array<struct<k:string,s:string>>")
    return F.concat_ws(" ", F.transform(F.aggregate(keyed, start, lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x)))), lambda x: x["s"]))


def distinct_lines(c: Column, noise: str | None = None) -> Column:
    """Non-blank lines, the first of equal ones, without those that match the noise pattern."""
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: squash(x)), lambda x: x != "")
    if noise:
        lines = F.filter(lines, lambda x: ~x.rlike(rx(noise)))
    return F.concat_ws("\n", F.array_distinct(lines))


def share_of(c: Column, chars: str) -> Column:
    """Share of characters of a class among those that are no white space."""
    return F.regexp_count(c, F.lit(chars)) / F.greatest(F.length(F.regexp_replace(c, r"(?U)\s", "")), F.lit(1))


def unreadable(c: Column, least_letters: float = 0.5, least_words: int = 10) -> Column:
    """Text with few letters or few distinct words: what scanning without recognition leaves."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\p{L}{3,}"), F.lit(0)))
    return F.coalesce((share_of(c, r"\p{L}") < least_letters) | (F.size(words) < least_words), F.lit(True))


def mostly_upper(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{Lu}")) * 2 > F.regexp_count(c, F.lit(r"\p{L}"))


def redacted(c: Column) -> Column:
    """Keys and tokens masked."""
    out = F.regexp_replace(c, r"\b\d{6,12}:[A-Za-z0-9_-]{20,}", "<token>")
    out = F.regexp_replace(out, r"(?i)\b(bearer)\s+[A-Za-z0-9._-]{8,}", "$1 <token>")
    return F.regexp_replace(out, r"(?i)\b(token|api[_-]?key|password|secret)(\s*[=:]\s*)\"?[^\s\"]+\"?", "$1$2<hidden>")


def quality_points(c: Column) -> Column:
    """0 to 3 points for the length of a text."""
    n = F.length(strip(F.coalesce(c, F.lit(""))))
    return F.when(n >= 5000, 3).when(n >= 1000, 2).when(n >= 100, 1).otherwise(0)


def chunks(c: Column, most: int = 4096) -> Column:
    """Pieces of at most so many characters, cut after the last line end inside, else hard."""
    start = F.struct(c.alias("rest"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        head = F.substring(rest, 1, most)
        at = F.length(F.regexp_extract(head, r"(?s)^(.*\n)", 1))
        cut = F.when(F.length(rest) <= most, F.length(rest)).when(at > 0, at).otherwise(F.lit(most))
        more = F.length(rest) > 0
        return F.struct(F.when(more, F.substr(rest, cut + 1, F.length(rest))).otherwise(rest).alias("rest"), F.when(more, F.concat(acc["out"], F.array(F.substr(rest, F.lit(1), cut)))).otherwise(acc["out"]).alias("out"))

    # each round takes at least one character; a piece that ends at a line may be short, hence one round per line too
    rounds = F.size(F.split(c, "\n")) + F.ceil(F.length(c) / most).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), start, step, lambda acc: acc["out"])


def ontology_text(*parts: Column) -> Column:
    """Parts joined, lower case, ё as е, anything but digits and letters a-z and а-я one space."""
    whole = F.concat_ws(" ", *(filled(p.cast("string")) for p in parts))
    return F.trim(F.regexp_replace(F.translate(F.lower(whole), "ё", "е"), "[^0-9a-zа-я]+", " "))


#: Parts of addresses of service pages, and phrases of which a page of links holds several: fixed values.
SERVICE_PARTS = ("search", "archive", "rugovclassifier", "rss", "sitemap", "about", "persons", "photos", "social", "page=", "dt.since", "dt.till")
NAVIGATION = (
    "правительство россии работа правительства", "новости цены зерновой еженедельник", "поиск по сайту",
    "реклама на сайте", "следующая новость предыдущая новость",
)


def service_url(url: Column) -> Column:
    return any_of(url, list(SERVICE_PARTS))


def navigation_text(c: Column, phrases: tuple[str, ...] = NAVIGATION) -> Column:
    """Text of a page that only leads elsewhere: marked so, two phrases of menus, or the site's name again and again beside a pager."""
    low = F.lower(c)
    pager = (F.regexp_count(low, F.lit("правительство россии")) >= 2) & F.contains(low, F.lit("следующая новость"))
    return F.coalesce(F.startswith(low, F.lit("service_page")) | (F.size(matched(c, list(phrases))) >= 2) | pager, F.lit(False))


#: Phrases that end an order's core, phrases that say what is done to an act, and the stems a quoted core holds in this order.
ORDER_ENDS = ("в соответствии с", "в соответствии со", "на основании", "приказываю", "постановляю", "настоящим", "настоящее", "статьей", "статьи")
ORDER_DEEDS = ("об утверждении", "о внесении изменений", "о внесении изменения", "об изменении")
ORDER_STEMS = ("поряд", "субсид")


def order_core(title: Column) -> Column:
    """What an order is about: its last quoted rule of subsidies if there is one, up to the first closing phrase, without number, date and what is done to it."""
    plain = strip(F.translate(title, "«»", '""'))
    # every second piece between quotation marks was quoted, if a mark ends it
    pieces = F.split(plain, '"')
    quoted = F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda q: F.lower(q).rlike(f"(?s){ORDER_STEMS[0]}.*{ORDER_STEMS[1]}"))
    core = F.coalesce(F.try_element_at(quoted, F.lit(-1)), plain)
    # one pass that names the core once: an expression that names it again works it out again
    core = F.regexp_replace(core, "(?s)" + rx(r"\b(?:" + "|".join(e.replace(" ", r"\s+") for e in ORDER_ENDS) + r")\b.*"), "")
    for drop in (r"^№\s*[\d-]+\s*", r"\bот\s*\d+[./]\d+[./]\d{2,4}\b", r"\b(?:" + "|".join(ORDER_DEEDS) + r")\b"):
        core = F.regexp_replace(core, rx(drop), "")
    return F.regexp_replace(squash(F.translate(core, '"', " ")), r"""^[ '.,;:-]+|[ '.,;:-]+$""", "")


def json_object(c: Column) -> Column:
    """The JSON object of an answer: the whole, what a code fence holds, or what lies between the outer braces; null if none of them is one."""
    whole = strip(c)
    fenced = strip(F.regexp_replace(F.regexp_replace(whole, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    braces = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    valid = lambda x: F.when(F.startswith(x, F.lit("{")) & F.get_json_object(x, "$").isNotNull(), x)
    return F.coalesce(valid(whole), F.when(F.startswith(whole, F.lit("```")), valid(fenced)), valid(braces))


def json_value(c: Column) -> Column:
    """A scalar as JSON; null is null."""
    written = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNull(), "null").otherwise(F.substr(written, F.lit(6), F.length(written) - 6))


def fields_hash(**fields: Column) -> Column:
    """SHA-256 of named scalars as JSON in the order of their names, nulls kept, with a space behind commas and colons."""
    parts = [F.concat(F.lit(f'"{k}": '), json_value(fields[k])) for k in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)


def file_name(url: Column, suffix: str = ".pdf") -> Column:
    """A name for what an address gives: its last part, ten digits of the address's SHA-1, the suffix."""
    base = F.regexp_extract(F.regexp_extract(url, r"^(?:[^:/?#]*:)?(?://[^/?#]*)?([^?#;]*)", 1), r"([^/]*)/*$", 1)
    base = F.when(base == "", "document" + suffix).otherwise(base)
    stem = F.when(F.endswith(F.lower(base), F.lit(suffix)), F.left(base, F.length(base) - len(suffix))).otherwise(base)
    return F.concat(stem, F.lit("_"), F.left(F.sha1(url), F.lit(10)), F.lit(suffix))
