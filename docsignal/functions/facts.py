"""Facts of a document from its sentences: deadline, number, terms, statuses, quotes. Marks are data."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates
from .text import any_of, key_of, let, rx, sentences, squash


@dataclass(frozen=True)
class Marks:
    """Marks of the rules' language: fixed values."""

    #: what a deadline's sentence is about
    deadline: tuple[str, ...] = (
        "прием заявок", "приём заявок", "заявки принимаются", "подача заявок", "срок подачи", "конкурсный отбор", "отбор заявок", "прием документов", "приём документов",
        "публичное обсуждение", "срок обсуждения", "конец обсуждения", "окончание обсуждения", "завершение обсуждения",
    )
    #: what says that applications are taken now
    open: tuple[str, ...] = (
        "прием открыт", "приём открыт", "прием заявок открыт", "приём заявок открыт", "идет прием заявок", "идёт прием заявок", "заявки принимаются", "объявлен конкурсный отбор",
        "объявление о проведении конкурсного отбора", "возобновлен прием заявок", "возобновлён прием заявок",
    )
    closed: tuple[str, ...] = (
        "прием завершен", "приём завершен", "прием окончен", "приём окончен", "отбор завершен", "прием заявок завершен", "приём заявок завершен", "заявки не принимаются",
        "прием заявок приостановлен", "приём заявок приостановлен", "приостановить прием заявок",
    )
    #: words that a snippet begins with
    lead: tuple[str, ...] = ("прием открыт", "приём открыт", "прием заявок открыт", "приём заявок открыт")
    #: terms of loans and agreements, which are no deadlines
    not_deadline: tuple[str, ...] = ("срок кредита", "срок займа", "срок действия соглашения", "до 12 месяцев", "до 5 лет")
    programme: str = "до 2030 года"
    programme_unless: tuple[str, ...] = ("прием", "подач", "обсужден")
    #: (marks, points) of a sentence; and of the words before its date
    points: tuple[tuple[tuple[str, ...], int], ...] = ((("срок подачи",), 4), (("прием заявок", "приём заявок"), 4), (("заявки принимаются",), 4))
    until: tuple[tuple[str, int], ...] = (("до ", 3), ("по ", 2))
    continued: str = "до "
    inactive: tuple[str, ...] = ("не активная", "неактивная")
    active: tuple[str, ...] = ("активная",)
    regular: tuple[str, ...] = ("на регулярной основе",)
    terms: tuple[str, ...] = ("срок кредита", "срок займа", "срок действия соглашения", "до 12 месяцев", "до 5 лет", "размер поддержки", "ставка:", "сумма:", "авансового платежа", "фактических понесенных затрат")
    number: tuple[str, ...] = (r"\b\d{2}-\d{5}-\d{5}-[A-ZА-ЯЁ]\b", r"\bНПА\s*\d+[0-9A-ZА-Яа-я-]*\b", r"\bбывш\.\s*\d+\b")


MARKS = Marks()
#: Forms of a day in a deadline, and what stands around it.
DAY = r"(?:\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}\s+(?:" + "|".join(dates.RUSSIAN + dates.RUSSIAN_ALONE) + r")\s+\d{4}(?:\s+г(?:ода|\.))?)"
RANGE, UNTIL = rf"\bс\s+{DAY}\s+по\s+{DAY}", rf"\b(?:до|по)\s+{DAY}"
ENDING = rf"(?:конец|окончание|завершение)\s+(?:публичного\s+)?обсуждени[яй]\s*[:\-]?\s*{DAY}"
#: A snippet's longest, and how much of a sentence it takes before and after the date.
SNIPPET, BEFORE, AFTER = 180, 40, 30
EDGES = r"^[ ,.;:-]+|[ ,.;:-]+$"
RISKS = (
    ("inactive", True, "Срок найден в описании неактивной меры; не является текущим окном подачи."), ("inactive", False, "Мера помечена как неактивная."),
    ("closed", True, "Срок найден в описании закрытой меры; не является текущим окном подачи."), ("closed", False, "Прием заявок или отбор завершены."), ("unknown", False, "Не найден явный статус приема заявок или срок."),
)


def shortened(c: Column, most: int = SNIPPET) -> Column:
    """At most so many characters, dots instead of the rest."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most - 3), "[ ,.;:-]+$", ""), F.lit("...")))


def last_dated(s: Column) -> Column:
    """The text of a sentence's last range, else `until`, else end of discussion, whose day is a calendar day; null if there is none."""

    def last(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(s, F.lit(rx(pattern)), F.lit(0)), lambda m: F.struct(m.alias("m"), F.try_element_at(F.regexp_extract_all(m, F.lit(rx(DAY)), F.lit(0)), F.lit(-1)).alias("day")))
        return F.try_element_at(F.filter(found, lambda x: dates.parse_date(x["day"]).isNotNull()), F.lit(-1))["m"]

    return F.coalesce(last(RANGE), last(UNTIL), last(ENDING))


def about_deadline(low: Column, marks: Marks = MARKS) -> Column:
    """Whether lower-cased text speaks of applications or discussions."""
    return said(low, (*marks.deadline, *marks.open))


def one_of(markers: tuple[str, ...]) -> str:
    """A pattern of literal markers. Where none of them begins, it looks at one character only."""
    return f"(?=[{''.join(sorted({re.escape(m[0]) for m in markers}))}])(?:" + "|".join(rf"\Q{m}\E" for m in markers) + ")"


def said(low: Column, markers: tuple[str, ...]) -> Column:
    """Whether lower-cased text holds a marker, in one pass; text that is worked out for it is not worked out for each marker."""
    return F.coalesce(low.rlike(one_of(markers)), F.lit(False))


def candidate(s: Column, marks: Marks = MARKS) -> Column:
    """struct(points, snippet) of a sentence that may name the deadline, else null."""
    def judged(x: Column) -> Column:
        low, dated = x["low"], x["dated"]
        points = F.when(said(low, marks.open), 5).otherwise(0)
        for ms, n in marks.points:
            points = points + F.when(said(low, ms), n).otherwise(0)
        for m, n in marks.until:
            points = points + F.when(F.contains(F.lower(dated), F.lit(m)), n).otherwise(0)
        # of equal texts the last stands where the reversed text comes first
        at = F.length(low) - F.instr(F.reverse(low), F.reverse(F.lower(dated))) - F.length(dated) + 1
        lead = F.regexp_instr(low, F.lit(one_of((*marks.deadline, *marks.lead)))) - 1
        start = F.when(lead >= 0, lead).otherwise(F.greatest(at - BEFORE, F.lit(0)))
        end = F.least(at + F.length(dated) + AFTER, F.length(low))
        cut = F.regexp_replace(F.substr(x["s"], start + 1, F.greatest(end - start, F.lit(0))), EDGES, "")
        return F.when(dated.isNotNull(), F.struct(points.alias("points"), let(cut, shortened).alias("snippet")))

    def asked(x: Column) -> Column:
        other = said(x["low"], marks.not_deadline) | (F.contains(x["low"], F.lit(marks.programme)) & ~said(x["low"], marks.programme_unless))
        return F.struct(x["s"].alias("s"), x["low"].alias("low"), F.when(about_deadline(x["low"], marks) & ~other, last_dated(x["s"])).alias("dated"))

    return let(F.struct(s.alias("s"), F.lower(s).alias("low")), lambda x: let(asked(x), judged))


def split_flat(c: Column) -> Column:
    """Sentences of squashed text."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: s != "")


def deadline_sentence(c: Column, marks: Marks = MARKS) -> Column:
    """The snippet of the sentence with the most points, the first of equals. A sentence that goes on with `until` and names none by itself counts with the one before."""
    return deadline_of(sentences(c), F.lower(c), marks)


def deadline_of(parts: Column, low: Column, marks: Marks = MARKS) -> Column:
    """The same of a text's sentences and its lower-cased whole."""

    def pieces(parts: Column) -> Column:
        before = lambda i: F.get(parts, i - 1)
        goes_on = lambda s, i: (i > 0) & F.startswith(F.lower(s), F.lit(marks.continued)) & about_deadline(F.lower(before(i)), marks)
        return F.transform(parts, lambda s, i: F.struct(i.alias("i"), F.array(s, F.when(goes_on(s, i), F.concat_ws(" ", before(i), s))).alias("ways")))

    judged = F.transform(let(parts, pieces), lambda x: F.struct(x["i"].alias("i"), F.get(F.array_compact(F.transform(x["ways"], lambda s: candidate(s, marks))), F.lit(0)).alias("found")))
    best = F.array_max(F.transform(F.filter(judged, lambda x: x["found"].isNotNull()), lambda x: F.struct(x["found"]["points"].alias("points"), (-x["i"]).alias("i"), x["found"]["snippet"].alias("snippet"))))
    return F.when(about_deadline(low, marks), best["snippet"])


def application_status(c: Column, deadline_text: Column, as_of: Column, marks: Marks = MARKS) -> Column:
    """Closed marks beat dates; an inactive measure is regular or unknown; a past day is closed; open marks or a day to come open; then regular, unknown."""
    return let(F.lower(c), lambda low: status_of(low, support_of(low, marks), deadline_text, as_of, marks))


def status_of(low: Column, support: Column, deadline_text: Column, as_of: Column, marks: Marks = MARKS) -> Column:
    """The same of lower-cased text."""

    def judged(day: Column) -> Column:
        regular = F.when(said(low, marks.regular) & deadline_text.isNull(), "regular").otherwise("unknown")
        return F.when(said(low, marks.closed), "closed").when(support == "inactive", regular).when(day < as_of, "closed").when(day.isNotNull() | said(low, marks.open), "open").otherwise(regular)

    return let(dates.parse_deadline(deadline_text), judged)


def support_status(c: Column, marks: Marks = MARKS) -> Column:
    """inactive is asked first, as its words hold those of active."""
    return let(F.lower(c), lambda low: support_of(low, marks))


def support_of(low: Column, marks: Marks = MARKS) -> Column:
    return F.when(said(low, marks.inactive), "inactive").when(said(low, marks.active), "active").otherwise("unknown")


def number(c: Column, marks: Marks = MARKS) -> Column:
    """What the first pattern that matches finds."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, rx(p), 0), F.lit("")) for p in marks.number))


def terms(c: Column, marks: Marks = MARKS) -> Column:
    return terms_of(sentences(c), F.lower(c), marks)


def terms_of(parts: Column, low: Column, marks: Marks = MARKS) -> Column:
    """The first sentence with a term, looked for in texts that have one."""
    first = F.try_element_at(F.filter(parts, lambda s: said(F.lower(s), marks.terms)), F.lit(1))
    return F.when(said(low, marks.terms), let(first, shortened))


def risk(support: Column, application: Column, deadline: Column) -> Column:
    """What speaks against acting on a measure now, null if nothing does."""
    out = None
    for status, dated, note in RISKS:
        hit = ((support if status == "inactive" else application) == status) & (deadline.isNotNull() if dated else F.lit(True) if status != "unknown" else deadline.isNull())
        out = F.when(hit, note) if out is None else out.when(hit, note)
    return out


def quotes(c: Column, markers: list[str], most: int = 3) -> Column:
    """At most so many distinct sentences with a marker."""
    hits = F.filter(sentences(c), lambda s: any_of(s, markers))
    keyed = F.transform(hits, lambda s: F.struct(key_of(s).alias("k"), s.alias("s")))
    start = F.array().cast("array<struct<k:string,s:string>>")
    one = F.aggregate(keyed, start, lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(F.slice(one, 1, most), lambda x: x["s"])


def facts(text: Column, as_of: Column, marks: Marks = MARKS) -> Column:
    """A struct of all facts; fields in alphabetical order, as they are written to JSON."""


    def told(x: Column) -> Column:
        flat, low, sentence, application, support = x["flat"], x["low"], x["sentence"], x["application"], x["support"]
        return F.struct(
            application.alias("application_status"), sentence.alias("deadline_text"), F.when(support != "unknown", support == "active").alias("is_active"),
            F.when(said(low, marks.regular), True).alias("is_continuous"), number(flat, marks).alias("npa_number"), risk(support, application, sentence).alias("risk_notes"),
            support.alias("support_status"), terms_of(x["parts"], low, marks).alias("terms_text"),
        )

    kept = lambda x: [x[n].alias(n) for n in ("flat", "low", "parts")]
    read = lambda flat: F.struct(flat.alias("flat"), F.lower(flat).alias("low"), split_flat(flat).alias("parts"))
    dated = lambda x: F.struct(*kept(x), deadline_of(x["parts"], x["low"], marks).alias("sentence"), support_of(x["low"], marks).alias("support"))
    statuses = lambda x: F.struct(*kept(x), x["sentence"].alias("sentence"), x["support"].alias("support"), status_of(x["low"], x["support"], x["sentence"], as_of, marks).alias("application"))
    return let(let(let(let(squash(text), read), dated), statuses), told)


def merged(old: Column, new: Column) -> Column:
    """Of two texts the longer, if one holds the other's key; else both, without sentences that repeat."""
    from .text import distinct_sentences

    a, b = key_of(F.coalesce(old, F.lit(""))), key_of(F.coalesce(new, F.lit("")))
    both = distinct_sentences(F.concat_ws(" ", old, new))
    return F.when(F.contains(a, b), old).when(F.contains(b, a), new).otherwise(both)


def merged_similar(first: Column, second: Column, ratio: float = 0.82) -> Column:
    """Of two texts the one that holds the other, whatever its case; of similar ones the longer, the first if equally long; else both.

    Blank and null texts give way; if both are blank the result is empty. Similarity is worked out, in
    Arrow batches, only for rows that the expressions before it leave open.
    """
    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([x is not None and y is not None and SequenceMatcher(None, x, y).ratio() >= ratio for x, y in zip(a, b, strict=True)], dtype=bool)

    one, two = (squash(F.coalesce(c, F.lit(""))) for c in (first, second))
    a, b = F.lower(one), F.lower(two)
    # an empty text is held by any
    held = F.when(F.contains(a, b), one).when(F.contains(b, a), two)
    alike = similar(F.when(held.isNull(), a), F.when(held.isNull(), b))
    longer = F.when(F.length(one) >= F.length(two), one).otherwise(two)
    return F.coalesce(held, F.when(alike, longer).otherwise(F.concat_ws(" ", one, two)))


def title_of(raw: Column, body: Column, generic: list[str], most: int = 200) -> Column:
    """A title unless it is blank or generic, else the first line of the body with 20 characters or more."""
    line = F.try_element_at(F.filter(F.transform(F.split(body, r"\r?\n"), squash), lambda x: F.length(x) >= 20), F.lit(1))
    bad = (squash(raw) == "") | key_of(raw).isin(*generic)
    return F.substring(F.when(F.coalesce(bad, F.lit(True)), F.coalesce(line, squash(raw))).otherwise(squash(raw)), 1, most)


def hardened(struct: Column, default: dict[str, tuple[tuple[str, ...], str]]) -> Column:
    """Fields of a struct outside their vocabulary get a default."""
    out = struct
    for name, (allowed, fallback) in default.items():
        out = out.withField(name, F.when(struct[name].isin(*allowed), struct[name]).otherwise(F.lit(fallback)))
    return out


def weak_reason(struct: Column, summary: str, most_noise: float = 0.5) -> Column:
    """Why an enrichment is not worth showing, null if it is."""
    s = F.coalesce(struct[summary], F.lit(""))
    return F.when(F.length(squash(s)) < 40, "short").when(F.regexp_count(s, F.lit(r"\p{L}")) < most_noise * F.length(s), "noise")


def chosen(*candidates: Column) -> Column:
    """The first candidate that is fit to show: not blank and with letters enough."""
    return F.coalesce(*(F.when((F.length(squash(c)) >= 20) & (F.regexp_count(c, F.lit(r"\p{L}")) * 2 > F.length(c)), c) for c in candidates))
