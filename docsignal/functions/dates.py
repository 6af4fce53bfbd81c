"""Dates in text. `as_of` is always a parameter; nothing here reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Names of months in calendar order, as dates spell them: fixed values.
ENGLISH = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
RUSSIAN = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
RUSSIAN_ALONE = ("январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь")
#: English short forms are the first three letters, and sept.
MONTHS = tuple("|".join((e, *(("sept",) if e == "september" else ()), e[:3], r, a)) for e, r, a in zip(ENGLISH, RUSSIAN, RUSSIAN_ALONE, strict=True))
ISO = r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)"
DMY = r"(?<!\d)(\d{1,2})[./](\d{1,2})[./](\d{4})(?!\d)"
WORDY = r"(?iu)(?<!\d)(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s+(\d{4})(?!\d)"
ANY = rf"(?iu){ISO}|{DMY}|{WORDY[5:]}"


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def _month(word: Column) -> Column:
    out = None
    for i, names in enumerate(MONTHS, 1):
        hit = word.rlike(rf"(?iu)^(?:{names})$")
        out = F.when(hit, str(i)) if out is None else out.when(hit, str(i))
    return out


def parse_date(c: Column) -> Column:
    """The date of a text: ISO form first, then day.month.year, then day, month name and year.

    A form that is there but names no calendar day gives null; the next form is not tried.
    """
    part = lambda p, i: F.regexp_extract(c, p, i)
    iso, dmy, wordy = c.rlike(ISO), c.rlike(DMY), c.rlike(WORDY)
    return F.when(iso, _date(part(ISO, 1), part(ISO, 2), part(ISO, 3))).when(dmy, _date(part(DMY, 3), part(DMY, 2), part(DMY, 1))).when(wordy, _date(part(WORDY, 3), _month(part(WORDY, 2)), part(WORDY, 1)))


def all_dates(c: Column) -> Column:
    """Valid dates of a text in order."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(ANY), F.lit(0)), parse_date), lambda d: d.isNotNull())


#: Marks of the last day: fixed values.
UNTIL = r"(?:until|till|by|до|по)\s+"
DISCUSSION = r"(?:end of discussion|конец обсуждения|окончани[ея] обсуждения)\D{0,20}"
RANGE = rf"(?:{ANY[5:]})\s*[-–—]\s*(?:{ANY[5:]})"


def _last(c: Column, lead: str) -> Column:
    hits = F.regexp_extract_all(c, F.lit(rf"(?iu){lead}(?:{ANY[5:]})"), F.lit(0))
    return F.try_element_at(F.filter(F.transform(hits, parse_date), lambda d: d.isNotNull()), F.lit(-1))


def parse_deadline(c: Column) -> Column:
    """The last day named: end of discussion over `until`, over the end of a range, over the last date of the text."""
    ends = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(rf"(?iu){RANGE}"), F.lit(0)), lambda r: F.slice(all_dates(r), -1, 1)))
    return F.coalesce(_last(c, DISCUSSION), _last(c, UNTIL), F.try_element_at(ends, F.lit(-1)), F.try_element_at(all_dates(c), F.lit(-1)))


#: What ends a discussion, and how far after it its date may stand: fixed values.
END_OF_DISCUSSION = r"(?:конец|окончание|завершение)\s+(?:публичного\s+)?обсуждени[яй]"
AFTER_END = 180


def regulation_deadline(c: Column) -> Column:
    """The first date near after the end of a discussion is named, else the last date of the text."""
    after = F.regexp_extract(c, rf"(?isu){END_OF_DISCUSSION}(.{{0,{AFTER_END}}})", 1)
    return F.coalesce(F.try_element_at(all_dates(after), F.lit(1)), F.try_element_at(all_dates(c), F.lit(-1)))


def regulation_status(c: Column, as_of: Column, near_days: int = 14) -> Column:
    """expired, near or future; null without a date."""
    left = F.datediff(regulation_deadline(c), as_of)
    return F.when(left < 0, "expired").when(left <= near_days, "near").when(left.isNotNull(), "future")


#: What a publication date stands by, and what marks dates of another kind: fixed values.
PUBLICATION = ("опублик", "публикац", "размещ", "создан", "дата публикации", "publication", "published")
OTHER_DATES = (
    "прием заяв", "приём заяв", "заявки принима", "срок подачи", "конкурсн", "отбор", "обсужден",
    "срок кредита", "срок займа", "срок действия", "до 12 месяцев", "до 5 лет", "до 2030 года",
)
CLOCK = r"\b\d{1,2}:\d{2}\b"
LEAD, MARKED_LEAD = 180, 240


def published_from_text(c: Column, leading: bool = True, news: Column | None = None) -> Column:
    """A publication date of a text: none if marks of other dates are there; a date in the lead that a time of
    day goes with, or that stands in news; else a date in the wider lead where a mark of publication is there."""
    flat = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    holds = lambda markers: F.lower(flat).rlike("|".join(markers))
    lead = F.substring(flat, 1, LEAD)
    first = F.when(lead.rlike(CLOCK) | (news if news is not None else F.lit(False)), parse_date(lead)) if leading else F.lit(None).cast("date")
    return F.when(~holds(OTHER_DATES), F.coalesce(first, F.when(holds(PUBLICATION), parse_date(F.substring(flat, 1, MARKED_LEAD)))))


def deadline_class(day: Column, as_of: Column, near_days: int = 7) -> Column:
    """expired, today, near, future or unknown."""
    left = F.datediff(day, as_of)
    return F.when(day.isNull(), "unknown").when(left < 0, "expired").when(left == 0, "today").when(left <= near_days, "near").otherwise("future")


def date_from_url(url: Column) -> Column:
    """/YYYY/M/D/ in a path, else a date in the path with _ read as -."""
    p = r"/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$)"
    part = lambda i: F.regexp_extract(url, p, i)
    return F.when(url.rlike(p), _date(part(1), part(2), part(3))).otherwise(parse_date(F.translate(F.regexp_extract(url, r"://[^/]*([^?#]*)", 1), "_", "-")))


#: Sources whose leads open with a date, whose pages carry one after their menu, and whose acts carry one in their heading: fixed values.
NEWS_SOURCES, GOVERNMENT, ADMINISTRATION = ("zol.ru", "regulation.gov.ru"), ("government.ru", "правительство рф"), ("admkrai.krasnodar.ru", "нормативные акты краснодарского края")
GOVERNMENT_PAGE = r"(?i)^[^:/?#]+://government\.ru/(?:news|docs)/[0-9]+/?(?:#.*)?$"
PUBLISHED_BY = r"(?:дата\s+публикации|дата\s+опубликования|опубликовано|опубликован|размещено|размещен|размещён)[:\s,]+(.{0,120})"
ACT_OF = r"(?:п\s*р\s*и\s*к\s*а\s*з|постановлени[ея]|распоряжени[ея])\s*(?:№\s*[\w./-]+\s*)?(?:от\s*)?"
UNREAD = "requires ocr extraction"
#: How far from the start of a text a menu, a publication note and the heading of an act may stand.
MENU, NOTE, HEADING = 900, 1600, 700


def flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def government_date(text: Column) -> Column:
    """A page's date with a time of day behind it, after the menu."""
    return let(F.regexp_extract(F.substring(flat(text), 1, MENU), WORDY.removesuffix(r"(?!\d)") + r"\s+\d{1,2}:\d{2}", 0), parse_date)


def administration_date(text: Column) -> Column:
    """The date near a note of publication, else that of the act in the heading; none for texts that are still to be recognised."""

    def found(t: Column) -> Column:
        notes = F.transform(F.regexp_extract_all(F.substring(t, 1, NOTE), F.lit("(?iuU)" + PUBLISHED_BY), F.lit(1)), parse_date)
        heading = let(F.regexp_extract(F.substring(t, 1, HEADING), "(?iuU)" + ACT_OF + rf"({DMY}|{WORDY[5:]})", 1), parse_date)
        return F.when(~F.contains(F.lower(t), F.lit(UNREAD)), F.coalesce(F.get(F.filter(notes, lambda d: d.isNotNull()), F.lit(0)), heading))

    return let(flat(text), found)


def infer_published(title: Column, text: Column, source: Column, url: Column) -> Column:
    """When a document was published: by its kind of source first, then by its text, its title, and its address at last.

    A government address that is no page of news or acts has no date.
    """
    key = F.lower(F.concat_ws(" ", F.coalesce(source, F.lit("")), F.coalesce(url, F.lit(""))))
    of = lambda names: F.coalesce(key.rlike("|".join(n.replace(".", r"\.") for n in names)), F.lit(False))
    news, government = of(NEWS_SOURCES), of(GOVERNMENT)
    by_kind = F.coalesce(F.when(government, government_date(text)), F.when(of(ADMINISTRATION), administration_date(text)))
    by_text = F.when(news, published_from_text(text, news=F.lit(True))).otherwise(published_from_text(text, leading=False))
    found = F.coalesce(by_kind, by_text, published_from_text(title, leading=False), date_from_url(url))
    return F.when(~government | F.coalesce(url.rlike(GOVERNMENT_PAGE), F.lit(False)), found)


def event_ts(published: Column, collected: Column) -> Column:
    return F.coalesce(published, collected)


def from_array(c: Column) -> Column:
    """[y, m, d] as a date."""
    at = lambda i: F.try_element_at(c, F.lit(i)).cast("string")
    return F.when(F.size(c) >= 3, _date(at(1), at(2), at(3)))


def age(ts: Column, as_of: Column) -> Column:
    """`5 min`, `3 h` or `2 d`."""
    s = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    return F.when(ts.isNull(), "never").when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min"))).when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit(" d")))
