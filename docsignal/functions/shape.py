"""The shape of texts that were recognised from scans or copied from forms.

A text's shape is a set of shares: capitals among its letters, letters of another script, signs that prose does
not use, and words of one or two letters. Debris and stamped headings are told by bounds on these shares,
which are parameters. Nothing here depends on lengths in characters except the least number of letters that
makes a share worth reading.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squash

#: Stems of the names of authorities and acts: fixed values.
AUTHORITIES = ("министерств", "правительств", "администрац", "постановлен", "приказ", "распоряжен", "решени", "указ")
#: What recognisers and fonts without a map leave behind: fixed values.
LEFTOVERS = ("�", "cid:", "□", "■")


@dataclass(frozen=True)
class Bounds:
    letters: int = 16
    capitals: float = 0.7
    foreign: float = 0.4
    odd: float = 0.05
    torn: float = 0.6


BOUNDS = Bounds()


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def shape(c: Column) -> Column:
    """struct(letters, capitals, foreign, odd, torn): a count and four shares. Null texts have the shape of an empty one."""
    t = F.coalesce(c, F.lit(""))
    n = lambda p: F.regexp_count(t, F.lit(p))
    letters, words = n(r"\p{L}"), n(r"\p{L}+")
    return F.struct(
        letters.alias("letters"),
        share(n(r"\p{Lu}"), letters).alias("capitals"),
        share(F.least(n(r"\p{IsLatin}"), letters - n(r"\p{IsLatin}")), letters).alias("foreign"),
        share(n(r"[^\p{L}\p{N}\s.,:;!?()«»\"'№%/–—-]"), n(r"\S")).alias("odd"),
        share(n(r"(?<!\p{L})\p{L}{1,2}(?!\p{L})"), words).alias("torn"),
    )


def names_authority(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*map(F.lit, AUTHORITIES)), lambda w: F.contains(low, w))


def debris(c: Column, bounds: Bounds = BOUNDS) -> Column:
    """Whether a text is what recognition left: leftovers of fonts, torn words, or odd signs in a stamped heading."""
    t, s = F.coalesce(c, F.lit("")), shape(c)
    left = F.exists(F.array(*map(F.lit, LEFTOVERS)), lambda w: F.contains(t, w))
    enough = s["letters"] >= bounds.letters
    return left | (enough & (s["torn"] >= bounds.torn)) | (enough & (s["capitals"] >= bounds.capitals) & t.rlike(r"[©{}|~_]") & names_authority(c)) | (enough & (s["odd"] >= 3 * bounds.odd))


def stamped_heading(c: Column, bounds: Bounds = BOUNDS) -> Column:
    """Whether a text is the heading of an act: nearly all capitals, and an authority or a kind of act is named."""
    s = shape(c)
    return (s["letters"] >= bounds.letters) & (s["capitals"] >= bounds.capitals) & names_authority(c)


def joined_capitals(c: Column, least: int = 4) -> Column:
    """Runs of at least so many single capitals, as some files spell headings, written as one word. Spaces become single."""
    words = F.split(squash(c), " ")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("run"))
    single = lambda w: w.rlike(r"^\p{Lu}\p{Punct}*$")
    # a capital with a sign behind it ends its run
    flushed = lambda a: F.when(F.size(a["run"]) >= least, F.concat(a["out"], F.array(F.array_join(a["run"], "")))).otherwise(F.concat(a["out"], a["run"]))
    empty = F.array().cast("array<string>")

    def step(a: Column, w: Column) -> Column:
        longer = F.concat(a["run"], F.array(w))
        goes_on, last = w.rlike(r"^\p{Lu}$"), single(w)
        ended = F.struct(a["out"].alias("out"), longer.alias("run"))
        return (
            F.when(goes_on, ended)
            .when(last, F.struct(flushed(ended).alias("out"), empty.alias("run")))
            .otherwise(F.struct(F.concat(flushed(a), F.array(w)).alias("out"), empty.alias("run")))
        )

    return F.when(c.isNotNull(), F.array_join(F.aggregate(words, start, step, flushed), " "))


def prose_from(c: Column) -> Column:
    """The place (from 1) of the first word that reads as prose: a capital and three small letters, four small letters, or О/Об before a small letter; 0 if none does."""
    return F.regexp_instr(c, F.lit(r"(?<!\p{L})(?:\p{Lu}[\p{Ll}]{3,}|\p{Ll}{4,}|Об?\s+\p{Ll})"))


def without_debris(c: Column, bounds: Bounds = BOUNDS) -> Column:
    """A text from its first words of prose on, if what stands before them is no prose: a heading, another script, numbers. Null stays null."""
    at = prose_from(c)
    head = F.substr(c, F.lit(1), at - 1)
    s = shape(head)
    mixed = (s["foreign"] >= bounds.foreign / 2) | ((s["letters"] > 0) & head.rlike(r"\d") & (s["capitals"] >= bounds.capitals))
    goes = names_authority(head) | debris(head, bounds) | stamped_heading(head, bounds) | mixed
    return F.when((at > 1) & goes, F.substr(c, at)).otherwise(c)
