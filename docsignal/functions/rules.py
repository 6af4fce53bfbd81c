"""Ordered decision lists and topic families as expressions; vocabularies are data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, matched


@dataclass(frozen=True)
class Rule:
    """Holds if all conditions hold: markers all of, any of, none of, in a context, and a further expression."""

    value: str
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    near: tuple[str, ...] = ()
    where: str = ""

    def holds(self, text: Column) -> Column:
        out = F.lit(True)
        for m in self.all_of:
            out = out & any_of(text, [m])
        if self.any_of:
            out = out & any_of(text, list(self.any_of))
        if self.near:
            out = out & any_of(text, list(self.near))
        if self.none_of:
            out = out & ~any_of(text, list(self.none_of))
        return out & F.coalesce(F.expr(self.where), F.lit(False)) if self.where else out


def decide(rules: list[Rule], text: Column, default: str) -> Column:
    """The value of the first rule that holds. The order is the meaning."""
    out = None
    for r in rules:
        out = F.when(r.holds(text), r.value) if out is None else out.when(r.holds(text), r.value)
    return out.otherwise(default) if out is not None else F.lit(default)


def decided_by(rules: list[Rule], text: Column) -> Column:
    """The number (from 1) of the first rule that holds, 0 if none does."""
    out = F.lit(0)
    for i, r in reversed(list(enumerate(rules, 1))):
        out = F.when(r.holds(text), i).otherwise(out)
    return out


@dataclass(frozen=True)
class Family:
    """A topic: any veto marker excludes it, an exact marker or a rule brings it."""

    name: str
    label: str
    exact: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    veto: tuple[str, ...] = ()
    words: tuple[str, ...] = field(default=())  # short markers, whole words only

    def holds(self, text: Column) -> Column:
        padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}]+", " "), F.lit(" "))
        out = any_of(text, list(self.exact)) if self.exact else F.lit(False)
        for w in self.words:
            out = out | F.contains(padded, F.lit(f" {w.lower()} "))
        for r in self.rules:
            out = out | r.holds(text)
        return F.coalesce(out, F.lit(False)) & (~any_of(text, list(self.veto)) if self.veto else F.lit(True))

    def hits(self, text: Column) -> Column:
        every = [*self.exact, *(m for r in self.rules for m in (*r.all_of, *r.any_of))]
        return matched(text, every) if every else F.array().cast("array<string>")


def topic(families: list[Family], text: Column) -> Column:
    """struct(family, label, hits, confidence) of the first family that holds, else nulls."""
    none = F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("label"), F.array().cast("array<string>").alias("hits"), F.lit(0.0).alias("confidence"))
    out = none
    for f in reversed(families):
        hits = f.hits(text)
        found = F.struct(F.lit(f.name).alias("family"), F.lit(f.label).alias("label"), hits.alias("hits"), F.least(F.lit(1.0), F.lit(0.5) + 0.1 * F.size(hits)).alias("confidence"))
        out = F.when(f.holds(text), found).otherwise(out)
    return out
