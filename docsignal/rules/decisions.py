"""Ordered decision lists over named predicates.

Predicates are SQL over columns and over each other. They form a graph without circles; each is worked out
once, in the layer after those that it names. A decision list is an ordered table of (branch, condition,
value): the first condition that holds decides, and rows carry the branch that decided. Conditions hold
nothing but predicates, comparisons and AND, OR, NOT, so that a list can be examined without data.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[a-z_][a-z_0-9]*")
TEXT = re.compile(r"'(?:[^']|'')*'")


def named(sql: str) -> set[str]:
    """The names in an expression, without those in literals."""
    return set(NAME.findall(TEXT.sub(" ", sql)))


def layers(predicates: Mapping[str, str]) -> list[list[str]]:
    """The predicates in layers, each after all that it names. A circle raises an error."""
    left = {p: (named(sql) & set(predicates)) - {p} for p, sql in predicates.items()}
    out: list[list[str]] = []
    while left:
        ready = [p for p, needs in left.items() if not needs & set(left)]
        if not ready:
            raise ValueError(f"predicates need each other: {sorted(left)}")
        out.append(ready)
        for p in ready:
            del left[p]
    return out


def set_aside(df: DataFrame, made: Iterable[str]) -> tuple[list[Column], list[Column]]:
    """Columns of df but those called as made ones, under names that no working column has; and the columns that give them their names back.

    Flat columns and no struct, which the optimizer would copy into every place that reads it.
    """
    held = [c for c in df.columns if c not in set(made)]
    return [F.col(f"`{c}`").alias(f"row_{i}") for i, c in enumerate(held)], [F.col(f"row_{i}").alias(c) for i, c in enumerate(held)]


def with_predicates(df: DataFrame, predicates: Mapping[str, str]) -> DataFrame:
    """Adds every predicate as a column; null is no."""
    for layer in layers(predicates):
        df = df.withColumns({p: F.expr(f"coalesce({predicates[p]}, false)") for p in layer})
    return df


@dataclass(frozen=True)
class Branch:
    name: str
    when: str
    value: str


@dataclass(frozen=True)
class Decision:
    """value of a branch: a word, or SQL in braces."""

    name: str
    branches: tuple[Branch, ...]
    default: str

    def __post_init__(self) -> None:
        names = [b.name for b in self.branches]
        if len(set(names)) < len(names):
            raise ValueError(f"{self.name}: branches share a name")

    def branch_sql(self) -> str:
        return "CASE " + " ".join(f"WHEN {b.when} THEN '{b.name}'" for b in self.branches) + " ELSE 'default' END"

    def value_sql(self, branch: str) -> str:
        """The value, from the branch's name alone."""
        shown = lambda v: v[1:-1] if v.startswith("{") else f"'{v}'"
        by: dict[str, list[str]] = {}
        for b in self.branches:
            by.setdefault(b.value, []).append(b.name)
        return f"CASE {' '.join('WHEN ' + branch + ' IN (' + ', '.join(map(repr, names)) + ') THEN ' + shown(v) for v, names in by.items())} ELSE {shown(self.default)} END"

    def decide(self, df: DataFrame) -> DataFrame:
        """df with <name>_branch and <name>."""
        branch = f"{self.name}_branch"
        return df.withColumn(branch, F.expr(self.branch_sql())).withColumn(self.name, F.expr(self.value_sql(branch)))

    def first(self, row: Mapping[str, object]) -> str:
        """The branch that decides a row of predicates, by plain Python."""
        return next((b.name for b in self.branches if eval(program(b.when), {}, dict(row))), "default")  # noqa: S307

    def domains(self) -> dict[str, list]:
        """What the conditions name: true or false, or the values that they are compared with and one other."""
        out: dict[str, list] = {}
        for b in self.branches:
            for n, values in compared(b.when):
                held = out.setdefault(n, ["-"])
                held += [v for v in values if v not in held]
            for n in named(b.when):
                out.setdefault(n, [False, True])
        return out

    def unreached(self, tries: int = 20_000, seed: int = 0) -> set[str]:
        """Branches for which no row of predicates was found that they decide; search starts from rows that meet the condition."""
        rng, domains = random.Random(seed), self.domains()
        reached: set[str] = set()
        for b in self.branches:
            asked = dict(compared(b.when))
            # what the condition itself names is tried most, all else is mostly at rest
            own = {n: [*asked[n], "-"] if n in asked else domains[n] for n in named(b.when)}
            for _ in range(tries):
                share = rng.choice((0.0, 0.0, 0.05, 0.2))
                row = {n: rng.choice(own[n]) if n in own else rng.choice(v) if rng.random() < share else v[0] for n, v in domains.items()}
                got = self.first(row)
                reached.add(got)
                if got == b.name:
                    break
        return {b.name for b in self.branches} - reached


def compared(sql: str) -> Iterator[tuple[str, list[str]]]:
    """(name, literals) of name = 'x', name <> 'x' and name IN ('x', 'y')."""
    for m in re.finditer(r"([a-z_][a-z_0-9]*)\s*(?:=|<>|NOT IN|IN)\s*(\([^)]*\)|'[^']*')", sql):
        yield m[1], [t[1:-1] for t in TEXT.findall(m[2])]


@functools.lru_cache(maxsize=4096)
def program(sql: str):
    return compile(python(sql), "condition", "eval")


def python(sql: str) -> str:
    """A condition as a Python expression."""
    out = []
    for part in re.split(r"('(?:[^']|'')*')", sql):
        if part.startswith("'"):
            out.append(part)
            continue
        part = re.sub(r"\bNOT IN \(", " not in (", part)
        part = re.sub(r"\bIN \(", " in (", part)
        for a, b in (("AND", "and"), ("OR", "or"), ("NOT", "not"), ("true", "True"), ("false", "False")):
            part = re.sub(rf"\b{a}\b", b, part)
        out.append(part.replace("<>", "!=").replace(" = ", " == "))
    return re.sub(r"\(('(?:[^']|'')*')\)", r"(\1,)", "".join(out))


@dataclass(frozen=True)
class Lowering:
    """An ordered rewriting of levels that only lowers: the first step that fires for a row's level sets it."""

    name: str
    ranks: tuple[str, ...]  # the highest first
    steps: tuple[tuple[str, tuple[str, ...], str, str], ...]  # (step, levels it acts on, condition, level it sets)

    def __post_init__(self) -> None:
        for step, at, _, to in self.steps:
            if not to.startswith("{") and any(self.ranks.index(to) < self.ranks.index(level) for level in at):
                raise ValueError(f"{self.name}: {step} raises a level")

    def sql(self, level: str) -> str:
        """The level after the first step that fires, where no step computes it."""
        return "CASE " + " ".join(f"WHEN {level} IN ({', '.join(map(repr, at))}) AND ({when}) THEN '{to}'" for _, at, when, to in self.steps) + f" ELSE {level} END"

    def apply(self, df: DataFrame, level: str) -> DataFrame:
        """df with the level rewritten and <name>_step, the step that fired or null. A computed level that is higher leaves the row as it is."""
        quoted = lambda at: ", ".join(f"'{x}'" for x in at)
        fired = "CASE " + " ".join(f"WHEN {level} IN ({quoted(at)}) AND ({when}) THEN '{step}'" for step, at, when, _ in self.steps) + " END"
        shown = lambda v: v[1:-1] if v.startswith("{") else f"'{v}'"
        to = f"CASE {' '.join(f'WHEN {self.name}_step = {step!r} THEN {shown(v)}' for step, _, _, v in self.steps)} END"
        rank = lambda c: f"array_position(array({quoted(self.ranks)}), {c})"
        df = df.withColumn(f"{self.name}_step", F.expr(fired)).withColumn("_to", F.expr(to))
        return df.withColumn(level, F.expr(f"CASE WHEN {rank('_to')} >= {rank(level)} THEN _to ELSE {level} END")).drop("_to")
