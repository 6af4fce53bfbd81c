"""Topic families over one pass of markers.

A family is a veto, exact markers, and rules of markers all of which, any of which, and any of which in the
context must be there and none of others may. Families are tried in the order of their file. Markers and
texts are normalised alike; a marker of one short word stands for a whole word.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ontology_text
from .automaton import Markers
from .levels import HERE, load

#: Words that count as short whatever their length: fixed values.
SHORT = ("апк", "крс")


def normalised(marker: str) -> str:
    return re.sub(r"[^0-9a-zа-я]+", " ", str(marker).lower().replace("ё", "е")).strip()


def bordered(marker: str) -> str:
    """A marker as it is looked for in a padded text."""
    m = normalised(marker)
    return f" {m} " if m and " " not in m and (m in SHORT or len(m) <= 3) else m


@dataclass(frozen=True)
class TopicRule:
    all: tuple[str, ...] = ()
    any: tuple[str, ...] = ()
    context_any: tuple[str, ...] = ()
    exclude_any: tuple[str, ...] = ()


@dataclass(frozen=True)
class TopicFamily:
    name: str
    label: str
    risk: str = "medium"
    exact: tuple[str, ...] = ()
    exclude_any: tuple[str, ...] = ()
    rules: tuple[TopicRule, ...] = ()


def families(config: Mapping | None = None) -> list[TopicFamily]:
    """The families of a configuration with a table `families`; without one, the package's own."""
    config = load(str(HERE / "topics.toml")) if config is None else config
    some = lambda v: tuple(x for x in map(bordered, [v] if isinstance(v, str) else v or ()) if x)
    return [
        TopicFamily(n, f.get("label", n), f.get("risk", "medium"), some(f.get("exact")), some(f.get("exclude_any")), tuple(TopicRule(**{k: some(v) for k, v in r.items()}) for r in f.get("rules", ())))
        for n, f in config.get("families", {}).items()
    ]


def keyword_groups(config: Mapping | None = None) -> dict[str, list[str]]:
    config = load(str(HERE / "topics.toml")) if config is None else config
    return {g: [k.strip() for k in ks if k.strip()] for g, ks in config.get("keywords", {}).items()}


def keywords(groups: Mapping[str, Sequence[str]]) -> list[str]:
    """All keywords, each once, in order."""
    return list(dict.fromkeys(k for ks in groups.values() for k in ks))


def markers_of(known: Sequence[TopicFamily]) -> Markers:
    return Markers({f.name: [*f.exact, *f.exclude_any, *(m for r in f.rules for g in (r.all, r.any, r.context_any, r.exclude_any) for m in g)] for f in known})


def branches(known: Sequence[TopicFamily], any_of: Callable[[Sequence[str]], str], all_of: Callable[[Sequence[str]], str]) -> Iterator[tuple[TopicFamily, tuple[str, ...], str, str]]:
    """(family, markers that count as hits, confidence, SQL) in the order in which they are tried."""
    for f in known:
        open_ = f"NOT {any_of(f.exclude_any)} AND " if f.exclude_any else ""
        if f.exact:
            yield f, f.exact, "high", open_ + any_of(f.exact)
        for r in f.rules:
            tests = [all_of(r.all)] if r.all else []
            tests += [any_of(ms) for ms in (r.any, r.context_any) if ms]
            if tests:
                tests += [f"NOT {any_of(r.exclude_any)}"] if r.exclude_any else []
                yield f, (*r.all, *r.any, *r.context_any), "high" if f.risk == "low" else "medium", open_ + " AND ".join(tests)


def with_topic(df: DataFrame, *parts: Column, known: Sequence[TopicFamily] | None = None, name: str = "topic") -> DataFrame:
    """df with struct(family, label, hits, confidence, risk) of the first family that holds for the parts' joined text, else null."""
    known = families() if known is None else known
    marks = markers_of(known)
    df = df.withColumn("seen_", marks.scan(text=F.concat(F.lit(" "), ontology_text(*parts), F.lit(" "))))
    at = "seen_.text"
    bare = lambda ms: F.transform(marks.which(at, list(dict.fromkeys(ms))), lambda m: F.trim(m))
    out = None
    for f, markers, sure, holds in branches(known, lambda ms: marks.any(at, ms), lambda ms: marks.all(at, ms)):
        found = F.struct(F.lit(f.name).alias("family"), F.lit(f.label).alias("label"), bare(markers).alias("hits"), F.lit(sure).alias("confidence"), F.lit(f.risk).alias("risk"))
        out = F.when(F.expr(holds), found) if out is None else out.when(F.expr(holds), found)
    out = F.lit(None).cast("struct<family:string,label:string,hits:array<string>,confidence:string,risk:string>") if out is None else out
    return df.withColumn(name, out).drop("seen_")
