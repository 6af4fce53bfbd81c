"""All markers of a rule set found in one pass over a text.

Groups of markers are data. Distinct markers get numbers; an Aho-Corasick automaton over them is built once
per worker and reads every view of a row once, whatever the number of markers, and leaves a bit set per
view. Rules are then expressions over bits: any, all, how many, which. A marker stands wherever its
characters stand; one with blanks at its ends is a whole word in a view that is padded with blanks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a word; the sign is left alone.
WORD = 62


@functools.lru_cache(maxsize=8)
def compiled(markers: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, m in enumerate(markers):
        found.add_word(m, i)
    found.make_automaton()
    return found


def bit_words(hits: Iterable[int], n: int) -> list[int]:
    out = [0] * n
    for i in hits:
        out[i // WORD] |= 1 << i % WORD
    return out


class Markers:
    """Groups of markers by name, with the expressions that ask for them. Empty markers are left out."""

    def __init__(self, groups: Mapping[str, Sequence[str]]) -> None:
        self.groups = {g: tuple(dict.fromkeys(m for m in ms if m)) for g, ms in groups.items()}
        self.names = tuple(dict.fromkeys(m for ms in self.groups.values() for m in ms))
        self.at = {m: i for i, m in enumerate(self.names)}
        self.n_words = max(1, -(-len(self.names) // WORD))

    def scan(self, **views: Column) -> Column:
        """struct(view: array of bit words, ...). A null text holds nothing."""
        names, n, called = self.names, self.n_words, list(views)

        def kernel(*texts: pa.Array) -> pa.Array:
            find = compiled(names).iter if names else lambda t: ()
            out = []
            for column in texts:
                rows = [bit_words({i for _, i in find(t)}, n) if t else [0] * n for t in column.to_pylist()]
                out.append(pa.array(rows, pa.list_(pa.int64())))
            return pa.StructArray.from_arrays(out, names=called)

        return F.arrow_udf(kernel, ", ".join(f"{v} array<long>" for v in views))(*(F.coalesce(c, F.lit("")) for c in views.values()))

    def masks(self, markers: Iterable[str]) -> dict[int, int]:
        """Bits by word."""
        out: dict[int, int] = {}
        for m in markers:
            out[self.at[m] // WORD] = out.get(self.at[m] // WORD, 0) | 1 << self.at[m] % WORD
        return out

    def any(self, seen: str, markers: Iterable[str]) -> str:
        """SQL: whether the bit set of a view (its column's name) holds one of the markers."""
        return "(" + (" OR ".join(f"({seen}[{w}] & {m}L) <> 0" for w, m in self.masks(markers).items()) or "false") + ")"

    def all(self, seen: str, markers: Iterable[str]) -> str:
        return "(" + (" AND ".join(f"({seen}[{w}] & {m}L) = {m}L" for w, m in self.masks(markers).items()) or "true") + ")"

    def count(self, seen: str, markers: Iterable[str]) -> str:
        return "(" + (" + ".join(f"bit_count({seen}[{w}] & {m}L)" for w, m in self.masks(markers).items()) or "0") + ")"

    def which(self, seen: str | Sequence[str], markers: Sequence[str]) -> Column:
        """The markers held by any of the views, in their order."""
        views = (seen,) if isinstance(seen, str) else seen
        each = [F.when(F.expr(" OR ".join(self.any(v, [m]) for v in views)), F.lit(m)) for m in markers]
        return F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")
