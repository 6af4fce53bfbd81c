"""Quality rules by weak supervision (operator 6).

Each rule votes for a text, against it or abstains; expectation-maximisation over the counted vote
patterns of all documents estimates how often each rule is right, and the posterior probability of
good quality decides, where a filter of the usual kind would ask all rules to pass.

Defined results: null text counts as empty (0 words, base_failed). Ties and repeated rows: each row
is judged by its own text, so equal texts get equal verdicts. An empty table gives an empty result.
Columns other than doc_id and text are ignored, whatever their names. A null doc_id is carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import weak
from .common import map_rows, save, table

SYMBOLS = re.compile(r"[#*$%&|<>]")
SYMBOL_WORD = re.compile(rb"[^ \t-\r#*$%&|<>]*[#*$%&|<>][^ \t-\r]*")
#: Words so common in running prose that a text of some length without them is no prose.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that for it on with as was by de la le les et des que en un du pour der die und den von das ist mit el los las una por con se".split()
)
RULES = ("length", "symbols", "line_copies", "repeats", "word_length", "variety", "letters", "function_words", "symbol_words")
MIN_WORDS = 50
FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long, n_alpha long, n_function long, n_symbol_words long"


def _word_chars(words: list[bytes]) -> int:
    joined = b"".join(words)
    return len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds at least twice, each word once."""
    if len(words) < 4:
        return 0
    grams = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(grams)
    if len(seen) == len(grams):
        return 0
    total, end = 0, 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def measure(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()  # bytes split at ASCII white space only
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    symbols = len(SYMBOLS.findall(text or ""))
    return (
        len(words),
        _word_chars(words),
        symbols,
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        sum(1 for w in words if w[:1].isalpha() or w[:1] >= b"\xc3"),
        sum(1 for w in words if w.lower().rstrip(b".,") in FUNCTION_WORDS),
        len(SYMBOL_WORD.findall(raw)) if symbols else 0,
    )


def features(docs: DataFrame) -> DataFrame:
    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield (doc_id, *measure(text))

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, FEATURES)


def votes() -> list[F.Column]:
    """One column per rule of RULES: 1 for, 0 against, -1 abstains."""
    c = F.col
    rate = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))

    def vote(name: str, good: F.Column, bad: F.Column) -> F.Column:
        return F.when(bad, 0).when(good, 1).otherwise(-1).alias(name)

    enough = c("n_words") >= MIN_WORDS
    return [
        vote("length", c("n_words") >= 2 * MIN_WORDS, ~enough),
        vote("symbols", rate("n_symbols", "word_chars") <= 0.01, rate("n_symbols", "word_chars") > 0.1),
        vote("line_copies", rate("n_dup_lines", "n_lines") <= 0.05, rate("n_dup_lines", "n_lines") > 0.3),
        vote("repeats", rate("n_repeat_words", "n_words") <= 0.15, rate("n_repeat_words", "n_words") > 0.5),
        vote("word_length", rate("word_chars", "n_words").between(3, 10), ~rate("word_chars", "n_words").between(2, 15)),
        vote("variety", enough & (rate("n_distinct", "n_words") >= 0.3), enough & (rate("n_distinct", "n_words") < 0.1)),
        vote("letters", rate("n_alpha", "n_words") >= 0.8, rate("n_alpha", "n_words") < 0.6),
        vote("function_words", enough & (rate("n_function", "n_words") >= 0.1), enough & (rate("n_function", "n_words") < 0.05)),
        vote("symbol_words", rate("n_symbol_words", "n_words") <= 0.03, rate("n_symbol_words", "n_words") > 0.2),
    ]


def fit(voted: DataFrame) -> weak.LabelModel:
    """The label model from the counts of all rows' patterns: at most 3 ** len(RULES) rows reach the driver."""
    counted = voted.groupBy(*RULES).count().collect()
    return weak.fit({tuple(r[k] for k in RULES): r["count"] for r in counted}, len(RULES), prior=0.8)


def posterior(model: weak.LabelModel) -> F.Column:
    """The model's posterior as an expression over the vote columns."""
    import math

    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for k, p, q in zip(RULES, model.right_for, model.right_against, strict=True):
        odds = odds + F.when(F.col(k) == 1, math.log(p / (1 - q))).when(F.col(k) == 0, math.log((1 - p) / q)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document the base counts, the posterior and the verdict: kept if base passes and the posterior reaches the threshold."""
    counted = save(features(docs), "quality")  # read twice: to fit and to judge
    voted = counted.select("*", *votes())
    model = fit(voted)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (posterior(model) >= threshold)).alias("kept"), posterior(model).alias("quality"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
