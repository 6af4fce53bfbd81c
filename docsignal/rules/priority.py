"""In which order urgent documents are shown: tiers by what presses most, and what a topic adds.

Input columns: title, summary, source_role, page_type, application_status (strings), deadline_date (date) and
topic_family (string); nulls are empty or unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.health import topic_boost
from .decisions import Branch, Decision, set_aside, with_predicates
from .levels import Bits, Plain

#: Patterns of trade rules, of restrictions and logistics that count beside trade across borders, and of changes to support: fixed values.
TRADE = r"импорт|квот|пошлин|тариф|тамож|вывоз|правил\w*\s+экспорт|экспортн\w*\s+правил"
RESTRICTION, LOGISTICS, BORDER = "запрет|ограничен", "логистик|терминал|перевозк|поставк", "экспорт|вывоз|тамож|импорт|ввоз"
CHANGE = r"измен|обнов|новые\s+услов|новый\s+поряд|внесени[ея]\s+измен|утвержден|утверждён"
#: Points of a tier, and days that count as near: fixed values.
TIERS = {"today": 400, "trade": 380, "act": 360, "near": 340, "change": 300, "open": 260, "discussion": 200, "background": 180, "default": 100}
NEAR = 7

TIER = Decision("tier", tuple(Branch(*b) for b in (
    ("today", "application_status = 'open' AND due_today", "today"),
    ("trade", "trade_signal", "trade"),
    ("regional_act", "source_role = 'regional_npa' AND page_type IN ('new_rule', 'deadline_update')", "act"),
    ("support_act", "source_role IN ('support_documents', 'active_support_measures') AND page_type IN ('new_rule', 'measure_card', 'deadline_update')", "act"),
    ("near", "application_status = 'open' AND due_near", "near"),
    ("change", "support_changed", "change"),
    ("open", "application_status = 'open'", "open"),
    ("discussion", "source_role = 'strategy'", "discussion"),
    ("news", "source_role = 'news_signals'", "background"),
)), "default")


def predicates(d: Plain, as_of: str) -> dict[str, str]:
    today = f"DATE '{as_of}'"
    return {
        "due_today": f"deadline_date = {today}",
        "due_near": f"deadline_date > {today} AND deadline_date <= {today} + INTERVAL {NEAR} DAY",
        "trade_signal": f"{d.matches(TRADE, 'words')} OR ({d.matches(RESTRICTION, 'words')} OR {d.matches(LOGISTICS, 'words')}) AND {d.matches(BORDER, 'words')}",
        "support_changed": d.matches(CHANGE, "words"),
    }


WORDS = "lower(concat_ws(' ', nullif(title, ''), nullif(summary, '')))"
INPUTS = {"title": "string", "summary": "string", "source_role": "string", "page_type": "string", "application_status": "string"}


def prioritised(df: DataFrame, as_of: str) -> DataFrame:
    """df with tier, tier_branch and priority, the tier's points and what the topic adds."""
    aside, back = set_aside(df, ("tier", "tier_branch", "priority"))
    out = df.select(*aside, *(F.coalesce(F.col(c).cast(t), F.lit("")).alias(c) for c, t in INPUTS.items()), F.col("deadline_date").cast("date").alias("deadline_date"), "topic_family")
    out = TIER.decide(with_predicates(out.withColumn("words", F.expr(WORDS)), predicates(Bits({}), as_of)))
    points = None
    for name, n in TIERS.items():
        points = F.when(F.col("tier") == name, n) if points is None else points.when(F.col("tier") == name, n)
    return out.select(*back, "tier", "tier_branch", (points + topic_boost(F.col("topic_family"))).alias("priority"))
