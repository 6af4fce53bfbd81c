"""What readers see: effective levels, scopes, buckets, sections and the surfaces that show a document.

Input columns beside those of levels: action_level, page_type, applicability (as leveled() gives them), summary,
reason, impact, signal, terms_text, source_url (strings) and is_placeholder (boolean: the title stands for a
text that is still to be recognised). Nulls are empty or false.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decisions import Branch, Decision, Lowering, set_aside, with_predicates
from .levels import GUARD, GUARD_SEEN, LEVELS, REGULATION, SINGLES, Bits, Plain, groups, guard_predicates, guard_views

TOP = ("requires_attention", "watchlist")
INPUTS = {
    c: "string"
    for c in ("title", "raw_text", "source_name", "source_url", "source_role", "url", "level", "region", "action_level", "page_type", "applicability", "summary", "reason", "impact", "signal", "terms_text", "application_status", "support_status")
} | {"is_placeholder": "boolean"}

EFFECTIVE = Lowering("effective", LEVELS, (
    ("sector", TOP, "sector_excluded", "background"),
    ("statistics", TOP, "statistics_repeal", "background"),
    ("digital", TOP, "digital_news", "background"),
    ("reference", TOP, "reference_only AND geo_scope = 'non_target_rf'", "background"),
    ("applicability", TOP, "applicability NOT IN ('', 'ok')", "{applicability}"),
    ("placeholder", ("requires_attention",), "is_placeholder", "watchlist"),
))

GEO_SCOPE = Decision("geo_scope", tuple(Branch(*b) for b in (
    ("not_applicable", "applicability NOT IN ('', 'ok')", "non_target_rf"),
    ("region", "region IN ('rostov', 'krasnodar', 'stavropol', 'moscow_oblast')", "target_region"),
    ("named", "names_target", "target_region"),
    ("world", "names_world", "global_market"),
    ("elsewhere", "names_elsewhere", "non_target_rf"),
    ("federal", "region = 'federal'", "federal_rf"),
)), "non_target_rf")

BUCKET = Decision("bucket", tuple(Branch(*b) for b in (
    ("urgent", "action_level = 'requires_attention' AND geo_scope IN ('target_region', 'federal_rf')", "requires_attention"),
    ("urgent_reference", "action_level = 'requires_attention' AND support_reference", "support_reference"),
    ("urgent_world", "action_level = 'requires_attention' AND geo_scope = 'global_market'", "market_background"),
    ("urgent_elsewhere", "action_level = 'requires_attention'", "non_target_background"),
    ("world", "geo_scope = 'global_market'", "market_background"),
    ("reference", "support_reference AND geo_scope IN ('target_region', 'federal_rf')", "support_reference"),
    ("reference_elsewhere", "support_reference", "non_target_background"),
    ("target", "geo_scope = 'target_region'", "target_watchlist"),
    ("elsewhere", "geo_scope = 'non_target_rf'", "non_target_background"),
)), "industry_background")

SECTION = Decision("section", tuple(Branch(*b) for b in (
    ("urgent", "action_level = 'requires_attention'", "requires_attention"),
    ("measures", "source_role IN ('active_support_measures', 'support_documents')", "measures_and_selections"),
    ("regional", "source_role = 'regional_npa'", "regional_npa"),
    ("strategy", "source_role = 'strategy'", "strategy_signals"),
)), "news_signals")

VIEWS = (
    "sector_full", "sector_lead", "sector_title", "told", "visible", "target_text", "broad_text", "title_", "url_", "source_key", *GUARD_SEEN,
)


def views(d: Plain) -> dict[str, str]:
    joined = lambda *parts: "lower(concat_ws(' ', " + ", ".join(f"nullif({p}, '')" for p in parts) + "))"
    squashed = lambda c: "trim(" + d.replaced(c, r"\s+", " ") + ")"
    return {
        "title_": "lower(title)", "url_": "lower(url)", "source_key": "lower(source_name || ' ' || source_url)",
        "sector_full": squashed(joined("title", "summary", "substr(raw_text, 1, 5000)", "terms_text")), "sector_lead": squashed(joined("title", "summary", "substr(raw_text, 1, 1200)")), "sector_title": squashed(joined("title", "summary")),
        "told": joined("title", "summary", "substr(raw_text, 1, 3000)"), "visible": joined("title", "summary", "reason", "signal", "impact", "substr(raw_text, 1, 3000)"),
        "target_text": joined("title", "source_name", "url"), "broad_text": joined("title", "source_name", "url", "summary", "reason"),
        "own_level": "action_level",
    } | guard_views()


def predicates(d: Plain) -> dict[str, str]:
    """Tests over the views; own_level is the level before anything was lowered."""
    sector = lambda v: f"({d.any('domain_terms', v)} OR {d.rx('rx_domain', v)})"
    support = f"({d.one('гисп', 'source_key')} OR level = 'support_measures' OR {d.one('господдерж', 'source_key')} OR {d.one('меры поддержки', 'source_key')})"
    return guard_predicates(d) | {
        "gate": "source_role IN ('strategy', 'support_documents', 'regional_npa', 'active_support_measures') AND NOT is_placeholder",
        "sector_excluded": f"gate AND NOT {sector('sector_full')}",
        "statistics_repeal": f"{d.rx('rx_stats_repeal', 'told')} AND NOT {d.rx('rx_stats_duty', 'told')}",
        "digital_news": f"source_role = 'news_signals' AND {d.rx('rx_digital', 'told')} AND NOT {d.rx('rx_practical', 'told')}",
        "reference_only": d.rx("rx_reference_only", "visible"),
        "names_target": d.any("geo_target", "target_text"), "names_world": d.any("geo_global", "broad_text"), "names_elsewhere": d.any("geo_elsewhere", "broad_text"),
        "names_form": d.rx("rx_reference_title", "title_"),
        "names_corruption": f"{d.one('корруп', 'title_')} AND ({d.one('форм', 'title_')} OR {d.one('деклар', 'title_')} OR {d.one('конфликт интерес', 'title_')})",
        "support_reference": f"NOT (names_corruption AND (page_type = 'reference_page' OR names_form)) AND (names_form OR page_type IN ('measure_card', 'new_rule', 'selection_announcement', 'deadline_update', 'reference_page') AND {support})",
        "strategy_vague": f"source_role = 'strategy' AND (NOT {sector('sector_lead')} OR {d.rx('rx_macro', 'sector_title')} AND NOT {sector('sector_title')})",
        "own_excluded": "own_level IN ('requires_attention', 'watchlist') AND sector_excluded",
        "subsidy_procedure_page": f"own_level = 'watchlist' AND {d.one(REGULATION, 'url_')} AND " + d.matches(r"порядк\w*.*субсид", "title_"),
    }


def surfaces(sections: bool = False, registries: bool = False, market: bool = False) -> dict[str, str]:
    """Which surfaces show a document: the report, the digest and the list. The flags widen the report and the list."""
    shows = {True: "true", False: "false"}
    pages = "page_type NOT IN ('', 'navigation', 'unknown')" if sections else f"CASE WHEN page_type IN ('registry', 'results_protocol') THEN {shows[registries]} WHEN page_type = 'reference_page' THEN support_reference ELSE page_type IN ('news_background', 'measure_card', 'new_rule', 'selection_announcement', 'deadline_update') END"
    watched = f"(subsidy_procedure_page OR {pages}) AND (bucket <> 'market_background' OR {shows[market]})"
    open_ = "action_level <> 'irrelevant' AND NOT own_excluded AND NOT strategy_vague"
    urgent = "action_level = 'requires_attention'"
    return {
        "on_report": f"{open_} AND CASE WHEN {urgent} THEN bucket = 'requires_attention' ELSE {watched} END",
        "on_digest": f"{open_} AND support_status <> 'inactive' AND application_status <> 'closed' AND page_type <> 'reference_page' AND CASE WHEN {urgent} THEN bucket = 'requires_attention' ELSE action_level = 'watchlist' AND bucket IN ('support_reference', 'target_watchlist', 'industry_background') END",
        "on_list": f"{open_} AND CASE WHEN {urgent} THEN bucket = 'requires_attention' ELSE action_level = 'watchlist' AND {watched} END",
    }


def visible(df: DataFrame, **flags: bool) -> DataFrame:
    """df with action_level as readers see it, the steps that lowered it, geo_scope, bucket, section, on_report, on_digest and on_list."""
    d = Bits(groups(), SINGLES)
    made = ("action_level", "guard_step", "effective_step", "geo_scope", "bucket", "section", "on_report", "on_digest", "on_list")
    blank = {"string": F.lit(""), "boolean": F.lit(False)}
    aside, back = set_aside(df, made)
    out = df.select(*aside, *(F.coalesce(F.col(c).cast(t), blank[t]).alias(c) for c, t in INPUTS.items()))
    out = out.withColumns({n: F.expr(e) for n, e in views(d).items()})
    out = with_predicates(out.withColumn("seen_", d.markers.scan(**{v: F.col(v) for v in VIEWS})), predicates(d))
    out = EFFECTIVE.apply(GUARD.apply(GEO_SCOPE.decide(out), "action_level"), "action_level")
    out = SECTION.decide(BUCKET.decide(out)).withColumns({n: F.expr(f"coalesce({e}, false)") for n, e in surfaces(**flags).items()})
    return out.select(*back, *made)
