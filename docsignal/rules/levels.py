"""Page types, applicability, action levels and their lowering for documents about farm support.

Words, titles and patterns are values in markers.toml. A document is seen through views: its title, leads of
several lengths, the whole body, its address, and texts normalised for regions and for the sector. The
same predicates and lists are written for Spark, where markers are bits of one pass, and for plain SQL, where
each marker is looked for by itself.

Input columns: title, raw_text, source_name, source_role, url, level, region, content_quality (strings),
is_service_page (boolean), deadline_text (string), deadline_date, discussion_date (dates),
application_status, support_status (strings). Nulls are empty, unknown or false. as_of is a parameter.
"""

from __future__ import annotations

import functools
import tomllib
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, facts
from .automaton import Markers
from .decisions import Branch, Decision, Lowering, named, set_aside, with_predicates

HERE = Path(__file__).parent
REGULATION, KRASNODAR = "regulation.gov.ru", "минсельхоз краснодарского края - субсидирование и финансирование"
MINISTRY_NEWS, MARKET_BACKGROUND = "минсельхоз россии - новости", "рыночный или отраслевой фон без прямого регуляторного сигнала."
#: Hosts that are looked for in a source's name and address, in this order.
HOSTS = ("mcx.donland.ru", "pravo.donland.ru", "admkrai.krasnodar.ru", "msh.krasnodar.ru", "mshsk.ru", "pravo.stavregion.ru", "gisp.gov.ru", "zol.ru")
ACTIONABLE = "('selection_announcement', 'measure_card', 'new_rule', 'deadline_update')"
LEVELS = ("requires_attention", "watchlist", "background", "irrelevant")
#: Days before a date that count as near: of a discussion, a selection, an order.
NEAR_DISCUSSION, NEAR_SELECTION, NEAR_ORDER = 14, 2, 14
INPUTS = {
    "title": "string", "raw_text": "string", "source_name": "string", "source_role": "string", "url": "string", "level": "string", "region": "string", "content_quality": "string", "is_service_page": "boolean",
    "deadline_text": "string", "deadline_date": "date", "discussion_date": "date", "application_status": "string", "support_status": "string",
}


@functools.lru_cache(maxsize=4)
def load(path: str) -> dict:
    """Groups of a TOML file, or of a YAML file where a reader for it is installed."""
    if path.endswith((".yaml", ".yml")):
        import yaml

        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f) or {}
    with open(path, "rb") as f:
        return tomllib.load(f)


def vocabulary(keywords: Mapping[str, Sequence[str]] | None = None) -> dict[str, tuple[str, ...]]:
    """Marker groups; groups of keywords are lower-cased and called kw_<name>, all of them kw."""
    out = {g: tuple(ms) for g, ms in load(str(HERE / "markers.toml")).items()}
    lowered = {g: tuple(k.strip().lower() for k in ks) for g, ks in (keywords or {}).items()}
    out |= {f"kw_{g}": ks for g, ks in lowered.items()}
    every = tuple(dict.fromkeys(k for ks in lowered.values() for k in ks))
    strict = out["keyword_strict"]
    return out | {"kw": every, "kw_strict": tuple(k for k in every if any(s in k for s in strict))}


class Plain:
    """SQL that looks for every marker by itself, for DuckDB."""

    def __init__(self, groups: Mapping[str, Sequence[str]]) -> None:
        self.groups = groups

    @staticmethod
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def one(self, marker: str, view: str) -> str:
        return f"contains({view}, {self.text(marker)})"

    def any(self, group: str, *views: str) -> str:
        return "(" + (" OR ".join(self.one(m, v) for v in views for m in self.groups[group]) or "false") + ")"

    def count(self, group: str, view: str) -> str:
        return "(" + " + ".join(f"CAST({self.one(m, view)} AS INT)" for m in self.groups[group]) + ")"

    def titled(self, *groups: str) -> str:
        return "title_ IN (" + ", ".join(self.text(m) for g in groups for m in self.groups[g]) + ")"

    def starts(self, group: str, view: str) -> str:
        return "(" + " OR ".join(f"starts_with({view}, {self.text(m)})" for m in self.groups[group]) + ")"

    def matches(self, pattern: str, view: str) -> str:
        return f"regexp_matches({view}, {self.text(self.portable(pattern))})"

    @staticmethod
    def portable(pattern: str) -> str:
        """Borders and word classes for letters of any script."""
        return pattern.replace(r"\w", r"[\p{L}\p{N}_]").replace(r"\b", r"(?:^|$|[^\p{L}\p{N}_])")

    def rx(self, group: str, view: str) -> str:
        return self.matches("|".join(f"(?:{p})" for p in self.groups[group]), view)

    def replaced(self, view: str, pattern: str, by: str) -> str:
        return f"regexp_replace({view}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def found(self, view: str, pattern: str) -> str:
        return f"regexp_extract_all({view}, {self.text(pattern)}, 1)"

    def filtered(self, items: str, name: str, condition: str) -> str:
        return f"list_filter({items}, lambda {name}: {condition})"

    def first(self, items: str) -> str:
        return f"{items}[1]"


class Bits(Plain):
    """SQL over the bit sets of one pass, for Spark."""

    def __init__(self, groups: Mapping[str, Sequence[str]], singles: Sequence[str] = ()) -> None:
        super().__init__(groups)
        self.markers = Markers({g: ms for g, ms in groups.items() if not g.startswith(("rx_", "titles_"))} | {"_singles": singles})

    @staticmethod
    def text(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def one(self, marker: str, view: str) -> str:
        return self.markers.any(f"seen_.{view}", [marker]) if marker in self.markers.at else super().one(marker, view)

    def any(self, group: str, *views: str) -> str:
        return "(" + " OR ".join(self.markers.any(f"seen_.{v}", self.groups[group]) for v in views) + ")"

    def count(self, group: str, view: str) -> str:
        return self.markers.count(f"seen_.{view}", self.groups[group])

    def starts(self, group: str, view: str) -> str:
        return "(" + " OR ".join(f"startswith({view}, {self.text(m)})" for m in self.groups[group]) + ")"

    def matches(self, pattern: str, view: str) -> str:
        return f"{view} RLIKE {self.text('(?iuUd)' + pattern)}"

    def replaced(self, view: str, pattern: str, by: str) -> str:
        return f"regexp_replace({view}, {self.text('(?U)' + pattern)}, {self.text(by)})"

    def found(self, view: str, pattern: str) -> str:
        return f"regexp_extract_all({view}, {self.text(pattern)}, 1)"

    def filtered(self, items: str, name: str, condition: str) -> str:
        return f"filter({items}, {name} -> {condition})"

    def first(self, items: str) -> str:
        return f"get({items}, 0)"


def views(d: Plain) -> dict[str, str]:
    """Texts that markers are looked for in, over title_, body_ and url_, which are lower case."""
    squashed = lambda c: "trim(" + d.replaced(c, r"\s+", " ") + ")"
    where = "source_ || ' ' || url_ || ' ' || level"
    region = "translate(lower(title || ' ' || substr(raw_text, 1, 4000) || ' ' || source_name || ' ' || url || ' ' || level || ' ' || region), 'ё', 'е')"
    return {
        "lead": "substr(body_, 1, 1500)", "lead2": "substr(body_, 1, 2000)", "joint": "title_ || ' ' || substr(body_, 1, 1500)", "joint2": "title_ || ' ' || substr(body_, 1, 2000)",
        "combo": "title_ || ' ' || substr(body_, 1, 1500) || ' ' || url_", "combo2": "title_ || ' ' || substr(body_, 1, 2000) || ' ' || url_", "opening": "title_ || ' ' || substr(body_, 1, 500)",
        "discussed": "title_ || ' ' || substr(body_, 1, 5000) || ' ' || lower(deadline_text)", "sector_text": squashed("title_ || ' ' || substr(body_, 1, 5000)"), 
        "source_key": "source_ || ' ' || url_", "where_": where, "place": "title_ || ' ' || source_ || ' ' || level", "site": "title_ || ' ' || source_ || ' ' || url_",
        "region_text": "' ' || trim(" + d.replaced(region, "[^0-9a-zа-я]+", " ") + ") || ' '", "title_url": "title_ || ' ' || url_", "title_twice": "title_ || ' ' || title_", "deadline_low": "lower(deadline_text)", "flat": squashed("body_"), "flat_start": "substr(" + squashed("body_") + ", 1, 80)",
    }


#: Views that markers are looked for in.
SEEN = ("title_", "body_", "url_", "lead", "lead2", "joint", "joint2", "combo", "combo2", "opening", "discussed", "sector_text", "source_key", "where_", "place", "site", "region_text", "title_url", "title_twice", "deadline_low", "flat_start")


def predicates(d: Plain, as_of: str) -> dict[str, str]:
    """Named tests; as_of is a day, as yyyy-mm-dd."""
    p: dict[str, str] = {}
    today = f"DATE '{as_of}'"
    ends = lambda: "(" + " OR ".join(d.matches(rf"\.{x}$", "url_") for x in ("pdf", "doc", "docx")) + ")"
    p["regional"] = "domain IN (" + ", ".join(f"'{h}'" for h in d.groups["regional_domains"]) + ")"
    p["is_document_file"] = ends()
    p["orders_title"] = "substr(title_, 1, 8) = 'приказы '"
    p["consultations"] = f"domain = 'admkrai.krasnodar.ru' AND {d.titled('titles_consultations')} AND {d.one('/content/', 'url_')}"
    p["orders_listing"] = f"regional AND orders_title AND {d.one('/documents/', 'url_')}"
    p["krasnodar_file"] = f"domain = 'npa.krasnodar.ru' AND {d.one(KRASNODAR, 'source_key')} AND " + d.matches(r"^https://[^/?#]*/rest/files/[0-9]+/?(?:[;?#].*)?$", "url_")
    generic = {"mcx.donland.ru": "titles_generic_mcx_donland", "mshsk.ru": "titles_generic_mshsk", "pravo.donland.ru": "titles_generic_pravo_donland", "pravo.stavregion.ru": "titles_generic_pravo_stav"}
    p["section_title"] = f"orders_title OR {d.titled('titles_generic')} OR " + " OR ".join(f"domain = '{h}' AND {d.titled(g)}" for h, g in generic.items())
    for end, lead, combo, both in (("", "lead", "combo", "joint"), ("2", "lead2", "combo2", "joint2")):
        p[f"krasnodar_order{end}"] = f"krasnodar_file AND {d.one('приказ', both)} AND {d.any('krasnodar_orders', both)}"
        p[f"generic_section{end}"] = f"regional AND section_title AND ({d.any('section_listing', lead)} OR {d.any('url_section', 'url_')})"
        p[f"low_section{end}"] = f"regional AND {d.titled('titles_low_value')} AND NOT {d.any('regional_call', lead)} AND {d.any('url_low_regional', 'url_')}"
        p[f"low_call{end}"] = d.any("low_value_call", combo)
        p[f"low_page{end}"] = (
            f"source_role IN ('support_documents', 'regional_npa') AND ({d.any('low_value_title', 'title_')} OR low_call{end} AND low_soft AND NOT {d.any('low_value_exception', combo)}"
            f" OR NOT low_call{end} AND (low_soft OR {d.any('low_value_body', combo)} OR {d.any('url_low_value', 'url_')}))"
        )
        p[f"catalog{end}"] = (
            f"({d.titled('titles_support')} OR {d.starts('prefix_support', 'title_')} OR {d.any('url_support_listing', 'source_key')})"
            f" AND ({d.count('support_listing', lead)} >= 3 OR {d.any('support_chrome', lead)}) AND NOT {d.any('support_concrete', lead)}"
        )
        p[f"strategy_signal{end}"] = f"{d.any('kw_strategy', both)} OR {d.any('kw_hit', both)} OR {d.one('апк', both)}"
        p[f"regional_signal{end}"] = f"{d.any('kw_regional', both)} OR {d.any('kw_hit', both)} OR {d.one('субсид', both)} OR {d.one('апк', both)}"
    p["low_soft"] = d.any("low_value_soft", "title_")
    p["document_signal"] = f"{d.any('kw_strategy', 'joint')} OR {d.any('kw_hit', 'joint')} OR {d.any('urgent', 'joint')}"
    p["keywords"] = d.any("kw_hit", "title_", "body_")
    p["agro_order"] = f"{d.one('приказ', 'title_')} AND {d.one('министерств', 'title_')} AND ({d.one('сельского хозяйства', 'title_')} OR {d.one('сельхоз', 'title_')} OR {d.one('агропромышлен', 'title_')})"
    p["no_matter"] = f"NOT agro_order AND ({d.titled('titles_irrelevant')} OR {d.any('irrelevant_title', 'title_')} OR {d.any('irrelevant', 'title_')} OR length(title_) < 4 OR flat = '' OR length(flat) < 80 AND {d.any('irrelevant', 'flat_start')})"
    p["service"] = "is_service_page OR content_quality = 'navigation' OR no_matter"
    p["quiet"] = "is_service_page OR page_type = 'navigation' OR content_quality IN ('navigation', 'empty') OR no_matter"
    p["year_title"] = d.matches("^20(?:2[2-9]|3[0-9])$", "title_")
    p["reference_title"] = f"NOT title_ IN ('нормативные документы', 'креативные индустрии') AND {d.rx('rx_reference_title', 'title_')}"
    p["support_title"] = d.titled("titles_support")
    activity = "(length(lead2) - length(replace(lead2, 'активная', ''))) / 8 + (length(lead2) - length(replace(lead2, 'не активная', ''))) / 11 > 1"
    p["support_menu"] = f"support_title AND ({d.any('support_ui', 'lead2')} OR {d.one('гисп', 'source_key')} AND {activity})"
    p["results_title"] = d.titled("titles_results")
    p["registry_words"] = " OR ".join(d.one(w, "title_") for w in ("реестр", "получател", "список"))
    p["receiver_words"] = " OR ".join(d.one(w, "title_") for w in ("реестр", "получател"))
    p["act_title"] = d.any("act_kinds", "title_")
    hints = {"mcx.donland.ru": "titles_hint_mcx_donland", "admkrai.krasnodar.ru": "titles_hint_admkrai", "mshsk.ru": "titles_hint_mshsk", "pravo.donland.ru": "titles_hint_pravo_donland", "pravo.stavregion.ru": "titles_hint_pravo_stav"}
    p["site_section"] = f"regional AND {d.titled('titles_section')} OR " + " OR ".join(f"domain = '{h}' AND {d.titled(g)}" for h, g in hints.items())
    p["category_title"], p["any_section_title"] = d.titled("titles_category"), d.titled("titles_section")
    p["donland_reference"] = f"{d.any('url_pravo_donland', 'url_')} OR {d.titled('titles_pravo_donland')}"
    p["stav_reference"] = f"{d.any('url_pravo_stav', 'url_')} OR {d.titled('titles_pravo_stav')}"
    p["donland_document"] = f"({d.one('/doc/view/', 'url_')} OR is_document_file) AND act_title"
    p["stav_document"] = f"({d.any('url_stav_document', 'url_')} OR is_document_file) AND act_title"
    p["ministry_measure"] = f"{d.any('url_ministry_measure', 'url_')} AND ({d.any('measure_payment', 'joint2')} OR {d.one('субсид', 'title_')})"
    p["mcx_donland_reference"] = f"{d.titled('titles_mcx_donland')} AND {d.any('url_mcx_donland', 'url_')}"
    p["mshsk_reference"] = f"{d.titled('titles_mshsk')} OR {d.matches('(?:/gospodderzhka/|/subsidii/)$', 'url_')} OR {d.one('/gospodderzhka/obyavleniya-20', 'url_')}"
    p["selection_view"] = d.one("/public/minfin/selection/view/", "url_")
    p["project_url"], p["measure_url"] = d.one("/projects/", "url_"), d.one("/measure/", "url_")
    p["gisp_menu"] = f"{d.one('/nmp/main/', 'url_')} OR {d.one('навига', 'lead2')}"
    p["service_url"], p["service_text"], p["selection_words"] = d.any("url_regional_service", "url_"), d.any("service_body", "lead2"), d.any("selection_title", "title_")
    p["chrome"] = f"{d.any('service_chrome', 'lead2')} AND NOT {d.any('urgent', 'title_', 'lead2')}"
    for kind in ("registry", "results_protocol", "selection_announcement", "measure_card", "new_rule", "deadline_update"):
        p[f"says_{kind}"] = d.any(f"page_{kind}", "title_", "lead2")
    p["says_reference"] = d.any("page_reference_page", "title_")
    p["sector_lead"] = d.any("sector", "title_", "lead2")
    # the region that a measure is for
    phrases = d.found("replace(region_text, ' ', '  ')", " (республик[аи] +[а-я]+|[а-я]+(?:ская|ской|цкая|цкой) +област[ьи]|[а-я]+(?:ский|ского|цкий|цкого) +кра[йя]|[а-я]+(?:ский|ского) +автономн(?:ый|ого) +округа?) ")
    own = [*d.groups["target_federal"], *d.groups["target_moscow"], *d.groups["target_south"], "российской федерации"]
    strange = d.filtered(phrases, "x", "NOT replace(x, '  ', ' ') IN (" + ", ".join(f"'{m}'" for m in own) + ")")
    p["regional_authority"] = f"NOT {d.any('federal_authority', 'region_text')} AND " + d.matches(" (?:министерство|департамент|комитет|управление|администрация)(?: | .{0,258} )(?:области|края|республики|автономного округа) ", "region_text")
    p["other_region"] = f"{d.any('other_regions', 'region_text')} OR {d.one(' нао ', 'region_text')} OR {d.first(strange)} IS NOT NULL OR regional_authority"
    p["federal_scope"] = f"NOT regional_authority AND (lower(region) = 'federal' OR {d.any('federal_scope', 'region_text')})"
    p["low_topic"] = f"{d.any('hard_excluded', 'region_text')} OR {d.any('excluded_topics', 'region_text')}"
    p["hard_topic"], p["excluded_topic"] = d.any("hard_excluded", "region_text"), d.any("excluded_topics", "region_text")
    p["support_surface"] = (
        f"source_role IN ('active_support_measures', 'support_documents') OR {d.one('promote.budget.gov.ru', 'where_')} OR level = 'support_measures' OR source_role = 'regional_npa' AND {d.any('support_text', 'region_text')}"
        f" OR page_type IN ('measure_card', 'selection_announcement', 'deadline_update') AND ({d.one('субсид', 'where_')} OR {d.one('господдерж', 'where_')})"
    )
    # of several markers the longest names the target, of equally long ones the first in order
    codes = {"rostov": "s", "krasnodar": "s", "stavropol": "s", "moscow_oblast": "m"}
    ranked = sorted([(m, k) for k, g in (("f", "target_federal"), ("m", "target_moscow"), ("s", "target_south")) for m in d.groups[g]], key=lambda x: (-len(x[0]), x[0]))
    target = "CASE " + " ".join(f"WHEN lower(region) = '{c}' THEN '{k}'" for c, k in codes.items()) + " " + " ".join(f"WHEN {d.one(m, 'region_text')} THEN '{k}'" for m, k in ranked) + " ELSE '' END"
    p["target_is_federal"], p["target_is_moscow"], p["target_is_south"] = (f"({target}) = '{k}'" for k in "fms")
    p["target"] = "target_is_moscow OR target_is_south OR target_is_federal AND NOT other_region"
    p["moscow_concern"] = d.any("moscow_context", "region_text")
    p["market_story"] = f"{d.any('market_context', 'region_text')} AND {d.any('market_goods', 'region_text')}"
    p["national_story"] = f"{d.any('national_scope', 'region_text')} AND {d.any('national_policy', 'region_text')}"
    # action levels
    p["gated"] = "source_role IN ('strategy', 'support_documents', 'regional_npa', 'active_support_measures')"
    p["agro"] = f"{d.any('domain_terms', 'sector_text')} OR {d.rx('rx_domain', 'sector_text')}"
    p["subsidy_title"] = f"domain = '{REGULATION}' AND {d.any('subsidy_procedure_title', 'title_')}"
    p["subsidy_words"] = d.any("subsidy_procedure", "title_", "lead")
    p["has_deadline"] = "deadline_text <> ''"
    p["expired"] = f"deadline_date < {today}"
    p["alive"] = "has_deadline AND NOT expired"
    days = lambda n: f"discussion_date >= {today} AND discussion_date <= {today} + INTERVAL {n} DAY"
    p["order_near"], p["selection_near"] = f"has_deadline AND {days(NEAR_ORDER)}", f"has_deadline AND {days(NEAR_SELECTION)}"
    staged = f"domain = '{REGULATION}' AND {d.any('discussion_stage', 'discussed')}"
    p["discussion_near"], p["discussion_future"] = f"{staged} AND {days(NEAR_DISCUSSION)}", f"{staged} AND discussion_date > {today} + INTERVAL {NEAR_DISCUSSION} DAY"
    p["change"] = d.any("support_change", "joint")
    p["strong_regional"] = f"NOT {d.rx('rx_negated_action', 'joint')} AND change AND (alive OR {d.one('порядок предоставления субсид', 'joint')} OR {d.one('изменени', 'joint')})"
    p["corruption"] = f"{d.any('static_title', 'title_')} OR " + " OR ".join(f"{d.one(m, 'title_')} AND {d.one(m, 'lead')}" for m in d.groups["anti_corruption"])
    p["off_domain"] = f"{d.one('mcx.gov.ru', 'url_')} AND {d.any('url_ministry_off_domain', 'url_')}"
    p["heritage_page"] = d.any("heritage", "opening")
    p["exhibits"] = d.any("krasnodar_exhibits", "joint")
    p["watch_title"], p["watch_body"] = d.any("sector", "title_"), d.any("sector", "body_")
    p["strict_title"], p["strict"] = d.any("urgent", "title_"), d.any("urgent", "title_", "lead")
    p["action_words"], p["discussion"] = d.any("action", "title_", "lead"), d.any("project_discussion", "title_", "lead")
    p["hinted"] = "action_words OR watch_title OR watch_body OR keywords"
    p["support_context"] = (
        f"source_role IN ('active_support_measures', 'support_documents') OR {d.one('gisp', 'where_')} OR {d.one('гисп', 'where_')} OR {d.one('господдерж', 'where_')} OR {d.one('меры поддержки', 'where_')}"
        f" OR level = 'support_measures' OR page_type IN ('measure_card', 'selection_announcement', 'deadline_update') AND ({d.one('subsid', 'where_')} OR {d.one('субсид', 'where_')})"
    )
    p["target_region"] = f"region IN ('rostov', 'krasnodar', 'stavropol', 'moscow_oblast') OR {d.any('target_south', 'site')} OR {d.any('target_moscow', 'site')}"
    p["federal_measure"] = f"NOT {d.any('other_federal_subjects', 'place')} AND (region = 'federal' OR {d.one('гисп', 'place')} OR {d.one('gisp', 'place')} OR level = 'support_measures' OR level = 'federal' AND {d.one('федерал', 'place')})"
    p["permanent"] = d.any("permanent_measure", "title_")
    p["selection_open"] = f"NOT (domain = 'promote.budget.gov.ru' AND page_type = 'selection_announcement' AND selection_view) OR selection_near"
    p["strong_support"] = "application_status = 'open' AND selection_open OR page_type = 'deadline_update' AND alive OR alive AND change"
    p["foreign_order"] = f"source_role = 'support_documents' AND domain = 'npa.krasnodar.ru' AND {d.one(KRASNODAR, 'source_key')} AND NOT krasnodar_order"
    decided = d.any("government_decision", "joint")
    p["strong_news"] = f"{decided} AND ({d.any('export_control', 'joint')} OR change AND ({d.one('экспорт', 'joint')} OR {d.one('апк', 'joint')} OR {d.one('сельск', 'joint')}))"
    duty = lambda v: f"{d.any('duty_export', v)} AND {d.one('пошлин', v)} AND {d.any('duty_goods', v)} AND {d.any('duty_market', v)}"
    p["preliminary_duty"] = (
        f"application_status <> 'open' AND NOT alive AND NOT {d.any('policy_bound', 'joint')} AND {d.any('policy_considered', 'joint')}"
        f" AND (lower(level) = 'federal' OR lower(region) = 'federal' OR {d.any('federal_words', 'joint')} OR {d.one('минсельхоз', 'source_key')}) AND {duty('joint')}"
    )
    p["ministry_news"] = f"{d.one(MINISTRY_NEWS, 'source_key')} AND {d.rx('rx_ministry_agro', 'joint')} AND {d.rx('rx_ministry_news', 'joint')}"
    # news
    title_strong = d.any("news_strong_title", "title_")
    p["port_export"] = f"{d.rx('rx_news_port', 'joint')} AND {d.any('news_export', 'joint')}"
    p["news_muted"] = f"{d.rx('rx_no_signals', 'joint')} OR {d.rx('rx_news_negated', 'joint')} OR NOT port_export AND NOT {title_strong} AND ({d.rx('rx_news_background_title', 'title_')} OR {d.rx('rx_news_market_title', 'title_')})"
    p["news_strict"], p["news_generic"], p["news_agro_text"] = d.rx("rx_news_strict", "joint"), d.rx("rx_news_generic", "joint"), d.any("news_agro", "joint")
    p["news_signal"] = f"NOT news_muted AND (port_export OR news_agro_text AND (news_strict OR NOT news_generic AND (strict_keyword OR {d.any('kw_news', 'joint')})))"
    p["strict_keyword"] = d.any("kw_strict", "joint")
    # signals
    p["low_call_title"] = d.any("low_value_call", "title_url")
    p["low_title_page"] = (
        f"source_role IN ('support_documents', 'regional_npa') AND ({d.any('low_value_title', 'title_')} OR low_call_title AND low_soft AND NOT {d.any('low_value_exception', 'title_url')}"
        f" OR NOT low_call_title AND (low_soft OR {d.any('low_value_body', 'title_url')} OR {d.any('url_low_value', 'url_')}))"
    )
    p["order_title"] = d.one("приказ", "title_")
    p["public_words"], p["consulting_words"] = d.one("публич", "title_url"), d.one("консультац", "title_url")
    p["deadline_of_discussion"] = d.any("discussion_stage", "deadline_low")
    p["suspended"] = d.one("приостановлен", "joint")
    p["generic_section_title"] = f"orders_title OR {d.titled('titles_generic')}"
    muted = f"{d.rx('rx_no_signals', 'title_twice')} OR {d.rx('rx_news_negated', 'title_twice')} OR NOT title_port AND NOT {title_strong} AND ({d.rx('rx_news_background_title', 'title_')} OR {d.rx('rx_news_market_title', 'title_')})"
    p["title_port"] = f"{d.rx('rx_news_port', 'title_twice')} AND {d.any('news_export', 'title_twice')}"
    p["title_signal"] = f"NOT ({muted}) AND (title_port OR {d.any('news_agro', 'title_twice')} AND ({d.rx('rx_news_strict', 'title_twice')} OR NOT {d.rx('rx_news_generic', 'title_twice')} AND {d.any('kw_news', 'title_twice')}))"
    return p


PAGE_TYPE = Decision("page_type", tuple(Branch(*b) for b in (
    ("year", "year_title", "year_archive"),
    ("low_value", "low_page2", "section_page"),
    ("orders_listing", "orders_listing", "reference_page"),
    ("consultations", "consultations", "reference_page"),
    ("krasnodar_order", "krasnodar_order2", "new_rule"),
    ("admkrai_file", "domain = 'admkrai.krasnodar.ru' AND is_document_file", "new_rule"),
    ("low_section", "low_section2", "section_page"),
    ("generic_section", "generic_section2", "reference_page"),
    ("service_government", "service AND domain = 'government.ru'", "navigation"),
    ("service_strategy_rule", "service AND source_role = 'strategy' AND strategy_signal2 AND regional_signal2", "new_rule"),
    ("service_strategy", "service AND source_role = 'strategy' AND strategy_signal2", "news_background"),
    ("service_regional", "service AND source_role = 'regional_npa' AND regional_signal2", "news_background"),
    ("service", "service", "navigation"),
    ("results_registry", "results_title AND registry_words", "registry"),
    ("results", "results_title", "results_protocol"),
    ("regulation_project", f"domain = '{REGULATION}' AND project_url", "new_rule"),
    ("pravo_donland_listing", "domain = 'pravo.donland.ru' AND donland_reference", "reference_page"),
    ("pravo_donland_act", "domain = 'pravo.donland.ru' AND donland_document", "new_rule"),
    ("pravo_stav_listing", "domain = 'pravo.stavregion.ru' AND stav_reference", "reference_page"),
    ("pravo_stav_act", "domain = 'pravo.stavregion.ru' AND stav_document", "new_rule"),
    ("site_section", "site_section", "section_page"),
    ("ministry_measure", "domain = 'mcx.gov.ru' AND ministry_measure", "measure_card"),
    ("promote_selection", "domain = 'promote.budget.gov.ru' AND selection_view", "selection_announcement"),
    ("mcx_donland", "domain = 'mcx.donland.ru' AND mcx_donland_reference", "reference_page"),
    ("mshsk", "domain = 'mshsk.ru' AND mshsk_reference", "reference_page"),
    ("gisp_measure", "domain = 'gisp.gov.ru' AND measure_url", "measure_card"),
    ("gisp_listing", "domain = 'gisp.gov.ru' AND gisp_menu AND support_title", "reference_page"),
    ("gisp_menu", "domain = 'gisp.gov.ru' AND gisp_menu", "navigation"),
    ("regional_service", "regional AND service_url", "section_page"),
    ("regional_registry", "regional AND service_text AND receiver_words", "registry"),
    ("regional_results", "regional AND service_text AND selection_words", "results_protocol"),
    ("regional_empty", "regional AND service_text", "section_page"),
    ("regional_category", "regional AND chrome AND category_title", "category_page"),
    ("regional_chrome", "regional AND chrome", "section_page"),
    ("section_title", "any_section_title", "section_page"),
    ("category_title", "category_title", "category_page"),
    ("support_catalog", "source_role = 'support_documents' AND catalog2", "reference_page"),
    ("support_menu", "support_menu", "reference_page"),
    ("reference_title", "reference_title", "reference_page"),
    ("says_registry", "says_registry", "registry"),
    ("says_results", "says_results_protocol", "results_protocol"),
    ("says_selection", "says_selection_announcement", "selection_announcement"),
    ("says_measure", "says_measure_card", "measure_card"),
    ("says_rule", "says_new_rule", "new_rule"),
    ("says_deadline", "says_deadline_update", "deadline_update"),
    ("says_reference", "says_reference", "reference_page"),
    ("service_text", "service_text", "section_page"),
    ("sector", "sector_lead OR keywords", "news_background"),
)), "unknown")

#: ok where a measure concerns us; else why not, with the level that is advised.
APPLICABILITY = Decision("applicability", tuple(Branch(*b) for b in (
    ("hard_topic", "hard_topic", "irrelevant"),
    ("news_low", "NOT support_surface AND other_region AND NOT target AND low_topic", "irrelevant"),
    ("news_national", "NOT support_surface AND other_region AND NOT target AND source_role = 'news_signals' AND national_story", "watchlist"),
    ("news_elsewhere", "NOT support_surface AND other_region AND NOT target AND source_role = 'news_signals'", "background"),
    ("market_elsewhere", "NOT support_surface AND other_region AND NOT target AND market_story", "watchlist"),
    ("elsewhere", "NOT support_surface AND other_region AND NOT target", "background"),
    ("no_measure", "NOT support_surface", "ok"),
    ("excluded_topic", "excluded_topic", "irrelevant"),
    ("local_moscow", "target_is_moscow AND NOT federal_scope AND NOT moscow_concern", "background"),
    ("measure_market", "other_region AND NOT target AND market_story", "watchlist"),
    ("measure_elsewhere", "other_region AND NOT target", "background"),
    ("ours", "target OR federal_scope", "ok"),
)), "ok")

ACTION_LEVEL = Decision("action_level", tuple(Branch(*b) for b in (
    ("excluded", "applicability_branch IN ('hard_topic', 'excluded_topic')", "irrelevant"),
    ("quiet_foreign", "quiet AND gated AND NOT agro", "irrelevant"),
    ("quiet_strategy", "quiet AND source_role = 'strategy' AND strategy_signal", "watchlist"),
    ("quiet_regional_strong", "quiet AND source_role = 'regional_npa' AND regional_signal AND strong_regional", "requires_attention"),
    ("quiet_regional", "quiet AND source_role = 'regional_npa' AND regional_signal", "watchlist"),
    ("quiet", "quiet", "irrelevant"),
    ("corruption", "corruption", "irrelevant"),
    ("off_domain", "off_domain", "background"),
    ("heritage", "source_role = 'regional_npa' AND heritage_page", "background"),
    ("krasnodar_exhibits", "krasnodar_order AND exhibits", "background"),
    ("krasnodar_near", "krasnodar_order AND application_status = 'open' AND order_near", "requires_attention"),
    ("krasnodar_order", "krasnodar_order", "watchlist"),
    ("foreign_sector", "gated AND NOT agro AND NOT subsidy_title AND page_type IN ('selection_announcement', 'measure_card', 'new_rule', 'deadline_update', 'news_background', 'unknown')", "background"),
    ("not_applicable", "applicability <> 'ok'", "{applicability}"),
    ("regulation_foreign", f"domain = '{REGULATION}' AND NOT agro AND NOT subsidy_title AND NOT (has_deadline AND subsidy_words)", "background"),
    ("list_consultations", "page_type IN ('registry', 'results_protocol', 'reference_page') AND source_role = 'regional_npa' AND consultations", "background"),
    ("list_regional_project", "page_type = 'reference_page' AND source_role = 'regional_npa' AND discussion AND regional_signal", "watchlist"),
    ("list_regional", "page_type IN ('registry', 'results_protocol', 'reference_page') AND source_role = 'regional_npa'", "background"),
    ("list_catalog", "page_type IN ('registry', 'results_protocol', 'reference_page') AND source_role = 'support_documents' AND catalog", "background"),
    ("list_document", "page_type = 'reference_page' AND source_role = 'support_documents' AND NOT support_title AND NOT generic_section AND (strict OR discussion OR has_deadline OR application_status = 'open') AND document_signal", "watchlist"),
    ("list_documents", "page_type IN ('registry', 'results_protocol', 'reference_page') AND source_role = 'support_documents'", "background"),
    ("list_section", "page_type = 'reference_page' AND regional AND (support_title OR generic_section)", "background"),
    ("list_hinted", "page_type IN ('registry', 'results_protocol', 'reference_page') AND (hinted OR support_context)", "watchlist"),
    ("list", "page_type IN ('registry', 'results_protocol', 'reference_page')", "background"),
    ("low_section_call", "page_type IN ('section_page', 'category_page') AND low_section AND (strict OR discussion)", "watchlist"),
    ("low_section", "page_type IN ('section_page', 'category_page') AND low_section", "irrelevant"),
    ("low_page_call", "low_page AND (strict OR discussion OR has_deadline)", "watchlist"),
    ("low_page", "low_page", "irrelevant"),
    ("catalog", "source_role = 'support_documents' AND catalog", "background"),
    ("document_generic", "source_role = 'support_documents' AND page_type IN ('section_page', 'category_page') AND generic_section", "background"),
    ("document_section_call", "source_role = 'support_documents' AND page_type IN ('section_page', 'category_page') AND document_signal AND strict", "watchlist"),
    ("document_section", "source_role = 'support_documents' AND page_type IN ('section_page', 'category_page')", "background"),
    ("regional_section_project", "source_role = 'regional_npa' AND page_type IN ('section_page', 'category_page', 'year_archive') AND regional_signal AND discussion", "watchlist"),
    ("regional_section", "source_role = 'regional_npa' AND page_type IN ('section_page', 'category_page', 'year_archive')", "background"),
    ("closed_hinted", "application_status = 'closed' AND (hinted OR support_context)", "watchlist"),
    ("closed", "application_status = 'closed'", "background"),
    ("strategy_subsidy", "source_role = 'strategy' AND subsidy_title", "watchlist"),
    ("strategy_near", "source_role = 'strategy' AND discussion_near AND discussion", "watchlist"),
    ("strategy_future", "source_role = 'strategy' AND discussion_future AND discussion", "watchlist"),
    ("strategy_discussion", f"source_role = 'strategy' AND domain <> '{REGULATION}' AND discussion AND alive", "requires_attention"),
    ("strategy_procedure", f"source_role = 'strategy' AND domain = '{REGULATION}' AND has_deadline AND subsidy_words", "watchlist"),
    ("strategy_government", f"source_role = 'strategy' AND domain = 'government.ru' AND page_type IN {ACTIONABLE} AND strict AND (strategy_signal OR watch_title)", "requires_attention"),
    ("strategy_signal", "source_role = 'strategy' AND (strategy_signal OR action_words OR keywords)", "watchlist"),
    ("strategy", "source_role = 'strategy'", "background"),
    ("regulation_near", f"domain = '{REGULATION}' AND discussion_near AND discussion", "watchlist"),
    ("regulation_procedure", f"domain = '{REGULATION}' AND has_deadline AND subsidy_words", "watchlist"),
    ("regulation_future", f"domain = '{REGULATION}' AND discussion_future AND discussion", "watchlist"),
    ("regulation_hinted", f"domain = '{REGULATION}' AND (discussion OR action_words OR keywords)", "watchlist"),
    ("regulation", f"domain = '{REGULATION}'", "background"),
    ("generic_hinted", "support_title AND NOT strict_title AND (hinted OR support_context)", "watchlist"),
    ("generic", "support_title AND NOT strict_title", "background"),
    ("measure_foreign_order", f"support_context AND page_type IN {ACTIONABLE} AND foreign_order", "background"),
    ("measure_elsewhere", f"support_context AND page_type IN {ACTIONABLE} AND NOT target_region AND NOT federal_measure", "background"),
    ("measure_regional_strong", f"support_context AND page_type IN {ACTIONABLE} AND source_role = 'regional_npa' AND strong_regional", "requires_attention"),
    ("measure_inactive", f"support_context AND page_type IN {ACTIONABLE} AND support_status = 'inactive'", "background"),
    ("measure_strong", f"support_context AND page_type IN {ACTIONABLE} AND strong_support", "requires_attention"),
    ("measure_regular", f"support_context AND page_type IN {ACTIONABLE} AND support_status = 'active' AND application_status = 'regular' AND (has_deadline OR source_role <> 'active_support_measures' AND (strict OR permanent))", "requires_attention"),
    ("measure_hinted", f"support_context AND page_type IN {ACTIONABLE} AND hinted", "watchlist"),
    ("measure", f"support_context AND page_type IN {ACTIONABLE}", "background"),
    ("regional_strong", f"source_role = 'regional_npa' AND page_type IN {ACTIONABLE} AND regional_signal AND strong_regional", "requires_attention"),
    ("regional_project", "source_role = 'regional_npa' AND discussion AND regional_signal", "watchlist"),
    ("regional_rule", f"source_role = 'regional_npa' AND page_type IN {ACTIONABLE} AND regional_signal", "watchlist"),
    ("regional", "source_role = 'regional_npa'", "background"),
    ("documents", "source_role = 'support_documents'", "background"),
    ("strict", f"page_type IN {ACTIONABLE} AND strict AND support_status <> 'inactive'", "requires_attention"),
    ("news_duty", "source_role = 'news_signals' AND news_signal AND preliminary_duty", "watchlist"),
    ("news_strong", "source_role = 'news_signals' AND news_signal AND strong_news", "requires_attention"),
    ("ministry_news", "ministry_news", "watchlist"),
    ("section_hinted", "page_type IN ('section_page', 'category_page', 'year_archive') AND hinted", "watchlist"),
    ("section", "page_type IN ('section_page', 'category_page', 'year_archive')", "background"),
    ("news_signal", "source_role = 'news_signals' AND news_signal", "watchlist"),
    ("news", "source_role = 'news_signals'", "background"),
    ("press_hinted", "page_type = 'news_background' AND (watch_title OR watch_body OR keywords)", "watchlist"),
    ("press", "page_type = 'news_background'", "background"),
    ("watched", "watch_title OR keywords AND watch_body", "watchlist"),
    ("mentioned", "action_words OR keywords", "background"),
)), "irrelevant")

LISTED = "('reference_page', 'section_page', 'category_page', 'year_archive')"
SIGNAL = Decision("signal", tuple(Branch(*b) for b in (
    ("not_applicable", "applicability <> 'ok'", "not_applicable"),
    ("corruption", "corruption", "corruption"),
    ("foreign_sector", "action_level IN ('background', 'irrelevant') AND support_status <> 'inactive' AND application_status <> 'closed' AND gated AND NOT agro AND page_type IN ('selection_announcement', 'measure_card', 'new_rule', 'deadline_update', 'news_background', 'unknown')", "foreign_sector"),
    ("results", "page_type IN ('results_protocol', 'registry')", "results"),
    ("low_page", "low_title_page", "low_page"),
    ("orders", "page_type = 'reference_page' AND order_title", "orders"),
    ("project", f"source_role = 'strategy' AND domain = '{REGULATION}' AND deadline_of_discussion", "project"),
    ("strategy_dated", "source_role = 'strategy' AND (has_deadline OR public_words)", "strategy_dated"),
    ("strategy", "source_role = 'strategy'", "strategy"),
    ("regional_public", "source_role = 'regional_npa' AND (public_words OR consulting_words)", "regional_public"),
    ("regional_listed", f"source_role = 'regional_npa' AND page_type IN {LISTED}", "regional_listed"),
    ("regional_urgent", "source_role = 'regional_npa' AND action_level = 'requires_attention'", "regional_urgent"),
    ("regional", "source_role = 'regional_npa'", "regional"),
    ("documents_listed", "source_role = 'support_documents' AND page_type IN ('reference_page', 'section_page', 'category_page')", "listed"),
    ("krasnodar_open", "krasnodar_order AND application_status = 'open' AND has_deadline", "krasnodar_open"),
    ("krasnodar_suspended", "krasnodar_order AND application_status = 'closed' AND suspended", "krasnodar_suspended"),
    ("krasnodar", "krasnodar_order", "krasnodar"),
    ("ministry", "source_role = 'news_signals' AND ministry_news", "ministry"),
    ("news", "source_role = 'news_signals' AND title_signal", "news"),
    ("market", "source_role = 'news_signals'", "market"),
    ("section", "page_type IN ('reference_page', 'section_page') AND generic_section_title AND regional", "listed"),
    ("measure_listing", "page_type = 'reference_page' AND support_context", "measure_listing"),
    ("measure_elsewhere", "support_context AND NOT target_region AND NOT federal_measure AND support_status = 'active'", "measure_elsewhere"),
    ("inactive", "support_status = 'inactive'", "inactive"),
    ("closed", "application_status = 'closed'", "closed"),
    ("regular", "support_status = 'active' AND application_status = 'regular' AND NOT permanent", "regular"),
    ("permanent", "support_status = 'active' AND application_status = 'regular'", "permanent"),
    ("open", "application_status = 'open'", "open"),
    ("new_rule", "action_level = 'requires_attention' AND page_type = 'new_rule'", "new_rule"),
    ("measure", "support_context", "measure"),
)), "default")
#: Texts of signals; {why} and {deadline} are put in: fixed values.
SIGNALS = {
    "not_applicable": "{why}",
    "corruption": "Внутренний административный/антикоррупционный приказ; прямой GR-сигнал для АПК не выявлен.",
    "foreign_sector": "Непрофильный документ: контекст АПК или сельского хозяйства не подтвержден.",
    "results": "Результаты/протокол отбора: не требует срочной реакции",
    "low_page": "Общий раздел/служебная страница; прямой GR-сигнал не выявлен.",
    "orders": "Общий раздел документов/приказов; прямой GR-сигнал не выявлен.",
    "project": "Проект НПА на публичном обсуждении со сроком; проверить влияние и необходимость GR-позиции.",
    "strategy_dated": "Стратегический федеральный документ с обсуждением или сроком; держать на контроле.",
    "strategy": "Стратегический федеральный сигнал по господдержке или порядку регулирования.",
    "regional_public": "Региональный НПА / публичные консультации по профильной теме; держать на наблюдении.",
    "regional_listed": "Общий раздел/архив НПА; прямой GR-сигнал не выявлен.",
    "regional_urgent": "Региональный НПА с прямым действием: проверить порядок, условия вступления в силу и сроки.",
    "regional": "Региональный НПА по профильной теме: держать на наблюдении.",
    "listed": "Общий раздел/список документов; прямой GR-сигнал не выявлен.",
    "krasnodar_open": "Открыт конкурсный отбор или приём заявок Минсельхоза Краснодарского края (срок подачи: {deadline}): проверить условия участия.",
    "krasnodar_suspended": "Приём заявок по данной мере поддержки приостановлен. Отслеживать возобновление или новый конкурсный отбор.",
    "krasnodar": "Региональный приказ Минсельхоза Краснодарского края по субсидии, гранту или порядку поддержки; держать на наблюдении.",
    "ministry": "Официальная новость Минсельхоза с GR-сигналом по господдержке, регулированию, экспорту, логистике или цифровизации АПК.",
    "news": "Новостной предвестник возможных изменений господдержки, экспорта или регулирования.",
    "market": "Рыночный или отраслевой фон без прямого регуляторного сигнала.",
    "measure_listing": "Страница похожа на раздел/листинг мер поддержки, не на конкретную карточку меры.",
    "measure_elsewhere": "Активная мера поддержки вне целевой географии; оставлена для справки.",
    "inactive": "Неактивная мера поддержки: оставить в справочном блоке",
    "closed": "Прием заявок или отбор завершены: срочная реакция не требуется",
    "regular": "Постоянная федеральная мера поддержки; срочное окно подачи не выявлено.",
    "permanent": "Активная федеральная мера поддержки, действует на регулярной основе",
    "open": "Найден признак приема заявок",
    "new_rule": "Найдено изменение порядка или новый регуляторный акт",
    "measure": "Справочная мера поддержки без срочного действия",
    "default": "Отраслевой фон без прямого действия",
}
#: Why a measure does not concern us, by branch of applicability: fixed values.
WHY_TOPIC, WHY_REGION = "Непрофильная для AHSTEP тема; документ сохранён только для архива.", "Регион вне фокуса AHSTEP; документ сохранён справочно."
WHY = {
    "hard_topic": WHY_TOPIC, "excluded_topic": WHY_TOPIC, "news_low": WHY_REGION, "news_national": WHY_REGION, "news_elsewhere": WHY_REGION, "market_elsewhere": WHY_REGION, "elsewhere": WHY_REGION,
    "local_moscow": "Локальная мера Московской области без федеральной, корпоративной, логистической или финансовой привязки; документ сохранён справочно.",
    "measure_market": SIGNALS["measure_elsewhere"], "measure_elsewhere": SIGNALS["measure_elsewhere"],
}


def by_name(texts: Mapping[str, str], name: Column) -> Column:
    """The text of a name."""
    out = None
    for n, t in texts.items():
        out = F.when(name == n, t) if out is None else out.when(name == n, t)
    return out


IMPORTANCE = {"requires_attention": "high", "watchlist": "medium", "background": "low", "irrelevant": "low"}


def importance(level: Column) -> Column:
    """M5."""
    out = None
    for name, value in IMPORTANCE.items():
        out = F.when(level == name, value) if out is None else out.when(level == name, value)
    return out


def guard_views() -> dict[str, str]:
    """Views of the guard over news: title, summary, lead and the texts that an analysis wrote."""
    told = lambda *parts: "lower(concat_ws(' ', " + ", ".join(f"nullif({p}, '')" for p in parts) + "))"
    return {
        "announced": told("title", "summary", "substr(raw_text, 1, 2000)"),
        "signalled": told("title", "summary", "reason", "impact", "substr(raw_text, 1, 2000)"),
        "noisy": told("title", "summary", "reason", "impact", "substr(raw_text, 1, 2000)", "signal"),
        "traded": told("title", "summary", "reason", "impact", "signal", "substr(raw_text, 1, 2000)"),
        "considered": told("title", "summary", "reason", "impact", "signal", "substr(raw_text, 1, 3000)"),
        "written": told("reason", "impact", "signal"),
    }


def guard_predicates(d: Plain) -> dict[str, str]:
    duty = f"{d.any('duty_export', 'considered')} AND {d.one('пошлин', 'considered')} AND {d.any('duty_goods', 'considered')} AND {d.any('duty_market', 'considered')}"
    return {
        "news": "source_role = 'news_signals'",
        "event_only": f"{d.any('guard_event', 'announced')} AND NOT {d.any('guard_outcome', 'announced')}",
        "duty_only": f"NOT {d.any('policy_bound', 'considered')} AND {d.any('policy_considered', 'considered')} AND {d.any('guard_federal_words', 'considered')} AND {duty}",
        "trade_abroad": f"{d.any('guard_country', 'traded')} AND {d.any('guard_trade', 'traded')} AND NOT {d.any('guard_home', 'traded')}",
        "market_only": d.one(MARKET_BACKGROUND, "written"),
        "guard_speaks": d.any("guard_signal", "signalled"),
        "guard_visible": f"guard_speaks OR {d.any('guard_authority', 'signalled')} AND {d.any('guard_deed', 'signalled')} OR {d.any('guard_sector', 'signalled')} AND {d.any('guard_export', 'signalled')}",
        "guard_negated": d.rx("rx_guard_negated", "signalled"),
        "event_text": f"{d.any('guard_event', 'signalled')} AND NOT {d.any('guard_outcome', 'signalled')}",
        "price_story": f"{d.one('экспорт', 'signalled')} AND NOT {d.any('guard_export', 'signalled')} AND {d.any('guard_prices', 'signalled')}",
        "weak_story": f"({d.any('guard_meeting', 'signalled')} OR {d.any('guard_building', 'signalled')}) AND NOT {d.any('guard_sector', 'signalled')} AND NOT guard_speaks",
        "noise_words": d.any("guard_noise", "noisy"),
        "noise_story": "page_type IN ('', 'news_background') AND (event_text OR guard_negated AND noise_words OR NOT guard_negated AND NOT guard_visible AND (price_story OR weak_story OR noise_words))",
    }


GUARD = Lowering("guard", LEVELS, (
    ("event", ("requires_attention", "watchlist"), "news AND event_only", "background"),
    ("duty", ("requires_attention",), "news AND duty_only", "watchlist"),
    ("abroad", ("requires_attention",), "news AND trade_abroad", "background"),
    ("market", ("requires_attention", "watchlist"), "news AND market_only", "background"),
    ("noise", ("watchlist",), "news AND noise_story", "background"),
))
GUARD_SEEN = ("announced", "signalled", "noisy", "traded", "considered", "written")


def groups(keywords: Mapping[str, Sequence[str]] | None = None) -> dict[str, tuple[str, ...]]:
    """All groups that the rules name. Keywords come by group; a document's keywords are those of any group."""
    g = vocabulary(keywords)
    of = lambda *names: tuple(dict.fromkeys(k for n in names for k in g.get(f"kw_{n}", ())))
    common = ("support_measures", "subsidy_terms", "regulatory_change", "public_discussion")
    return g | {
        "kw_strategy": of(*common, "credit_terms"), "kw_regional": of(*common), "kw_hit": g["kw"],
        "kw_news": of("support_measures", "subsidy_terms", "credit_terms", "export_support", "grain_support", "regulatory_change"),
    }


#: Words that are asked for one by one.
SINGLES = (
    "/content/", "/documents/", "приказ", "апк", "субсид", "министерств", "сельского хозяйства", "сельхоз", "агропромышлен", "гисп", "реестр", "получател", "список", "/doc/view/", "/gospodderzhka/obyavleniya-20",
    "/public/minfin/selection/view/", "/projects/", "/measure/", "/nmp/main/", "навига", " нао ", "promote.budget.gov.ru", "господдерж", "порядок предоставления субсид", "изменени", "mcx.gov.ru", "gisp", "меры поддержки",
    "subsid", "публич", "консультац", "приостановлен", "федерал", "экспорт", "сельск", "минсельхоз", "пошлин", KRASNODAR, MINISTRY_NEWS, MARKET_BACKGROUND,
)


def base_columns(d: Plain) -> dict[str, str]:
    """Lower case texts and the host."""
    host = "CASE " + " ".join(f"WHEN contains(lower(source_name || ' ' || url), '{h}') THEN '{h}'" for h in HOSTS) + " ELSE " + ("lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))") + " END"
    return {"title_": "trim(" + d.replaced("lower(title)", r"^\s+|\s+$", "") + ")", "body_": "lower(raw_text)", "url_": "lower(url)", "source_": "lower(source_name)", "domain": host}


def leveled(df: DataFrame, as_of: str, keywords: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """df with page_type, applicability, action_level, their branches, importance, matched_keywords, and business_signal with its branch (M9).

    Columns of df that are called as working ones come back unharmed.
    """
    d = Bits(groups(keywords), SINGLES)
    blank = {"string": F.lit(""), "boolean": F.lit(False)}
    given = {c: F.coalesce(F.col(c).cast(t), blank[t]) if t in blank else F.col(c).cast(t) for c, t in INPUTS.items()}
    aside, back = set_aside(df, ("page_type", "page_type_branch", "applicability", "applicability_branch", "action_level", "action_level_branch", "importance", "matched_keywords", "signal_branch", "business_signal"))
    out = df.select(*aside, *(c.alias(n) for n, c in given.items()))
    out = out.withColumns({n: F.expr(e) for n, e in base_columns(d).items()})
    out = out.withColumns({n: F.expr(e) for n, e in views(d).items()})
    out = out.withColumn("seen_", d.markers.scan(**{v: F.col(v) for v in SEEN}))
    every = predicates(d, as_of)
    late = {n for n, e in every.items() if "page_type" in e}
    while more := {n for n, e in every.items() if n not in late and set(late) & set(named(e))}:
        late |= more
    out = PAGE_TYPE.decide(with_predicates(out, {n: e for n, e in every.items() if n not in late}))
    out = with_predicates(out, {n: e for n, e in every.items() if n in late})
    out = SIGNAL.decide(ACTION_LEVEL.decide(APPLICABILITY.decide(out)))
    why = F.coalesce(by_name(WHY, F.col("applicability_branch")), F.lit(""))
    told = F.replace(F.replace(by_name(SIGNALS, F.col("signal")), F.lit("{why}"), why), F.lit("{deadline}"), F.col("deadline_text"))
    hits = d.markers.which(("seen_.title_", "seen_.body_"), list(d.groups["kw_hit"]))
    return out.select(*back, "page_type", "page_type_branch", "applicability", "applicability_branch", "action_level", "action_level_branch", importance(F.col("action_level")).alias("importance"), hits.alias("matched_keywords"), "signal_branch", told.alias("business_signal"))


def guarded(df: DataFrame) -> DataFrame:
    """df (action_level, source_role, title, summary, reason, impact, signal, raw_text, page_type) with the level lowered where news is mere background, and guard_step."""
    d = Bits(groups(), SINGLES)
    texts = ("title", "summary", "reason", "impact", "signal", "raw_text", "source_role", "page_type")
    aside, back = set_aside(df, ("action_level", "guard_step"))
    out = df.select(*aside, "action_level", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in texts))
    out = out.withColumns({n: F.expr(e) for n, e in guard_views().items()})
    out = out.withColumn("seen_", d.markers.scan(**{v: F.col(v) for v in GUARD_SEEN}))
    out = GUARD.apply(with_predicates(out, guard_predicates(d)), "action_level")
    return out.select(*back, "action_level", "guard_step")


def with_facts(df: DataFrame, as_of: Column) -> DataFrame:
    """Adds deadline_text, deadline_date, discussion_date, application_status and support_status from title and text."""
    text = F.concat_ws(" ", "title", "raw_text")
    found = facts.facts(text, as_of)
    df = df.withColumn("_facts", found)
    df = df.withColumns({c: F.col(f"_facts.{c}") for c in ("deadline_text", "application_status", "support_status")}).drop("_facts")
    return df.withColumns({"deadline_date": dates.parse_deadline(F.col("deadline_text")), "discussion_date": F.coalesce(dates.regulation_deadline(F.col("deadline_text")), dates.regulation_deadline(F.substring(text, 1, 5000)))})
