"""Tables and closed vocabularies of the document monitor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("requires_attention", "watchlist", "background", "irrelevant")
IMPORTANCE = ("high", "medium", "low")
SUPPORT = ("active", "inactive", "unknown")
APPLICATION = ("open", "closed", "regular", "unknown")
ROLES = ("strategy", "support_documents", "regional_npa", "active_support_measures", "news_signals")
PRIORITIES = ("high", "medium", "low")
QUEUE_STATES = ("pending", "in_review", "done", "skipped")
SECTIONS = ("requires_attention", "measures_and_selections", "regional_npa", "strategy_signals", "news_signals")
BUCKETS = ("target_region", "federal", "watch_region", "non_target_region", "global_market", "other")

TABLES = {
    "documents": "id long, source_name string, source_url string, level string, region string, title string, url string, published_at timestamp, collected_at timestamp, content_hash string, raw_text string, local_file_path string, document_type string, is_relevant boolean, relevance_reason string, topic string, importance string, action_level string, page_type string, summary string, impact string, support_status string, is_active boolean, is_continuous boolean, application_status string, npa_number string, deadline_text string, terms_text string, business_signal string, risk_notes string, notified boolean, status string, error string",
    "source_errors": "id long, source_name string, source_url string, error string, collected_at timestamp",
    "source_audit": "id long, source_name string, source_url string, enabled boolean, attempted_at timestamp, success_at timestamp, error_at timestamp, error_message string, fetched int, saved int, existing int, duplicates int, item_errors int, links_found int, links_filtered int, filtered_samples string",
    "extraction_audit": "id long, source_name string, source_url string, document_url string, attachment_url string, file_type string, extracted_type string, raw_text_length int, has_text boolean, scan_candidate boolean, needs_ocr boolean, ocr_status string, ocr_text_length int, ocr_pages_processed int, ocr_error string, page_count int, extraction_error string, collected_at timestamp",
    "ocr_queue": "id long, document_url string, source_name string, title string, priority string, status string, reason string, created_at timestamp, updated_at timestamp, notes string",
    "runtime_events": "event_name string, updated_at timestamp, details string",
    "user_preferences": "chat_id string, default_period_days int, updated_at timestamp",
    "allowed_users": "user_id long, username string, first_name string, last_name string, added_by string, added_at timestamp, is_active boolean",
    "tracking_items": "id long, chat_id string, document_url string, document_id long, active boolean, created_at timestamp, last_checked_at timestamp",
    "tracking_snapshots": "id long, tracking_item_id long, checked_at timestamp, status_hash string, support_status string, application_status string, deadline_text string, terms_text string, is_active boolean, title string, summary string",
    "tracking_events": "id long, tracking_item_id long, detected_at timestamp, change_summary string, old_hash string, new_hash string, notified_at timestamp",
    "enrichments": "id long, document_url string, document_id long, provider string, model string, prompt_version string, status string, facts_json string, source_hash string, executive_summary string, business_impact string, recommended_action string, deadline_hint string, confidence double, error string, enriched_at timestamp, created_at timestamp, updated_at timestamp",
}


def rank_of(value: Column, order: tuple[str, ...], unknown: int = 0) -> Column:
    """Points of an ordinal value: the first of the order gets the most, unknown or null values `unknown`."""
    out = None
    for i, v in enumerate(order):
        out = F.when(value == v, len(order) - i) if out is None else out.when(value == v, len(order) - i)
    return out.otherwise(unknown)


def within(value: Column, allowed: tuple[str, ...], default: str | None) -> Column:
    """Values outside a closed vocabulary become the default."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table in order and type: missing ones null, unknown ones dropped."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(TABLES[name]).fields
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
