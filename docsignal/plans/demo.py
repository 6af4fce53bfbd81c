"""Queries that need more than tables: a report from stored state, and streams run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ingest
from .registry import query


@query("SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1")
def stream_counts(t, spark):
    """The work queue drained as a stream of micro-batches equals one batch."""
    return ingest.drained(t("events"), ["event_type"], [F.count("*").alias("n"), F.max("event_id").alias("last_id")])
