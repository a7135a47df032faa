"""Queries of matrices that grow with a stream."""

from __future__ import annotations

from matloom import streaming
from matloom.queries.base import query
from matloom.sources.tables import table


@query("event_counts", "SELECT date_trunc('day', ts) AS start, user_id AS row_id, event_type AS col_id, count(*)::DOUBLE AS value FROM events GROUP BY ALL")
def event_counts(spark, d):
    """Daily users by event types, from the table; the same function serves a stream."""
    return streaming.counts(table(spark, d, "events"), "user_id", "event_type", "ts", "1 day")
