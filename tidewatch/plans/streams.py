"""Streaming queries, checked against batch SQL."""

from __future__ import annotations

from tidewatch.plans.registry import registry
from tidewatch.sources import tables as T
from tidewatch.streaming import weekly

QUERIES, ORACLE, query = registry()


@query("stream_weekly", "SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_weekly(spark, d):
    return weekly.run_available(spark, f"{d}/events.parquet", lambda f: f.select("event_type", "ts").where("ts is not null"), weekly.weekly_counts, "ts")


@query("stream_sessions", f"WITH n AS (SELECT upper(trim(country_iso3)) || '|' || upper(trim(disease)) AS entity_key, notification_date AS nd FROM canonical_events WHERE notification_date {T._OK}), s AS (SELECT *, CASE WHEN nd - lag(nd) OVER (PARTITION BY entity_key ORDER BY nd) < 56 THEN 0 ELSE 1 END AS new FROM n), g AS (SELECT *, sum(new) OVER (PARTITION BY entity_key ORDER BY nd ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT entity_key, min(nd) AS start, count(*) AS n FROM g GROUP BY entity_key, k")
def stream_sessions(spark, d):
    """Episodes of notifications as sessions with a quiet gap of 56 days."""
    return weekly.run_available(spark, f"{d}/canonical_events.parquet", weekly.notifications, lambda f: weekly.sessions(f, "entity_key", "nd", "55 days"), "nd")
