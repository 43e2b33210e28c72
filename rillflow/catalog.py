"""Registry of the event-stream queries."""

from __future__ import annotations

from .plans import event_queries, governance_queries, journal_queries, monitoring_queries, stream_queries, transport_queries

MODULES = [event_queries, monitoring_queries, transport_queries, stream_queries, journal_queries, governance_queries]


def flagship(spark, sf_dir):
    return event_queries.flagship(spark, sf_dir)


def queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}
