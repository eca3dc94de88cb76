"""All registered queries."""

from __future__ import annotations

from aerotrace.plans import (  # noqa: F401 - importing registers the queries
    ingest_queries,
    learning_queries,
    schedule_queries,
    serving_queries,
    streaming_queries,
    track_queries,
    trajectory_queries,
)
from aerotrace.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
