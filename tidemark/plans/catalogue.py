"""All named queries of the engine."""

from __future__ import annotations

from tidemark.plans import detection_queries, geometry_queries, join_queries, log_queries, matching_queries, stream_queries, visit_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
