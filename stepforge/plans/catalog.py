"""All queries of the library's own operators."""

from __future__ import annotations

from stepforge.plans import audit_queries, episode_queries, graph_queries, located_queries, membership_queries, release_queries, report_queries, rule_queries, source_queries, split_queries, stream_queries  # noqa: F401  each registers its queries
from stepforge.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
