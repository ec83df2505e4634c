"""All queries of the engine's own operators."""

from __future__ import annotations

from folioscope.plans import derived_queries, gate_queries, govern_queries, ingest_queries, kernel_queries, more_queries, page_queries, record_queries, registry, retrieval_queries, review_queries, scoped_queries, splitter_queries, stream_queries, table_queries, verify_queries  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE_SQL)
