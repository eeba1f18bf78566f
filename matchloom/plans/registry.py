"""Every named query with its SQL twin."""

from __future__ import annotations

from matchloom.plans import base, ingest_queries, learned_queries, ranking_queries, score_queries, text_queries, vector_queries  # noqa: F401


def queries() -> dict:
    return base.QUERIES


def oracle_sql() -> dict[str, str]:
    return base.ORACLE
