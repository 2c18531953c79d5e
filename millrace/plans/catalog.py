"""Registry of the reference-parity queries and their oracles."""

from __future__ import annotations

from millrace.plans import corpus_queries, numeric_queries, report_queries, token_queries

MODULES = (corpus_queries, report_queries, token_queries, numeric_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
