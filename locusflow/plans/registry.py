"""All registered queries of the library, and their SQL."""

from __future__ import annotations

from . import base_queries, full_queries, null_queries, resample_queries, source_queries, table_queries

MODULES = [base_queries, resample_queries, null_queries, table_queries, source_queries, full_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
