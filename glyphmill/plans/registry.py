"""All queries of the core."""

from __future__ import annotations

from glyphmill.plans import further_queries, line_queries, more_queries, operator_queries, records, text_queries

_MODULES = [records, text_queries, line_queries, operator_queries, more_queries, further_queries]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.oracle_sql().items()}
