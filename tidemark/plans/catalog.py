"""The queries of the reference's operators and their DuckDB SQL."""

from __future__ import annotations

from . import decision_queries, page_queries, retrieval_queries, series_queries, signal_queries, table_queries, text_queries

FLAGSHIP = "sg02_decision_board"
MODULES = [series_queries, text_queries, decision_queries, table_queries, signal_queries, retrieval_queries, page_queries]


def queries() -> dict:
    return {name: make for m in MODULES for name, make in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
