"""Queries and DuckDB SQL of this subpackage's operators. The pipeline over them is registered by the entry module."""

from __future__ import annotations

from codonlake.llm import queries_basic, queries_conversations, queries_pairs, queries_text

MODULES = [queries_basic, queries_conversations, queries_pairs, queries_text]


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
