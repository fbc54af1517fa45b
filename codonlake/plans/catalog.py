"""The registered queries of the library, and their DuckDB twins."""

from __future__ import annotations

from codonlake.plans import annotation, counting, finish, genome, inference, models, quality, resampling

MODULES = (annotation, counting, inference, models, genome, finish, quality, resampling)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
