"""Queries and their DuckDB equivalents, by name."""

from __future__ import annotations

from . import catalog_queries, event_queries, geometry_queries, record_queries, text_queries

_MODULES = (catalog_queries, record_queries, text_queries, geometry_queries, event_queries)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: s for m in _MODULES for name, s in m.ORACLES.items()}
