"""Registry of the library's own queries and their DuckDB SQL."""

from __future__ import annotations

from .plans import answer_queries, io_queries, metric_queries  # noqa: F401  (all fill the registry)

QUERIES = answer_queries.QUERIES
ORACLES = answer_queries.ORACLES
