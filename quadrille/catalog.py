"""Registered queries of the library's own operators, with the SQL that must give the same rows."""

from __future__ import annotations

from .plans import conversion_queries, function_queries, graph_queries, io_queries, search_queries, sync_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
