"""All registered queries of the engine."""

from __future__ import annotations

from . import library_queries, search_queries, text_queries  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
