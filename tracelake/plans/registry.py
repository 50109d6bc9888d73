"""All of the library's own named queries and their SQL."""

from __future__ import annotations

from tracelake.plans.oracle import SQL
from tracelake.plans.queries import QUERIES

FLAGSHIP = "fts_search"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
