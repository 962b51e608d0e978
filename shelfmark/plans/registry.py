"""Name to query, and to the SQL that gives the same rows."""

from __future__ import annotations

from . import content_queries, job_queries  # noqa: F401  they register their queries
from .catalogue_queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
