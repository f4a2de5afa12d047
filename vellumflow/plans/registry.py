"""Registered queries over the driver's tables, by name, with their SQL."""

from __future__ import annotations

from . import reply_queries, stored_queries  # noqa: F401  these register their queries
from .queries import QUERIES, SQL

FLAGSHIP = "fact_counts"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
