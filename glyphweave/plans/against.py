"""Queries that call the library, held against SQL that is told apart."""

from __future__ import annotations

from .registry import Query, query
from .sql import TOLD


def against(f: Query) -> Query:
    """Register a query with the inventory rows and the SQL told under its name."""
    covers, sql = TOLD[f.__name__]
    return query(covers, sql)(f)
