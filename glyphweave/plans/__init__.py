"""Registered queries of the document-structure engine."""

from __future__ import annotations

from . import aggregates, documents, graph, joins, layout, more, outputs, pdf, scalars, windows
from .registry import QUERIES, SQL, COVERS

__all__ = ["COVERS", "aggregates", "documents", "graph", "joins", "more", "outputs", "pdf", "scalars", "windows", "flagship", "oracle_sql", "queries"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


def flagship(spark, sf_dir):
    """Lines to regions in reading order, summed up by document and kind."""
    return layout.region_summary(spark, sf_dir)
