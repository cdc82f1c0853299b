"""What queries must give, told in DuckDB's SQL over the driver tables and, as common table expressions, the document fixtures.

Nothing here is run by Spark: the queries of the same names call the library.
"""

from __future__ import annotations

import re
from importlib import import_module

from ... import fixtures as fx

#: Name of a query: the inventory rows it stands for, and its SQL.
TOLD: dict[str, tuple[str, str]] = {}

FIXTURES = {
    "doc_lines": (fx.DOC_LINES,),
    "doc_pages": (fx.DOC_LINES, fx.DOC_PAGES),
    "doc_segments": (fx.DOC_LINES, fx.DOC_PAGES, fx.DOC_SEGMENTS),
    "doc_fills": (fx.DOC_LINES, fx.DOC_PAGES, fx.DOC_FILLS),
    "doc_images": (fx.DOC_LINES, fx.DOC_PAGES, fx.DOC_IMAGES),
    "table_rows": (fx.TABLE_ROWS,),
    "table_cells": (fx.TABLE_ROWS, fx.TABLE_CELLS),
    "node_tree": (fx.NODE_TREE,),
}


def with_fixtures(sql: str) -> str:
    """The SQL with the fixtures it reads as common table expressions before its own."""
    read = [n for n in FIXTURES if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]
    parts = list(dict.fromkeys(p for n in read for p in FIXTURES[n]))
    if not parts:
        return sql
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    lead = "WITH RECURSIVE " if head and head[1] else "WITH "
    return lead + ",".join(parts) + ("," + sql[head.end() :] if head else sql)


def told(name: str, covers: str, sql: str) -> None:
    TOLD[name] = (covers, with_fixtures(sql))


for _name in ("windows", "joins", "aggregates", "graph", "more"):
    import_module(f"{__name__}.{_name}")
