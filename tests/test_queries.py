"""Every registered query of the document engine against its SQL on the smallest tables."""

from __future__ import annotations

import decimal

import duckdb
import pytest

from glyphweave import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"pdf_roundtrip", "pdf_rows", "converted_nodes", "converted_sheets", "table_scores"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - SLOW))
def test_query(spark, duck, name):
    from glyphweave.ship import ship

    ship(spark)
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry(spark):
    assert plans.flagship(spark, SF).count() > 0


def test_nothing_depends_on_the_training_subpackage():
    import ast
    from pathlib import Path

    import glyphweave

    root = Path(glyphweave.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [f"{node.module or ''}.{a.name}" for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_queries_without_the_training_subpackage(monkeypatch):
    import sys

    import __spark_entry__ as entry

    whole = set(entry.queries())
    monkeypatch.setitem(sys.modules, "glyphweave.llm.registry", None)
    assert set(entry.queries()) == set(plans.queries()) <= whole
    assert set(entry.oracle_sql()) <= set(entry.queries())
