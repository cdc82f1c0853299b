"""Document-shaped views over the driver tables, in Spark and, for comparison, in DuckDB SQL.

All geometry is integer-valued, so sums, medians and boxes are exact in either engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_WIDTH = 612.0
PAGE_HEIGHT = 792.0
LINES_PER_PAGE = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout lines of `documents`, LINES_PER_PAGE a page; lines without text are left out (they keep their place)."""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    t = raw.select("doc_id", F.col("pos").cast("long").alias("i"), F.trim("raw").alias("text")).filter(F.length("text") > 0)
    return t.selectExpr(
        "doc_id",
        f"i div {LINES_PER_PAGE} + 1 as page",
        f"i % {LINES_PER_PAGE} as seq",
        "text",
        "cast(72 + 18 * ((doc_id * 7 + i * 3) % 5) as double) as x0",
        f"cast(54 + 17 * (i % {LINES_PER_PAGE}) as double) as y0",
        "cast(72 + 18 * ((doc_id * 7 + i * 3) % 5) + 5 * least(length(text), 60) as double) as x1",
        f"cast(54 + 17 * (i % {LINES_PER_PAGE}) + 9 + (doc_id + i) % 4 as double) as y1",
        "cast(9 + (doc_id + i) % 4 as double) as size",
        "(doc_id + i) % 11 = 0 as bold",
        "(doc_id + i) % 13 = 0 as mono",
    )


DOC_LINES = """
fx_raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
fx_trim AS (SELECT doc_id, cast(i AS BIGINT) AS i, trim(raw) AS txt FROM fx_raw),
doc_lines AS (
  SELECT doc_id, cast(i // 40 + 1 AS BIGINT) AS page, cast(i % 40 AS BIGINT) AS seq, txt AS text,
    cast(72 + 18 * ((doc_id * 7 + i * 3) % 5) AS DOUBLE) AS x0, cast(54 + 17 * (i % 40) AS DOUBLE) AS y0,
    cast(72 + 18 * ((doc_id * 7 + i * 3) % 5) + 5 * least(length(txt), 60) AS DOUBLE) AS x1,
    cast(54 + 17 * (i % 40) + 9 + (doc_id + i) % 4 AS DOUBLE) AS y1,
    cast(9 + (doc_id + i) % 4 AS DOUBLE) AS size, (doc_id + i) % 11 = 0 AS bold, (doc_id + i) % 13 = 0 AS mono
  FROM fx_trim WHERE length(txt) > 0)
"""


def doc_pages(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "page").distinct()


DOC_PAGES = "doc_pages AS (SELECT DISTINCT doc_id, page FROM doc_lines)"

# Rules, boxes and pictures that stand on the pages by rule: the same expressions serve both engines.
_SEGMENTS = """
SELECT doc_id, page, cast(0 AS BIGINT) AS seq, cast(306 AS DOUBLE) AS x0, cast(60 AS DOUBLE) AS y0, cast(306 AS DOUBLE) AS x1, cast(220 + 40 * (doc_id % 8) AS DOUBLE) AS y1, cast(1 AS DOUBLE) AS width FROM doc_pages WHERE (doc_id + page) % 3 = 0
UNION ALL SELECT doc_id, page, cast(1 AS BIGINT), cast(290 AS DOUBLE), cast(100 AS DOUBLE), cast(290 AS DOUBLE), cast(150 + 60 * (doc_id % 5) AS DOUBLE), cast(1 AS DOUBLE) FROM doc_pages WHERE (doc_id + page) % 4 = 0
UNION ALL SELECT doc_id, page, cast(2 AS BIGINT), cast(60 AS DOUBLE), cast(54 AS DOUBLE), cast(60 AS DOUBLE), cast(120 + 50 * (doc_id % 9) AS DOUBLE), cast(2 AS DOUBLE) FROM doc_pages WHERE (doc_id + page) % 5 = 0
UNION ALL SELECT doc_id, page, cast(3 AS BIGINT), cast(72 AS DOUBLE), cast(530 + 10 * (doc_id % 7) AS DOUBLE), cast(100 + 60 * (doc_id % 6) AS DOUBLE), cast(530 + 10 * (doc_id % 7) AS DOUBLE), cast(1 AS DOUBLE) FROM doc_pages WHERE doc_id % 2 = 0
"""
_FILLS = """
SELECT doc_id, page, cast(0 AS BIGINT) AS seq, cast(60 AS DOUBLE) AS x0, cast(50 + 17 * (doc_id % 20) AS DOUBLE) AS y0, cast(400 + 50 * (doc_id % 6) AS DOUBLE) AS x1, cast(50 + 17 * (doc_id % 20) + 20 * (1 + page % 4) AS DOUBLE) AS y1,
  cast(8 AS DOUBLE) / 10 AS r, cast(8 + doc_id % 3 AS DOUBLE) / 10 AS g, cast(9 AS DOUBLE) / 10 AS b FROM doc_pages WHERE (doc_id * 3 + page) % 4 <> 1
"""
_IMAGES = """
SELECT doc_id, page, cast(0 AS BIGINT) AS seq, cast(100 + 10 * (doc_id % 9) AS DOUBLE) AS x0, cast(90 + 20 * (page % 11) AS DOUBLE) AS y0, cast(300 + 10 * (doc_id % 9) AS DOUBLE) AS x1, cast(240 + 20 * (page % 11) AS DOUBLE) AS y1,
  CASE WHEN doc_id % 2 = 0 THEN 'Im1' ELSE 'Im2' END AS name FROM doc_pages WHERE (doc_id + page) % 7 = 0
"""
DOC_SEGMENTS, DOC_FILLS, DOC_IMAGES = f"doc_segments AS ({_SEGMENTS})", f"doc_fills AS ({_FILLS})", f"doc_images AS ({_IMAGES})"
LAYOUT = ",".join((DOC_LINES, DOC_PAGES, DOC_SEGMENTS, DOC_FILLS, DOC_IMAGES))


def _of_pages(lines: DataFrame, sql: str) -> DataFrame:
    pages = doc_pages(lines)
    return lines.sparkSession.sql(sql.replace("doc_pages", "{doc_pages}"), doc_pages=pages)


def doc_segments(lines: DataFrame) -> DataFrame:
    return _of_pages(lines, _SEGMENTS)


def doc_fills(lines: DataFrame) -> DataFrame:
    return _of_pages(lines, _FILLS)


def doc_images(lines: DataFrame) -> DataFrame:
    return _of_pages(lines, _IMAGES)


# Ruled tables, one an order; rows of one line number are collapsed first, for they repeat in the data.
TABLE_ROWS = """
table_rows AS (
  SELECT l_orderkey AS table_id, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS BIGINT) AS row_idx,
    flag, status, cast(cast(qty AS BIGINT) AS varchar(20)) AS qty
  FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, min(l_linestatus) AS status, min(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey, l_linenumber) li)
"""
TABLE_CELLS = """
table_cells AS (
  SELECT table_id, row_idx, c.col, CASE c.col WHEN 0 THEN flag WHEN 1 THEN status ELSE qty END AS txt,
    cast(72 + 100 * c.col AS DOUBLE) AS x0, cast(100 + 20 * row_idx AS DOUBLE) AS y0, cast(172 + 100 * c.col AS DOUBLE) AS x1, cast(120 + 20 * row_idx AS DOUBLE) AS y1
  FROM table_rows r CROSS JOIN (VALUES (cast(0 AS BIGINT)), (cast(1 AS BIGINT)), (cast(2 AS BIGINT))) c(col))
"""
NODE_TREE = """
node_tree AS (
  SELECT 'r' || cast(r_regionkey AS varchar(10)) AS node_id, cast(NULL AS varchar(10)) AS parent_id, cast(r_regionkey AS BIGINT) AS ordinal, 'section' AS kind, r_name AS text FROM region
  UNION ALL SELECT 'n' || cast(n_nationkey AS varchar(10)), 'r' || cast(n_regionkey AS varchar(10)), cast(n_nationkey AS BIGINT), 'heading', n_name FROM nation
  UNION ALL SELECT 'c' || cast(c_custkey AS varchar(20)), 'n' || cast(c_nationkey AS varchar(10)), cast(c_custkey AS BIGINT), 'paragraph', c_name FROM customer)
"""


def order_lines(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Lines of orders, those of one number collapsed. `parts`: so many tasks, of whole orders, dealt out before anything else; then nothing has to be dealt again."""
    lines = table(spark, sf_dir, "lineitem")
    if parts:
        lines = lines.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity").repartition(parts, "l_orderkey")
    return lines.groupBy(F.col("l_orderkey").alias("table_id"), "l_linenumber").agg(
        F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"), F.min("l_quantity").alias("qty")
    )


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("table_id").orderBy("l_linenumber")
    return order_lines(spark, sf_dir).select("table_id", (F.row_number().over(w) - 1).cast("long").alias("row_idx"), "flag", "status", F.col("qty").cast("long").cast("string").alias("qty"))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cells a row, 100 wide and 20 high, from (72, 100)."""
    rows = table_rows(spark, sf_dir)
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("col"), F.col(c).alias("txt")) for i, c in enumerate(("flag", "status", "qty"))])
    return rows.select("table_id", "row_idx", F.inline(cells)).select(
        "table_id",
        "row_idx",
        "col",
        "txt",
        (72 + 100 * F.col("col")).cast("double").alias("x0"),
        (100 + 20 * F.col("row_idx")).cast("double").alias("y0"),
        (172 + 100 * F.col("col")).cast("double").alias("x1"),
        (120 + 20 * F.col("row_idx")).cast("double").alias("y1"),
    )


def node_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation and customer as a tree of semantic nodes in adjacency form."""

    def level(name: str, mark: str, key: str, parent, kind: str, text: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(mark), F.col(key).cast("string")).alias("node_id"), parent.alias("parent_id"), F.col(key).cast("long").alias("ordinal"), F.lit(kind).alias("kind"), F.col(text).alias("text")
        )

    up = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string"))
    return (
        level("region", "r", "r_regionkey", F.lit(None).cast("string"), "section", "r_name")
        .unionByName(level("nation", "n", "n_nationkey", up("r", "n_regionkey"), "heading", "n_name"))
        .unionByName(level("customer", "c", "c_custkey", up("n", "c_nationkey"), "paragraph", "c_name"))
    )
