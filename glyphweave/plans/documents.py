"""Queries that build, render and score documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..convert import Options, convert, convert_bytes, node_table
from ..functions import text as T
from ..metrics import tables as metrics
from ..render import html
from ..sources.pdf import synthetic
from . import pdf
from .registry import query


@query(
    "R-02 D-10 D-11 F-64 F-68",
    f"""WITH {fx.TABLE_ROWS}, r AS (SELECT table_id, row_idx, '| ' || flag || ' | ' || status || ' | ' || qty || ' |' AS line FROM table_rows)
    SELECT table_id, '| A | B | C |' || chr(10) || '| --- | --- | ---: |' || chr(10) || string_agg(line, chr(10) ORDER BY row_idx) AS markdown FROM r GROUP BY table_id""",
)
def gfm_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "flag", "status", "qty"), F.lit(" |"))
    rows = fx.table_rows(spark, sf_dir).select("table_id", F.struct("row_idx", line.alias("line")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n")
    return rows.groupBy("table_id").agg(F.concat(F.lit("| A | B | C |\n| --- | --- | ---: |\n"), body).alias("markdown"))


@query(
    "R-10 R-11 F-50",
    f"""WITH {fx.TABLE_ROWS}, r AS (SELECT table_id, row_idx, '<tr><td>' || flag || '</td><td>' || status || '</td><td>' || qty || '</td></tr>' AS line FROM table_rows)
    SELECT table_id, '<table><thead><tr><th scope="col">A</th><th scope="col">B</th><th scope="col">C</th></tr></thead><tbody>' || string_agg(line, '' ORDER BY row_idx) || '</tbody></table>' AS html FROM r GROUP BY table_id""",
)
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's table, as a node with a header row, put out by the HTML renderer."""
    rows = fx.table_rows(spark, sf_dir).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "flag", "status", "qty"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = lambda text: {"kind": "table_cell", "text": text, "attrs": {}, "children": []}
        for b in batches:
            made = []
            for order in b.column(1).to_pylist():
                grid = [tuple("ABC"), *((r["flag"], r["status"], r["qty"]) for r in order)]
                node = {"kind": "table", "text": "", "attrs": {"header_rows": 1}, "children": [{"kind": "table_row", "children": [cell(c) for c in line]} for line in grid]}
                made.append(html.block(node))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], ["table_id", "html"])

    return rows.mapInArrow(run, "table_id long, html string")


@query(
    "R-01 R-04 D-30 S-40",
    f"""WITH {fx.DOC_LINES}, b AS (SELECT doc_id, page * 40 + seq AS pos, CASE WHEN bold THEN '## ' || text WHEN mono THEN '- ' || text ELSE text END AS block FROM doc_lines WHERE NOT regexp_matches(text, '[`*~_\\[\\]<>\\\\]'))
    SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS markdown FROM b GROUP BY doc_id""".replace("\\\\", "\\\\"),
)
def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(fx.doc_lines(spark, sf_dir).filter(~F.col("text").rlike(r"[`*~_\[\]<>\\]")))


def _rendered(lines: DataFrame) -> DataFrame:
    block = F.when(F.col("bold"), F.concat(F.lit("## "), T.markdown_escaped(F.col("text")))).when(F.col("mono"), F.concat(F.lit("- "), T.markdown_escaped(F.col("text")))).otherwise(T.markdown_escaped(F.col("text")))
    rows = lines.select("doc_id", F.struct((F.col("page") * 40 + F.col("seq")).alias("pos"), block.alias("block")).alias("b"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n\n").alias("markdown"))


@query("R-01 R-04 D-30 S-40")
def render_markdown_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As render_markdown, over every line, those with characters to escape among them."""
    return _rendered(fx.doc_lines(spark, sf_dir))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each order's table, dealt over tasks of bounded size, and over all cores at least, before what Python makes of them."""
    size = 16 * fx.table(spark, sf_dir, "lineitem").count()
    lines = fx.order_lines(spark, sf_dir, max(4 * spark.sparkContext.defaultParallelism, size // pdf.TASK_BYTES + 1))
    row = F.struct("l_linenumber", "flag", "status", F.col("qty").cast("long").cast("string").alias("qty"))
    return lines.groupBy("table_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def _rows_of(lists: pa.ListArray) -> Iterator[list[tuple[str, str, str]]]:
    """Flag, status and quantity of each order's rows."""
    offsets = lists.offsets.to_pylist()
    _, *columns = (c.to_pylist() for c in lists.flatten().flatten())
    rows = list(zip(*columns, strict=True))
    for start, end in zip(offsets, offsets[1:], strict=False):
        yield rows[start - offsets[0] : end - offsets[0]]


def order_sheet(key: int, rows: list[tuple[str, str, str]]) -> bytes:
    ops = [synthetic.text_op(72, 730, f"Order {key}", "F2", 20), synthetic.text_op(72, 690, "The lines of this order are", size=10), synthetic.text_op(72, 678, "listed in the table below it.", size=10)]
    ops += [synthetic.text_op(72, 650, "- first point"), synthetic.text_op(72, 636, "- second point")]
    grid = [("Flag", "Status", "Qty"), *rows]
    top, low = 600, 600 - 20 * len(grid)
    ops += [synthetic.rule_op(72, top - 20 * k, 372, top - 20 * k) for k in range(len(grid) + 1)] + [synthetic.rule_op(72 + 100 * k, top, 72 + 100 * k, low) for k in range(4)]
    for r, cells in enumerate(grid):
        ops += [synthetic.text_op(76 + 100 * c, top - 15 - 20 * r, text, "F2" if r == 0 else "F1") for c, text in enumerate(cells)]
    return synthetic.make_pdf([b"\n".join(ops)])


@query(
    "D-09 D-10 D-11 D-32 J-03 R-01 R-02 X-01 X-02",
    f"""WITH {fx.TABLE_ROWS}, r AS (SELECT table_id, row_idx, '| ' || flag || ' | ' || status || ' | ' || qty || ' |' AS line FROM table_rows)
    SELECT table_id, '# Order ' || table_id || repeat(chr(10), 2) || 'The lines of this order are listed in the table below it.' || repeat(chr(10), 2) || '- first point' || chr(10) || '- second point' || repeat(chr(10), 2) || '| Flag | Status | Qty |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY row_idx) || chr(10) AS markdown FROM r GROUP BY table_id""",
)
def converted_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders set as PDFs (a heading, a paragraph, a list, and their lines as a ruled table with a bold header) and converted back, where they are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outputs = frozenset({"markdown"})
        for b in batches:
            made = [convert_bytes(order_sheet(k, rows), outputs=outputs, every=False)["markdown"] for k, rows in zip(b.column(0).to_pylist(), _rows_of(b.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], ["table_id", "markdown"])

    return _orders(spark, sf_dir).mapInArrow(run, "table_id long, markdown string")


@query("D-30 P-05 P-07 F-65 S-42", None)
def converted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of nodes of each document's PDF."""
    made = pdf._pdfs(fx.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return node_table(convert(made, options=Options(heading_levels="flat"), outputs=frozenset({"nodes"}))).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("confidence"))


def _tree(rows: list[dict], changed: bool = False) -> dict:
    out = []
    for r, row in enumerate(rows):
        cells = [{"kind": "table_cell", "text": row[c], "attrs": {"row": r, "col": k, "rowspan": 1, "colspan": 1 + (changed and r == 1 and k == 2), "role": "th" if r == 0 else "td"}, "children": []} for k, c in enumerate(("flag", "status", "qty"))]
        out.append({"kind": "table_row", "children": cells})
    return {"kind": "table", "attrs": {"header_rows": 1}, "children": out[:-1] if changed and len(out) > 3 else out}


@query(
    "M-01 M-02 F-07",
    f"""WITH {fx.TABLE_ROWS}, n AS (SELECT table_id, count(*) AS n, max(CASE WHEN row_idx = 1 THEN length(qty) END) AS w FROM table_rows GROUP BY table_id)
    SELECT table_id, cast(1 AS DOUBLE) AS self_teds, round(CASE WHEN n = 1 THEN 1.0 ELSE 1.0 - (CASE WHEN n > 3 THEN 4.0 ELSE 0.0 END + 1.0 / cast(6 + w AS DOUBLE)) / cast(1 + 4 * n AS DOUBLE) END, 9) AS teds,
      cast(CASE WHEN n = 1 THEN 1 ELSE 0 END AS DOUBLE) AS cell_exact, cast(CASE WHEN n = 1 THEN 1 ELSE 0 END AS DOUBLE) AS span_exact FROM n""",
)
def table_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree similarity, cells and spans of each order's table against itself and against a changed one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.column(1).to_pylist():
                tree = _tree(r)
                out.append((metrics.teds(tree, _tree(r)), metrics.score(tree, _tree(r, True))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s for s, _ in out]), pa.array([m["teds"] for _, m in out]), pa.array([m["cell_exact"] for _, m in out]), pa.array([m["span_exact"] for _, m in out])],
                ["table_id", "self_teds", "teds", "cell_exact", "span_exact"],
            )

    return _orders(spark, sf_dir).mapInArrow(run, "table_id long, self_teds double, teds double, cell_exact double, span_exact double").withColumn("teds", F.round("teds", 9))


def _customers_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("orders"))


@query(
    "D-12 D-13 D-10 P-16 A-08 W-18",
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderstatus, o_orderpriority) AS k FROM orders)
    SELECT o_custkey, CASE WHEN o_custkey % 5 <> 0 AND count(*) >= 2 THEN 'aligned_columns' END AS model, CASE WHEN o_custkey % 5 <> 0 AND count(*) >= 2 THEN count(*) + 1 ELSE 0 END AS n_rows,
      CASE WHEN o_custkey % 5 <> 0 AND count(*) >= 2 THEN 'Order|Status|Priority;' || string_agg(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority, ';' ORDER BY k) ELSE '' END AS cells FROM o GROUP BY o_custkey""",
)
def borderless_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders set in columns without rules under a bold row; every fifth customer's as two columns of sentences, which are no table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, orders in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(str(r["o_orderkey"]), r["o_orderstatus"], r["o_orderpriority"]) for r in orders]
                step = min(13.0, 680 / (len(rows) + 1))
                if key % 5 == 0:
                    ops = [synthetic.text_op(x, 740 - step * k, f"The order {r[0]} was sent on its way.", size=0.6 * step) for k, r in enumerate(rows) for x in (60, 320)]
                else:
                    grid = [("Order", "Status", "Priority"), *rows]
                    ops = [synthetic.text_op(72 + 130 * c, 740 - step * k, text, "F2" if k == 0 else "F1", 0.7 * step) for k, row in enumerate(grid) for c, text in enumerate(row)]
                nodes = convert_bytes(synthetic.make_pdf([b"\n".join(ops)]))["nodes"]
                tables = [n for n in nodes if n["kind"] == "table"]
                lines: dict[int, list[str]] = {n["node"]: [] for n in nodes if n["kind"] == "table_row"}
                for n in nodes:
                    if n["kind"] == "table_cell":
                        lines[n["parent"]].append(n["text"])
                out.append((key, tables[0]["evidence"][0] if tables else None, sum(t["attrs"]["row_count"] for t in tables), ";".join("|".join(x) for x in lines.values())))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["o_custkey", "model", "n_rows", "cells"])

    return pdf._spread(_customers_orders(spark, sf_dir), 32 * F.size("orders")).mapInArrow(run, "o_custkey long, model string, n_rows long, cells string")


@query(
    "D-50 F-08 F-09 J-08 W-06",
    """SELECT n_regionkey, cast(row_number() OVER w AS varchar) AS label, 'Smith, J. On ' || n_name || '. Some Press, ' || (1990 + n_nationkey) || '.' AS text, 'reference-' || row_number() OVER w AS cited FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)""",
)
def reference_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each region that cites its nations, listed under a heading: entries, and what the citation of each leads to."""
    regions = fx.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, nations in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ops = [synthetic.text_op(72, 740, "Work", "F2", 16), synthetic.text_op(72, 715, f"All of it was shown before [{', '.join(str(k) for k in range(1, len(nations) + 1))}] and by others [99].", size=10)]
                ops += [synthetic.text_op(72, 660, "References", "F2", 16)]
                ops += [synthetic.text_op(72, 630 - 22 * k, f"[{k + 1}] Smith, J. On {n['n_name']}. Some Press, {1990 + n['n_nationkey']}.", size=10) for k, n in enumerate(nations)]
                nodes = convert_bytes(synthetic.make_pdf([b"\n".join(ops)]))["nodes"]
                cited = [x["target"] for n in nodes for x in n["attrs"].get("links", [])]
                out += [(key, n["attrs"]["label"], n["text"], cited[k]) for k, n in enumerate(x for x in nodes if x["kind"] == "reference")]
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.string()) for c in cols[1:])], ["n_regionkey", "label", "text", "cited"])

    return regions.mapInArrow(run, "n_regionkey int, label string, text string, cited string")


@query(
    "D-51 F-10 J-05 W-10",
    """SELECT n_regionkey, n_name AS title, cast(row_number() OVER w + 1 AS varchar) AS page_label, regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') AS target FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)""",
)
def visible_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each region with a page of contents and a page for each nation: entries, and the heading that each leads to."""
    regions = fx.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body = "The body of the page is set in ten points and goes on"
        for b in batches:
            out = []
            for key, nations in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names = [n["n_name"] for n in nations]
                first = [synthetic.text_op(72, 740, "Contents", "F2", 14)] + [synthetic.text_op(72, 710 - 25 * k, f"{name} {'.' * (8 + k)} {k + 2}") for k, name in enumerate(names)]
                rest = [[synthetic.text_op(72, 600, name, "F2", 16)] + [synthetic.text_op(72, 560 - 13 * j, f"{body} {k}", size=10) for j in range(3)] for k, name in enumerate(names)]
                nodes = convert_bytes(synthetic.make_pdf([b"\n".join(ops) for ops in (first, *rest)]))["nodes"]
                out += [(key, n["text"], n["attrs"]["page_label"], n["attrs"]["target"]) for n in nodes if n["kind"] == "toc_item"]
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.string()) for c in cols[1:])], ["n_regionkey", "title", "page_label", "target"])

    return regions.mapInArrow(run, "n_regionkey int, title string, page_label string, target string")


@query(
    "M-04",
    r"""WITH e AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS a FROM benchmark WHERE text IS NOT NULL), p AS (SELECT item_id, a, trim(substr(a, 1, length(a) // 3) || substr(a, length(a) // 2 + 1)) AS b FROM e)
    SELECT item_id, cast(1 AS DOUBLE) AS same, round(2.0 * length(trim(regexp_replace(b, ' +', ' ', 'g'))) / cast(length(a) + length(trim(regexp_replace(b, ' +', ' ', 'g'))) AS DOUBLE), 9) AS nid FROM p""",
)
def reading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike a passage is to itself, and to a reading that lost a piece of its middle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [" ".join(t.split()) for t in b.column(1).to_pylist()]
            cut = [t[: len(t) // 3] + t[len(t) // 2 :] for t in texts]
            same = [metrics.normalised_distance(t, t) for t in texts]
            nid = [metrics.normalised_distance(t, c) for t, c in zip(texts, cut, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.float64()), pa.array(nid, pa.float64())], ["item_id", "same", "nid"])

    return fx.table(spark, sf_dir, "benchmark").filter("text IS NOT NULL").select("item_id", "text").mapInArrow(run, "item_id long, same double, nid double").withColumn("nid", F.round("nid", 9))


@query("M-04", "SELECT n_regionkey, round(1 - 2.0 / cast(1 + 2 * count(*) AS DOUBLE), 9) AS mhs, round(1 - 2.0 / cast(1 + 2 * count(*) AS DOUBLE), 9) AS mhs_s, cast(1 AS DOUBLE) AS renamed_s FROM nation GROUP BY n_regionkey")
def heading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of each region's nations against a reading that lost the last, with and without words, and one with other words."""
    regions = fx.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, names in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                whole, short, other = ("".join(f"# {n}\n\n{word} {n}\n\n" for n in part) for word, part in (("of", names), ("of", names[:-1]), ("about", names)))
                out.append((key, metrics.heading_similarity(whole, short), metrics.heading_similarity(whole, short, True), metrics.heading_similarity(whole, other, True)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.float64()) for c in cols[1:])], ["n_regionkey", "mhs", "mhs_s", "renamed_s"])

    scored = regions.mapInArrow(run, "n_regionkey int, mhs double, mhs_s double, renamed_s double")
    return scored.select("n_regionkey", *[F.round(c, 9).alias(c) for c in ("mhs", "mhs_s", "renamed_s")])


@query("F-52 D-35 R-02", "SELECT p_partkey, p_partkey % 5 < 2 AS safe FROM part")
def html_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments by rule: two sound ones, then one with a script, one badly nested and one with a stray attribute."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                good = html.table(_tree([{"flag": name, "status": "<&>", "qty": str(k)}] * 2))
                out.append(html.is_safe([good, f"<p><strong>{k}</strong> x</p>", good + "<script>x</script>", "<table><tr><td>a</table></td></tr>", f'<p onclick="x">{k}</p>'][k % 5]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["p_partkey", "safe"])

    return fx.table(spark, sf_dir, "part").select("p_partkey", "p_name").mapInArrow(run, "p_partkey long, safe boolean")


@query("F-06 M-03 U-05", None)
def character_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns against the turn before: exact and by characters in matching blocks."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    pairs = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before")).filter("before IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [metrics.character_accuracy(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], ["conv_id", "turn", "accuracy"])

    return pairs.mapInArrow(run, "conv_id long, turn long, accuracy double")


