"""Further operators: folds, alignment, admission, safe attributes, figures."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from .. import fixtures as fx
from ..convert import convert
from ..operators import blocks, figures, folds
from ..render import mini
from ..sources.pdf import synthetic
from ..sources.pdf.reader import parse_table
from . import pdf
from .registry import query



@query(
    "J-12 F-61 D-60",
    f"""WITH {fx.LAYOUT} SELECT doc_id, page, seq FROM doc_fills
    UNION ALL SELECT i.doc_id, i.page, i.seq + 50 FROM doc_images i LEFT JOIN doc_fills f ON i.doc_id = f.doc_id AND i.page = f.page
    WHERE f.seq IS NULL OR greatest(0, least(f.x1, i.x1) - greatest(f.x0, i.x0)) * greatest(0, least(f.y1, i.y1) - greatest(f.y0, i.y0)) / least((f.x1 - f.x0) * (f.y1 - f.y0), (i.x1 - i.x0) * (i.y1 - i.y0)) < 0.5""",
)
def nms_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of each page that overlap none kept before them."""
    lines = fx.doc_lines(spark, sf_dir)
    boxes = fx.doc_fills(lines).select("doc_id", "page", "seq", "x0", "y0", "x1", "y1").unionByName(fx.doc_images(lines).select("doc_id", "page", (F.col("seq") + 50).alias("seq"), "x0", "y0", "x1", "y1"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        kept = folds.suppress(list(rows[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)), 0.5)
        return rows.iloc[kept][["doc_id", "page", "seq"]]

    return folds.by_page(boxes, ["doc_id", "page"], fold, "doc_id long, page long, seq long")


@query("W-02 W-04 D-23", None)
def position_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line starts of each page by running means, and lines in groups by seq and distance."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        clusters = folds.centroid_clusters(rows["x0"].tolist(), 20.0)
        groups = folds.contiguous_groups(list(zip(rows["seq"].tolist(), rows[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None), strict=True)))
        return pd.DataFrame({"doc_id": [rows["doc_id"].iloc[0]], "page": [rows["page"].iloc[0]], "clusters": [len(clusters)], "largest": [max(map(len, clusters))], "groups": [len(groups)]})

    return folds.by_page(fx.doc_lines(spark, sf_dir), ["doc_id", "page"], fold, "doc_id long, page long, clusters long, largest long, groups long")


@query(
    "J-17",
    """WITH RECURSIVE nodes AS (SELECT l_orderkey, l_linenumber, list(DISTINCT l_partkey % 6) AS keys FROM lineitem GROUP BY l_orderkey, l_linenumber),
    g AS (SELECT l_orderkey, list_distinct(flatten(list(keys))) AS rest, cast([] AS INTEGER[]) AS chosen FROM nodes GROUP BY l_orderkey
      UNION ALL SELECT l_orderkey, list_filter(rest, lambda x: NOT list_contains(keys, x)), list_append(chosen, cast(l_linenumber AS INTEGER)) FROM (
        SELECT g.l_orderkey, g.rest, g.chosen, n.keys, n.l_linenumber, row_number() OVER (PARTITION BY g.l_orderkey ORDER BY len(list_intersect(n.keys, g.rest)) DESC, n.l_linenumber) AS k FROM g JOIN nodes n ON g.l_orderkey = n.l_orderkey WHERE len(g.rest) > 0) x WHERE k = 1)
    SELECT l_orderkey, chosen FROM g WHERE len(rest) = 0""",
)
def set_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order that cover the parts of the order, greedily."""
    keys = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 6)).alias("keys"))
    orders = keys.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "keys"))).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for nodes in b.column(1).to_pylist():
                named = [(n["l_linenumber"], frozenset(n["keys"])) for n in nodes]
                out.append(folds.cover(frozenset().union(*(k for _, k in named)), named))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["l_orderkey", "chosen"])

    return orders.mapInArrow(run, "l_orderkey long, chosen array<int>")


@query("F-14", "SELECT n_nationkey, 'the ' || lower(n_name) || ' text' AS joined FROM nation")
def hyphen_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names broken over two lines by a soft hyphen, joined again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [blocks.join_lines([f"the {n.lower()[:3]}­", f"{n.lower()[3:]} text"]) for n in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["n_nationkey", "joined"])

    return fx.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInArrow(run, "n_nationkey int, joined string")


@query("S-15 S-14", "SELECT n_nationkey, n_name || ' inner ' || n_nationkey AS text FROM nation")
def pdf_form_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of forms that hold forms, one of them itself."""

    def make(name: str, key: int) -> bytes:
        first = 2 + len(synthetic.FACES) + 2 + 1
        fonts = b"/Font << /F1 3 0 R >>"
        inner = synthetic.text_op(200, 0, f"inner {key}") + b" /In Do"
        outer = b"/In Do " + synthetic.text_op(0, 0, name)
        form = lambda body, at: b"<< /Type /XObject /Subtype /Form /BBox [-10 -10 500 100] /Matrix [1 0 0 1 %d 0] /Resources << %s /XObject << /In %d 0 R >> >> /Length %d >>\nstream\n%s\nendstream" % (at, fonts, first + 1, len(body), body)
        data = synthetic.make_pdf([b"q 1 0 0 1 72 500 cm /Out Do Q"], extra=[form(outer, 0), form(inner, 0)])
        return data.replace(b"/Resources << /Font", b"/Resources << /XObject << /Out %d 0 R >> /Font" % first, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [make(n, k) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    files = fx.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInArrow(run, "path string, content binary")
    lines = parse_table(files, kinds=frozenset({"line"})).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda r: r["text"]), " ").alias("text"))
    return lines.select(F.col("path").cast("int").alias("n_nationkey"), "text")


@query("S-44 M-03", "SELECT doc_id, doc_id % 10 = 3 AS failed FROM documents")
def prediction_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions of which every tenth is given a file that is encrypted: it fails alone."""
    made = pdf._pdfs(fx.table(spark, sf_dir, "documents").select("doc_id", "text"))
    locked = F.encode(F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [] /Count 0 >>\nendobj\ntrailer\n<< /Root 1 0 R /Encrypt << /Filter /Standard >> >>\n"), "UTF-8")
    files = made.withColumn("content", F.when(F.col("path").cast("long") % 10 == 3, locked).otherwise(F.col("content")))
    return convert(files, outputs=frozenset()).select(F.col("path").cast("long").alias("doc_id"), F.col("error").isNotNull().alias("failed"))


@query("R-20 R-30", None)
def markdown_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as Markdown, to HTML."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [mini.to_html(mini.choose(f"# Turn {n}\n\n{t}\n\n- one\n    1. two", "", False, {"- one": "- [x] one"})) for n, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made)], ["conv_id", "turn", "html"])

    return fx.table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", "text").mapInArrow(run, "conv_id long, turn long, html string")


@query("D-60 D-61 D-62 D-63 D-24 F-67", None)
def vector_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagrams of a drawing made for each region and its nations."""
    regions = fx.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..sources.pdf.content import Interpreter
        from ..sources.pdf.document import Document

        for b in batches:
            out = []
            for key, names in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ops = []
                for k, n in enumerate(names):
                    ops += [synthetic.fill_op(80 + 90 * k, 600 - 20 * k, 80, 30, 0.8), synthetic.text_op(84 + 90 * k, 610 - 20 * k, n[:9], size=8)]
                    ops += [synthetic.rule_op(160 + 90 * k, 615 - 20 * k, 172 + 90 * k, 605 - 20 * k)] * (k + 1 < len(names))
                doc = Document(synthetic.make_pdf([b"\n".join([*ops, synthetic.text_op(72, 300, "text that stays")])]))
                rows = Interpreter(doc, doc.pages()[0]).run()
                found = figures.diagrams(rows.segments, rows.fills, rows.glyphs, (612, 792))
                out += [(key, f.name, f.alt, len(f.svg), json.dumps([round(v, 3) for v in f.box])) for f in found]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.string()) for c in cols[1:3]), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())], ["n_regionkey", "name", "alt", "svg_bytes", "bbox"])

    return regions.mapInArrow(run, "n_regionkey int, name string, alt string, svg_bytes long, bbox string")


@query("D-36 S-20", "SELECT DISTINCT cast(n_regionkey AS varchar) AS path, 'en' AS lang FROM nation")
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf._structured(spark, sf_dir, "metadata").select("path", F.get_json_object("attrs", "$.lang").alias("lang"))


@query("D-04 D-02", "SELECT n_regionkey, string_agg('left ' || lower(n_name) || ' has words', ' ' ORDER BY n_nationkey) || ' ' || string_agg('right ' || lower(n_name) || ' has words', ' ' ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def two_column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two columns, a line of either side on one baseline, read column by column."""
    regions = fx.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.lower("n_name").alias("name")))).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..convert import convert_bytes

        for b in batches:
            out = []
            for nations in b.column(1).to_pylist():
                ops = [synthetic.text_op(x, 720 - 14 * k, f"{side} {n['name']} has words", size=9) for k, n in enumerate(nations) for side, x in (("left", 60), ("right", 330))]
                nodes = convert_bytes(synthetic.make_pdf([b"\n".join(ops)]))["nodes"]
                out.append(" ".join(n["text"] for n in nodes))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["n_regionkey", "text"])

    return regions.mapInArrow(run, "n_regionkey int, text string")


@query("D-71 A-15", "SELECT n_nationkey, 'F' || (1 + n_nationkey % 2) AS font, cast(8 + n_nationkey % 5 AS DOUBLE) AS size, n_nationkey % 3 = 0 AS filled, CASE n_nationkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'center' ELSE 'right' END AS align FROM nation")
def widget_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the appearance streams of form widgets show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..sources.pdf.document import Document
        from ..sources.pdf.structure import widget_appearance

        for b in batches:
            out = []
            for k in b.column(0).to_pylist():
                back = b"0.9 g 0 0 100 20 re f" if k % 3 == 0 else b"0.9 g 10 5 20 5 re f"
                body = b"q %s Q BT 0 0 1 rg /F%d %d Tf (x) Tj ET" % (back, 1 + k % 2, 8 + k % 5)
                stream = b"<< /Type /XObject /Subtype /Form /BBox [0 0 100 20] /Length %d >>\nstream\n%s\nendstream" % (len(body), body)
                at = 2 + len(synthetic.FACES) + 2
                doc = Document(synthetic.make_pdf([b""], extra=[stream, b"<< /T (a) /FT /Tx /Q %d /DA (/Helv 99 Tf) /AP << /N %d 0 R >> >>" % (k % 3, at + 1)]))
                a = widget_appearance(doc, doc.get(at + 2))
                out.append((k, a["font"], a["size"], "background" in a, a["align"]))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4])], ["n_nationkey", "font", "size", "filled", "align"])

    return fx.table(spark, sf_dir, "nation").select("n_nationkey").mapInArrow(run, "n_nationkey int, font string, size double, filled boolean, align string")




@query("X-10 P-11 S-43", "SELECT n_nationkey, '   0    72.0    84.2 ' || n_name AS trace FROM nation")
def traced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's trace of a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ["\n".join(cli.trace(synthetic.make_pdf([synthetic.text_op(72, 700, n)]), 1)) for n in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["n_nationkey", "trace"])

    return fx.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInArrow(run, "n_nationkey int, trace string")
