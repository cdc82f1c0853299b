"""What is put out of documents, and what documents hold beside text: images, formulas, code, metadata, overlays, differences."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from .. import fixtures as fx
from ..convert import convert_bytes
from ..functions import bidi
from ..metrics import tables as metrics
from ..operators import blocks, figures
from ..render import html, mini, overlay
from ..sources.pdf import images, synthetic
from ..sources.pdf.content import Interpreter
from ..sources.pdf.document import Document
from ..sources.pdf.reader import read
from ..sources.pdf.structure import metadata
from .registry import query


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")


def _each(rows: DataFrame, schema: str, make) -> DataFrame:
    """A row for each row, of values that a function makes of its columns."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [make(*values) for values in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            cols = list(zip(*made, strict=True)) if made else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[s.split()[1]]) for c, s in zip(cols, schema.split(", "), strict=True)], names)

    return rows.mapInArrow(run, schema)


@query(
    "S-16 S-41",
    """SELECT n_nationkey, k.kind, CASE k.kind WHEN 'bits' THEN 13 ELSE 8 END AS width, 2 AS height,
      sha256(CASE k.kind WHEN 'gray' THEN rpad(n_name, 16, '.') WHEN 'packed' THEN rpad(n_name, 16, '-') WHEN 'rgb' THEN rpad(n_name, 48, '+') ELSE repeat(CASE WHEN n_nationkey % 2 = 0 THEN '1' ELSE '0' END, 26) END) AS samples
    FROM nation, (VALUES ('gray'), ('packed'), ('rgb'), ('bits')) k(kind)""",
)
def image_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of one byte and of one bit a sample, packed and not, out of a file as PNG and back to samples (of bits: 1 for white)."""

    def make(key: int, name: str) -> list[tuple]:
        gray, packed, colour = (name.ljust(n, c).encode() for n, c in ((16, "."), (16, "-"), (48, "+")))
        bits = (b"\xff\xff" if key % 2 == 0 else b"\x00\x00") * 2
        stream = lambda body, width, space, per, more=b"": b"<< /Type /XObject /Subtype /Image /Width %d /Height 2 /ColorSpace /%s /BitsPerComponent %d %s/Length %d >>\nstream\n%s\nendstream" % (width, space, per, more, len(body), body)
        made = [stream(gray, 8, b"DeviceGray", 8), stream(zlib.compress(packed), 8, b"DeviceGray", 8, b"/Filter /FlateDecode "), stream(colour, 8, b"DeviceRGB", 8), stream(bits, 13, b"DeviceGray", 1)]
        found = images.extract(Document(synthetic.make_pdf([b""], extra=made)))
        out = []
        for kind, row in zip(("gray", "packed", "rgb", "bits"), found, strict=True):
            width, height, _, raw = images.from_png(row["data"])
            if kind == "bits":
                raw = bytes(49 if v else 48 for v in raw)
            out.append((kind, width, height, hashlib.sha256(raw).hexdigest()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *r) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in make(k, n)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())], ["n_nationkey", "kind", "width", "height", "samples"])

    return _nations(spark, sf_dir).mapInArrow(run, "n_nationkey int, kind string, width int, height int, samples string")


@query(
    "D-24 F-62",
    "SELECT n_nationkey, '<math><mrow><msup><mi>x</mi><mn>' || n_nationkey % 10 || '</mn></msup><mo>+</mo><msub><mi>y</mi><mn>' || n_nationkey % 7 || '</mn></msub><mo>=</mo><mn>' || n_nationkey % 9 || '</mn></mrow></math>' AS mathml FROM nation",
)
def display_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula set with raised and lowered small digits, as MathML."""

    def make(key: int, name: str) -> tuple:
        at = [(72, 500, "x", 12), (79, 506, str(key % 10), 7), (92, 500, "+", 12), (104, 500, "y", 12), (111, 497, str(key % 7), 7), (124, 500, "=", 12), (136, 500, str(key % 9), 12)]
        doc = Document(synthetic.make_pdf([b"\n".join(synthetic.text_op(x, y, t, size=s) for x, y, t, s in at)]))
        return key, figures.math_ml(Interpreter(doc, doc.pages()[0]).run().glyphs)

    return _each(_nations(spark, sf_dir), "n_nationkey int, mathml string", make)


@query("D-63 W-04", "SELECT n_nationkey, 1 AS figures, cast(100 AS DOUBLE) AS x0, cast(100 + 40 * (3 + n_nationkey % 4) - 10 AS DOUBLE) AS x1, n_nationkey % 2 = 0 AS marked FROM nation WHERE n_nationkey % 2 = 0")
def formula_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of closed curves beside a sign of mathematics are a formula; without one they are none."""

    def make(key: int, name: str) -> tuple:
        shape = lambda x: b"%d 500 m %d 510 %d 510 %d 500 c %d 490 %d 490 %d 500 c %d 505 %d 505 %d 500 c h f" % (x, x + 5, x + 25, x + 30, x + 25, x + 5, x, x + 5, x + 25, x)
        ops = [shape(100 + 40 * k) for k in range(3 + key % 4)] + [synthetic.text_op(90, 512, "=" if key % 2 == 0 else "n", size=8)]
        doc = Document(synthetic.make_pdf([b"\n".join(ops)]))
        rows = Interpreter(doc, doc.pages()[0]).run()
        found = figures.formulas(rows.paths, rows.glyphs)
        box = found[0].box if found else (0.0, 0.0, 0.0, 0.0)
        return key, len(found), round(box[0], 3), round(box[2], 3), key % 2 == 0

    return _each(_nations(spark, sf_dir), "n_nationkey int, figures int, x0 double, x1 double, marked boolean", make).filter("figures > 0")


@query(
    "D-60 D-61 D-62",
    """WITH n AS (SELECT n_regionkey, substr(n_name, 1, 9) AS t, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS k, n_name FROM nation)
    SELECT n_regionkey, string_agg(t, ' · ' ORDER BY k DESC) AS alt, cast(80 AS DOUBLE) AS x0, cast(80 + 90 * max(k) + 80 AS DOUBLE) AS x1, 2 * count(*) - 1 AS shapes, count(*) AS texts FROM n GROUP BY n_regionkey""",
)
def vector_figure_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagram of each region's panels: its text from top to bottom, its box, and what its SVG draws."""
    regions = fx.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))

    def make(key: int, names: list[str]) -> tuple:
        ops = []
        for k, n in enumerate(names):
            ops += [synthetic.fill_op(80 + 90 * k, 500 + 20 * k, 80, 30, 0.8), synthetic.text_op(84 + 90 * k, 510 + 20 * k, n[:9], size=8)]
            ops += [synthetic.rule_op(160 + 90 * k, 515 + 20 * k, 172 + 90 * k, 525 + 20 * k)] * (k + 1 < len(names))
        doc = Document(synthetic.make_pdf([b"\n".join([*ops, synthetic.text_op(72, 300, "text that stays")])]))
        rows = Interpreter(doc, doc.pages()[0]).run()
        (f,) = figures.diagrams(rows.segments, rows.fills, rows.glyphs, (612, 792))
        drawn = f.svg.decode()
        return key, f.alt, round(f.box[0], 3), round(f.box[2], 3), drawn.count("<rect") + drawn.count("<line"), drawn.count("<text")

    return _each(regions, "n_regionkey int, alt string, x0 double, x1 double, shapes long, texts long", make)


@query("D-20 F-53", "SELECT n_nationkey, 'if ' || lower(n_name) || ':' || chr(10) || '    return ' || n_nationkey AS code FROM nation")
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of fixed pitch as one block, set in as they stand."""

    def make(key: int, name: str) -> tuple:
        ops = [synthetic.text_op(72, 700, "Some words stand before the code."), synthetic.text_op(72, 660, f"if {name.lower()}:", "F4", 10), synthetic.text_op(96, 648, f"return {key}", "F4", 10), synthetic.text_op(72, 600, "And some after it.")]
        return key, next(n["text"] for n in convert_bytes(synthetic.make_pdf([b"\n".join(ops)]))["nodes"] if n["kind"] == "code_block")

    return _each(_nations(spark, sf_dir), "n_nationkey int, code string", make)


@query("D-36 F-33", "SELECT n_nationkey, n_name AS title, 'writer ' || n_nationkey AS creator, CASE n_nationkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de-AT' END AS lang FROM nation")
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and creator (one in UTF-16), and language if there is one."""

    def make(key: int, name: str) -> tuple:
        wide = b"\xfe\xff" + name.encode("utf-16-be")
        info = b"<< /Title <%s> /Creator (writer %d) >>" % (wide.hex().encode(), key)
        lang = [b"/Lang (en) ", b"/Lang (de-AT) ", b""][key % 3]
        data = synthetic.make_pdf([b""], extra=[info], root=lang)
        at = 2 + len(synthetic.FACES) + 2 + 1
        found = metadata(Document(data.replace(b"/Root 1 0 R", b"/Root 1 0 R /Info %d 0 R" % at)))
        return key, found["title"], found["creator"], found["lang"]

    return _each(_nations(spark, sf_dir), "n_nationkey int, title string, creator string, lang string", make)


_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("R-12 F-50", f"WITH {fx.DOC_LINES} SELECT doc_id, string_agg('<p>' || {_ESCAPED} || '</p>', '' ORDER BY page, seq) AS html FROM doc_lines GROUP BY doc_id")
def minimal_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as nothing but an escaped paragraph."""
    lines = fx.doc_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "seq", "text"))).alias("lines"))
    return _each(lines, "doc_id long, html string", lambda key, rows: (key, html.minimal([{"kind": "paragraph", "text": r["text"], "children": []} for r in rows])))


@query(
    "S-43",
    f"""WITH {fx.DOC_LINES} SELECT doc_id, page, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 612.0 792.0">' || chr(10)
      || string_agg(printf('<rect x="%.1f" y="%.1f" width="%.1f" height="%.1f" fill="none" stroke="%s"><title>', x0, y0, x1 - x0, y1 - y0, CASE WHEN bold THEN '#1f77b4' ELSE '#7f7f7f' END) || {_ESCAPED} || '</title></rect>', chr(10) ORDER BY seq) || chr(10) || '</svg>' AS svg
    FROM doc_lines GROUP BY doc_id, page""",
)
def page_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's lines as boxes, coloured by what they are taken for."""
    boxes = fx.doc_lines(spark, sf_dir).withColumn("kind", F.when(F.col("bold"), "heading").otherwise("paragraph")).withColumnRenamed("text", "label")
    return overlay.page_overlays(boxes, fx.PAGE_WIDTH, fx.PAGE_HEIGHT)


@query(
    "U-05 X-10",
    f"""WITH {fx.DOC_LINES} SELECT doc_id, sum(CASE WHEN doc_id % 9 = 0 AND seq = 3 THEN 1 ELSE 0 END) AS removed, max(CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) AS added,
      sum(CASE WHEN doc_id % 9 = 0 AND seq = 3 THEN 1 ELSE 0 END) + max(CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) = 0 AS same FROM doc_lines GROUP BY doc_id""",
)
def text_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a document lost and won: a line a page of every ninth, one more at the end of every seventh."""
    lines = fx.doc_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "seq", "text"))).alias("lines"))

    def make(key: int, rows: list[dict]) -> tuple:
        one = [r["text"] for r in rows]
        other = [r["text"] for r in rows if not (key % 9 == 0 and r["seq"] == 3)] + ["no such line before"] * (key % 7 == 0)
        removed, added = metrics.line_changes(one, other)
        told = cli.changes("\n".join(one), "\n".join(other))
        return key, removed, added, not told

    return _each(lines, "doc_id long, removed long, added long, same boolean", make)


@query(
    "R-30",
    """SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN '# ' || n_name WHEN 1 THEN '# head' || chr(10) || '- [x] ' || n_name || chr(10) || 'end' WHEN 2 THEN '# head' || chr(10) || '- ' || n_name || chr(10) || 'end'
      WHEN 3 THEN '# head' || chr(10) || '- ' || n_name || chr(10) || '- ' || n_name || chr(10) || 'end' ELSE '# new' || chr(10) || '- [x] ' || n_name || chr(10) || 'end' END AS markdown FROM nation""",
)
def chosen_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagged document's own Markdown; else that of the layout with enriched blocks, all of them or, if one is missing or stands twice, none."""

    def make(key: int, name: str) -> tuple:
        layout = "\n".join(["# head", *[f"- {name}"] * (1 + (key % 5 == 3)), "end"])
        swaps = {1: {f"- {name}": f"- [x] {name}"}, 2: {f"- {name}": "x", "not there": "y"}, 3: {f"- {name}": "x"}, 4: {f"- {name}": f"- [x] {name}", "# head": "# new"}}
        return key, mini.choose(layout, f"# {name}", key % 5 == 0, swaps.get(key % 5, {}))

    return _each(_nations(spark, sf_dir), "n_nationkey int, markdown string", make)


@query("D-23", "SELECT o_custkey, count(*) >= 4 AND o_custkey % 3 <> 2 AS form FROM orders GROUP BY o_custkey")
def form_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a customer's orders: in one column, in two, or (every third) each at a place of its own, which is no form."""
    boxes = fx.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))

    def make(key: int, n: int) -> tuple:
        left = [72.0 + (key % 3 == 1) * 200 * (k % 5 == 4) + (key % 3 == 2) * 15 * k for k in range(n)]
        return key, figures.form_columns([(x, 20.0 * k, x + 90, 20.0 * k + 12) for k, x in enumerate(left)])

    return _each(boxes, "o_custkey long, form boolean", make)


@query(
    "D-04 D-01 W-13",
    """WITH n AS (SELECT n_regionkey, 'A head that goes over all of the columns of this page of region ' || n_regionkey AS head, string_agg('left ' || lower(n_name) || ' has words', ' ' ORDER BY n_nationkey) AS a, string_agg('middle ' || lower(n_name) || ' has words', ' ' ORDER BY n_nationkey) AS b,
      string_agg('right ' || lower(n_name) || ' has words', ' ' ORDER BY n_nationkey) AS c FROM nation GROUP BY n_regionkey)
    SELECT n_regionkey, head || ' ' || a || ' ' || b || ' ' || c AS text, 2 AS gutters FROM n""",
)
def three_column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of three columns under a line that goes over them, read column by column."""
    regions = fx.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.lower("n_name").alias("name")))).alias("n"))

    def make(key: int, nations: list[dict]) -> tuple:
        ops = [synthetic.text_op(60, 740, f"A head that goes over all of the columns of this page of region {key}", size=13)]
        ops += [synthetic.text_op(x, 700 - 14 * k, f"{side} {n['name']} has words", size=8) for k, n in enumerate(nations) for side, x in (("left", 60), ("middle", 230), ("right", 400))]
        data = synthetic.make_pdf([b"\n".join(ops)])
        lines = [r for r in read(data, kinds=frozenset({"line"})) if r["kind"] == "line"]
        return key, " ".join(n["text"] for n in convert_bytes(data)["nodes"]), len(blocks._columns(lines, 612.0))

    return _each(regions, "n_regionkey int, text string, gutters int", make)


@query("M-06 F-40", "SELECT n_nationkey, n_nationkey % 3 = 0 AS failed, CASE WHEN n_nationkey % 3 = 0 THEN 'levels' END AS what FROM nation")
def bidi_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the format of the character tests (code points; paragraph; base; levels; order), every third with a wrong level: just those fail."""

    def make(key: int, name: str) -> tuple:
        text = f"{name} ({key} אב) x"
        levels = [0] * (len(name) + 2) + [0] * len(str(key)) + [0] + [1, 1] + [0, 0, 0]
        order = [*range(len(name) + 3 + len(str(key))), len(text) - 4, len(text) - 5, len(text) - 3, len(text) - 2, len(text) - 1]
        if key % 3 == 0:
            levels[0] = 2
        line = ";".join((" ".join(f"{ord(c):04X}" for c in text), "0", "0", " ".join(map(str, levels)), " ".join(map(str, order))))
        (fault,) = bidi.check_lines(["# a comment", "", line]) or [None]
        return key, fault is not None, fault["what"] if fault else None

    return _each(_nations(spark, sf_dir), "n_nationkey int, failed boolean, what string", make)


@query(
    "D-40 J-01 J-02 J-15 J-16 P-17 S-20",
    """SELECT n_nationkey, k.place, k.kind, CASE k.place WHEN 0 THEN 'Title ' || n_name WHEN 1 THEN 'some words of ' || n_name || ' that go on in a second line' ELSE 'said by ' || n_name END AS text
    FROM nation, (VALUES (0, 'heading'), (1, 'paragraph'), (2, 'quote')) k(place, kind)""",
)
def tagged_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lines that look like one paragraph, tagged as a heading, a paragraph of two and a quote: the nodes follow the tags."""

    def make(key: int, name: str) -> list[tuple]:
        marked = [(b"H2", [f"Title {name}"]), (b"P", [f"some words of {name}", "that go on in a second line"]), (b"BlockQuote", [f"said by {name}"])]
        ops, k = [], 0
        for m, (role, texts) in enumerate(marked):
            for t in texts:
                ops.append(b"/%s <</MCID %d>> BDC " % (role, m) + synthetic.text_op(72, 500 - 12 * k, t, size=10) + b" EMC")
                k += 1
        base = 2 + len(synthetic.FACES) + 2
        elements = [b"<< /S /%s /P %d 0 R /Pg %d 0 R /K %d >>" % (role, base + 4, base, m) for m, (role, _) in enumerate(marked)]
        refs = b" ".join(b"%d 0 R" % (base + 1 + m) for m in range(3))
        tree = b"<< /Type /StructTreeRoot /K [%s] /ParentTree << /Nums [0 [%s]] >> >>" % (refs, refs)
        data = synthetic.make_pdf([b"\n".join(ops)], extra=[*elements, tree], root=b"/MarkInfo << /Marked true >> /StructTreeRoot %d 0 R " % (base + 4), page_attrs=b"/StructParents 0 ")
        return [(place, n["kind"], n["text"]) for place, n in enumerate(convert_bytes(data, outputs=frozenset())["nodes"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *r) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in make(k, n)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["n_nationkey", "place", "kind", "text"])

    return _nations(spark, sf_dir).mapInArrow(run, "n_nationkey int, place int, kind string, text string")


@query("S-02 S-04", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'first ' || n_name WHEN 1 THEN 'second ' || n_name ELSE 'third ' || n_name END AS text, 1 + n_nationkey % 3 AS revisions FROM nation")
def xref_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that were saved again with a new page text, once or twice: sections chained by /Prev, the newest entry of an object counts."""

    def make(key: int, name: str) -> tuple:
        content = lambda word: (lambda body: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body))(synthetic.text_op(72, 700, f"{word} {name}"))
        data = synthetic.make_pdf([synthetic.text_op(72, 700, f"first {name}")])
        at = 2 + len(synthetic.FACES) + 1
        for word in ("second", "third")[: key % 3]:
            before = int(data.rsplit(b"startxref", 1)[1].split()[0])
            place = len(data)
            data += b"%d 0 obj\n%s\nendobj\n" % (at, content(word))
            table_at = len(data)
            data += b"xref\n%d 1\n%010d 00000 n \ntrailer\n<< /Size %d /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (at, place, at + 2, before, table_at)
        lines = [r["text"] for r in read(data, kinds=frozenset({"line", "error"}))]
        return key, " ".join(lines), data.count(b"%%EOF")

    return _each(_nations(spark, sf_dir), "n_nationkey int, text string, revisions int", make)


def _tagged_pdf(lines: list[tuple[bytes, float, float]], elements: list[tuple[str, int | None, list[int]]]) -> bytes:
    """A page of marked texts (number by place) and a structure tree: role, place of the parent among the elements (none: the root), and marks."""
    base = 2 + len(synthetic.FACES) + 2
    number = lambda k: base + 1 + k
    root = number(len(elements))
    ops = [b"/Span <</MCID %d>> BDC " % m + synthetic.text_op(x, y, text.decode(), size=10) + b" EMC" for m, (text, x, y) in enumerate(lines)]
    bodies, owner = [], {}
    for k, (role, parent, marks) in enumerate(elements):
        kids = [b"%d 0 R" % number(j) for j, e in enumerate(elements) if e[1] == k] + [b"%d" % m for m in marks]
        owner.update(dict.fromkeys(marks, k))
        bodies.append(b"<< /S /%s /P %d 0 R /Pg %d 0 R /K [%s] >>" % (role.encode(), root if parent is None else number(parent), base, b" ".join(kids)))
    tops = b" ".join(b"%d 0 R" % number(k) for k, e in enumerate(elements) if e[1] is None)
    owned = b" ".join(b"%d 0 R" % number(owner[m]) for m in range(len(lines)))
    bodies.append(b"<< /Type /StructTreeRoot /K [%s] /ParentTree << /Nums [0 [%s]] >> >>" % (tops, owned))
    return synthetic.make_pdf([b"\n".join(ops)], extra=bodies, root=b"/MarkInfo << /Marked true >> /StructTreeRoot %d 0 R " % root, page_attrs=b"/StructParents 0 ")


@query(
    "D-41 J-18 A-16 D-32 D-10",
    """WITH n AS (SELECT n_regionkey, string_agg('- item ' || n_name, chr(10) ORDER BY n_nationkey) AS items, string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS cells FROM nation GROUP BY n_regionkey)
    SELECT n_regionkey, items || chr(10) || chr(10) || '| Name | Key |' || chr(10) || '| --- | --- |' || chr(10) || cells || chr(10) AS markdown FROM n""",
)
def tagged_lists_and_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without markers tagged as a list, and words set loosely tagged as a table with a header, put out as such."""
    regions = fx.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))

    def make(key: int, nations: list[dict]) -> tuple:
        lines: list[tuple[bytes, float, float]] = []
        elements: list[tuple[str, int | None, list[int]]] = [("L", None, [])]
        for k, n in enumerate(nations):
            elements += [("LI", 0, []), ("LBody", len(elements), [len(lines)])]
            lines.append((f"item {n['n_name']}".encode(), 72, 560 - 14 * k))
        table = len(elements)
        elements.append(("Table", None, []))
        for k, cells in enumerate([("Name", "Key"), *((n["n_name"], str(n["n_nationkey"])) for n in nations)]):
            row = len(elements)
            elements.append(("TR", table, []))
            for c, text in enumerate(cells):
                elements.append(("TH" if k == 0 else "TD", row, [len(lines)]))
                lines.append((text.encode(), 72 + 110 * c + 7 * (k % 2), 400 - 30 * k))
        return key, convert_bytes(_tagged_pdf(lines, elements), outputs=frozenset({"markdown"}))["markdown"]

    return _each(regions, "n_regionkey int, markdown string", make)


@query(
    "R-10 R-11 J-07 J-08",
    """WITH n AS (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
    SELECT n_regionkey, '<p>Seen in ' || string_agg('<a href="#reference-' || k || '">[' || k || ']</a>', ' and in ' ORDER BY k) || ' &amp; [99].</p>' AS html, count(*) AS targets FROM n GROUP BY n_regionkey""",
)
def html_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's page as HTML: the paragraph whose citations are links, and how many of them have an entry to lead to."""
    regions = fx.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))

    def make(key: int, nations: list[dict]) -> tuple:
        labels = [f"[{k}]" for k in range(1, len(nations) + 1)]
        ops = [synthetic.text_op(72, 600, f"Seen in {' and in '.join(labels)} & [99].", size=10), synthetic.text_op(72, 560, "References", "F2", 16)]
        ops += [synthetic.text_op(72, 530 - 22 * k, f"[{k + 1}] Smith, J. On {n['n_name']}. Some Press, {1990 + n['n_nationkey']}.", size=10) for k, n in enumerate(nations)]
        page = convert_bytes(synthetic.make_pdf([b"\n".join(ops)]), outputs=frozenset({"html"}))["html"]
        shown = next(x for x in page.split("\n") if x.startswith("<p>Seen"))
        return key, shown, sum(f'id="reference-{k}"' in page and f'href="#reference-{k}"' in page for k in range(1, len(nations) + 1))

    return _each(regions, "n_regionkey int, html string, targets long", make)
