"""Queries over PDFs that are made from driver tables and read back."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import table
from ..sources.pdf import filters, synthetic
from ..sources.pdf.content import tokens
from ..sources.pdf.fonts import parse_cmap
from ..sources.pdf.reader import parse_table, read
from .registry import query


#: Bytes of text or rows that a task makes PDFs of, or parses.
TASK_BYTES = 4 << 20


def _spread(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """Documents dealt evenly over tasks of bounded size, and over all cores at least: what is dealt out is text or keys, before it grows to PDFs."""
    total = docs.agg(F.sum(size)).first()[0] if size is not None else None
    return docs.repartition(max(4 * docs.sparkSession.sparkContext.defaultParallelism, (total or 0) // TASK_BYTES + 1))


def _pdfs(docs: DataFrame) -> DataFrame:
    """A PDF of each document's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [synthetic.text_pdf(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["path", "content"])

    return _spread(docs, F.octet_length("text")).select(F.col("doc_id").cast("string").alias("path"), "text").mapInArrow(run, "path string, content binary")


@query("S-01 S-03 S-04 S-05 S-13 S-14 S-30 F-15 F-20 F-21 F-30 O-02 X-01", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL")
def pdf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                rows = read(synthetic.text_pdf(text), kinds=frozenset({"line", "error"}))
                out.append(" ".join(" ".join(r["text"] for r in rows).split()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return _spread(docs, F.octet_length("text")).mapInArrow(run, "doc_id long, text string")


@query("S-01 S-06 S-14 P-11", None)
def pdf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of rows of each document's PDF, its first two pages and those from the ninth."""
    rows = parse_table(_pdfs(table(spark, sf_dir, "documents").select("doc_id", "text")), pages="1-2,9-", columns=("path", "page", "kind", "x0", "x1"))
    return rows.groupBy("path", "page", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query(
    "F-20 F-21 F-22 F-23 F-24 F-25 S-03",
    "SELECT page_id, codec, sha256(html) AS digest FROM pages CROSS JOIN (SELECT unnest(['ASCII85Decode', 'ASCIIHexDecode', 'FlateDecode', 'LZWDecode', 'RunLengthDecode', 'png_up']) AS codec) c WHERE html IS NOT NULL",
)
def filter_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, codecs, digests = [], [], []
            for i, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = html.encode()
                for name, (packed, names, parms) in packings(data).items():
                    back, warnings = filters.decode(packed, names, parms)
                    ids.append(i)
                    codecs.append(name)
                    digests.append(hashlib.sha256(back[: len(data)]).hexdigest() if not warnings else "; ".join(warnings))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codecs), pa.array(digests)], ["page_id", "codec", "digest"])

    return _spread(table(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", "html"), F.octet_length("html")).mapInArrow(run, "page_id long, codec string, digest string")


def packings(data: bytes) -> dict[str, tuple[bytes, list[str], list[dict]]]:
    """Data under every filter: packed bytes, filter names and parameters."""
    import base64
    import zlib

    runs = b"".join(bytes([len(data[k : k + 128]) - 1]) + data[k : k + 128] for k in range(0, len(data), 128)) + b"\x80"
    width = 64
    padded = data + bytes(-len(data) % width)
    rows = [padded[k : k + width] for k in range(0, len(padded), width)]
    above = [bytes(width), *rows][: len(rows)]
    up = b"".join(b"\x02" + bytes((x - u) & 255 for x, u in zip(r, a, strict=True)) for r, a in zip(rows, above, strict=True))
    return {
        "ASCII85Decode": (base64.a85encode(data) + b"~>", ["ASCII85Decode"], []),
        "ASCIIHexDecode": (data.hex().encode() + b">", ["ASCIIHexDecode"], []),
        "FlateDecode": (zlib.compress(data), ["Fl"], []),
        "LZWDecode": (lzw_encode(data), ["LZWDecode"], []),
        "RunLengthDecode": (runs, ["RL"], []),
        "png_up": (zlib.compress(up), ["FlateDecode"], [{"Predictor": 12, "Columns": width}]),
    }


def lzw_encode(data: bytes) -> bytes:
    """LZW as filters.lzw reads it."""
    out, held, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
            held &= (1 << bits) - 1

    put(256)
    last = b""
    for k in range(len(data)):
        c = data[k : k + 1]
        if last + c in table or not last:
            last += c
            continue
        put(table[last] if len(last) > 1 else last[0])
        table[last + c] = 258 + len(table)
        size = 258 + len(table)
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            put(256)
            table, width = {}, 9
        last = c
    if last:
        put(table[last] if len(last) > 1 else last[0])
        size = 258 + len(table) + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


@query("S-13", "SELECT p_partkey, cast(7 AS BIGINT) AS n_operators, p_name AS text FROM part")
def pdf_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, texts = [], []
            for name in b.column(1).to_pylist():
                found = list(tokens(synthetic.text_op(10, 20, name) + b"\nBI /W 2 /H 2 /BPC 8 /CS /G ID \x00EI\xff EI Q"))
                counts.append(len(found) - 1)
                texts.append(next(a[0] for op, a in found if op == "Tj").decode("cp1252"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(texts)], ["p_partkey", "n_operators", "text"])

    return table(spark, sf_dir, "part").select("p_partkey", "p_name").mapInArrow(run, "p_partkey long, n_operators long, text string")


@query("F-31 F-30 F-32 F-33 F-42", "SELECT n_nationkey, n_name AS text, length(n_name) AS n_codes FROM nation")
def cmap_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names coded by a ToUnicode map: two-byte codes, runs as ranges, the rest one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for name in b.column(1).to_pylist():
                chars = sorted(set(name))
                code = {c: 0x100 + k for k, c in enumerate(chars)}
                single = b"\n".join(b"<%04X> <%04X>" % (code[c], ord(c)) for c in chars[::2])
                ranged = b"\n".join(b"<%04X> <%04X> [<%04X>]" % (code[c], code[c], ord(c)) for c in chars[1::2])
                cmap = parse_cmap(b"1 begincodespacerange <0000> <FFFF> endcodespacerange %d beginbfchar %s endbfchar %d beginbfrange %s endbfrange" % (len(chars), single, len(chars), ranged))
                codes = cmap.split(b"".join(code[c].to_bytes(2, "big") for c in name), 1)
                texts.append("".join(cmap.texts.get(x, "?") for x in codes))
                counts.append(len(codes))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts), pa.array(counts, pa.int64())], ["n_nationkey", "text", "n_codes"])

    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInArrow(run, "n_nationkey int, text string, n_codes long")


def _structured_pdf(nations: list[tuple[int, str, int]]) -> bytes:
    """A PDF with a page, an outline entry, a form field, a link and a tagged paragraph for each nation."""
    pages = [b"/P <</MCID 0>> BDC " + synthetic.text_op(72, 700, name) + b" EMC" for _, name, _ in nations]
    base = 2 + len(synthetic.FACES) + 2 * len(nations)
    page = {k: 2 + len(synthetic.FACES) + 2 * (k + 1) for k in range(len(nations))}
    n = len(nations)
    entry, fld, elem, link = (lambda k, s=s: base + s * n + k + 1 for s in range(4))
    extra: list[bytes] = []
    for k, (_, name, _) in enumerate(nations):
        nxt = b"/Next %d 0 R " % entry(k + 1) if k + 1 < n else b""
        extra.append(b"<< /Title (%s) /Parent 1 0 R %s/Dest [%d 0 R /XYZ 0 %d 0] >>" % (name.encode(), nxt, page[k], 700 - k))
    for k, (key, name, region) in enumerate(nations):
        kind, flags = (b"/Tx", 1 << 13 if key % 4 == 0 else 2) if key % 3 else (b"/Btn", 1 << 15)
        extra.append(b"<< /T (n%d) /TU (%s) /FT %s /Ff %d /V (v%d) /P %d 0 R /Subtype /Widget >>" % (key, name.encode(), kind, flags, region, page[k]))
    for k in range(n):
        extra.append(b"<< /S /Par%d /P %d 0 R /Pg %d 0 R /K 0 /Lang (en) >>" % (k % 2, base + 4 * n + 1, page[k]))
    for k, (key, _, _) in enumerate(nations):
        extra.append(b"<< /Type /Annot /Subtype /Link /Rect [72 690 200 712] /A << /S /URI /URI (https://example.org/%d) >> >>" % key)
    refs = lambda f: b" ".join(b"%d 0 R" % f(k) for k in range(n))
    nums = b" ".join(b"%d [%d 0 R]" % (k, elem(k)) for k in range(n))
    extra.append(b"<< /Type /StructTreeRoot /K [%s] /RoleMap << /Par0 /P /Par1 /Par2 /Par2 /H2 >> /ParentTree << /Nums [%s] >> >>" % (refs(elem), nums))
    root = b"/Outlines << /First %d 0 R >> /AcroForm << /Fields [<< /T (nation) /Kids [%s] >>] >> /StructTreeRoot %d 0 R /Lang (en) " % (entry(0), refs(fld), base + 4 * n + 1)
    made = synthetic.make_pdf(pages, extra=extra, root=root)
    # Pages get their place in the tree of parents and their link.
    objects = [made.split(b"%d 0 obj\n" % k, 1)[1].split(b"\nendobj", 1)[0] for k in range(1, base + 4 * n + 2)]
    for k in range(n):
        objects[page[k] - 1] = objects[page[k] - 1][:-2] + b"/StructParents %d /Annots [%d 0 R] >>" % (k, link(k))
    return synthetic.assemble(objects)


def _structured(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Rows of one kind from a file for each region, of its nations."""
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_structured_pdf([(x["n_nationkey"], x["n_name"], x["n_regionkey"]) for x in n]) for n in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["path", "content"])

    return parse_table(nations.mapInArrow(run, "path string, content binary"), kinds=frozenset({kind}))


@query("S-22 J-05", "SELECT n_name AS title, cast(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS page, cast(701 - row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS DOUBLE) AS y FROM nation")
def pdf_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _structured(spark, sf_dir, "outline")
    return rows.select(F.col("text").alias("title"), "page", F.get_json_object("attrs", "$.y").cast("double").alias("y"))


@query(
    "S-21 D-70 F-66",
    "SELECT 'nation.n' || n_nationkey AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'radio' ELSE 'text' END AS kind, CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey % 4 = 0 THEN '[redacted]' ELSE 'v' || n_regionkey END AS value, n_name AS label FROM nation",
)
def pdf_form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lambda k: F.get_json_object("attrs", f"$.{k}")
    return _structured(spark, sf_dir, "field").select(F.col("text").alias("name"), a("what").alias("kind"), a("value").alias("value"), a("label").alias("label"))


@query(
    "S-20 J-01 J-16",
    "SELECT cast(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS page, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) % 2 = 1 THEN 'paragraph' ELSE 'heading' END AS kind, n_name AS text, cast(0.995 AS DOUBLE) AS confidence FROM nation",
)
def pdf_tagged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged leaves joined to their glyphs by page and marked content."""
    tags = _structured(spark, sf_dir, "tag").select("path", F.from_json("attrs", "what string, confidence double, mcids array<struct<page: int, mcid: int>>").alias("t"))
    keys = tags.select("path", F.col("t.what").alias("kind"), F.col("t.confidence").alias("confidence"), F.inline("t.mcids"))
    glyphs = _structured(spark, sf_dir, "glyph").select("path", "page", "seq", "text", F.get_json_object("attrs", "$.mcid").cast("int").alias("mcid"))
    text = glyphs.groupBy("path", "page", "mcid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda g: g["text"]), "").alias("text"))
    return keys.join(text, ["path", "page", "mcid"], "left").select("page", "kind", "text", "confidence")


@query("S-17 F-51", "SELECT cast(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS page, 'https://example.org/' || n_nationkey AS uri FROM nation")
def pdf_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structured(spark, sf_dir, "link").select("page", F.col("text").alias("uri"))


@query(
    "F-40 F-41 M-06",
    """WITH n AS (SELECT n_nationkey, n_name, cast(n_nationkey AS varchar) AS k FROM nation)
    SELECT n_nationkey, n_name || ' (' || k || ' גבא) 12 دجبا' AS visual, '[' || repeat('0, ', length(n_name) + 2) || repeat('1, ', 4) || repeat('2, ', length(k)) || '0, 0, ' || repeat('1, ', 5) || '2, 2]' AS levels, length(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) < 7 AS rtl FROM n""",
)
def bidi_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual order and levels of names set beside Hebrew and Arabic words."""
    from ..functions import bidi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [f"{n} (אבג {k}) ابجد 12" for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            found = [bidi.resolve(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([bidi.visual(t) for t in texts]), pa.array([json.dumps(r.levels) for r in found]), pa.array([bidi.is_rtl(t) for t in texts])], ["n_nationkey", "visual", "levels", "rtl"]
            )

    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInArrow(run, "n_nationkey int, visual string, levels string, rtl boolean")
