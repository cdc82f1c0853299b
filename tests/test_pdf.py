from __future__ import annotations

import zlib

import pytest

from glyphweave.plans.pdf import _structured_pdf, lzw_encode, packings
from glyphweave.sources.pdf import filters
from glyphweave.sources.pdf.content import Interpreter, text_string, tokens
from glyphweave.sources.pdf.document import Document, parse_pages
from glyphweave.sources.pdf.fonts import glyph_text, parse_cmap, traits
from glyphweave.sources.pdf.lines import join, lines
from glyphweave.sources.pdf.objects import END, Lexer, Name, Operator, PdfError, Ref, Stream
from glyphweave.sources.pdf.reader import parse, read_pdfs, stream_pdfs
from glyphweave.sources.pdf.structure import form_fields, outline, tagged_nodes
from glyphweave.sources.pdf.synthetic import assemble, fill_op, make_pdf, rule_op, text_op, text_pdf


def words(data, page=0):
    doc = Document(data)
    it = Interpreter(doc, doc.pages()[page])
    return [x["text"] for x in lines(it.run().glyphs)], doc


def test_lexer():
    lex = Lexer(rb"<< /A#20b 1 /C [1 0 R -2.5 (a\(b\)\n\101) <48 6> true null] >> % x" + b"\n/E")
    assert lex.next() == {"A b": 1, "C": [Ref(1, 0), -2.5, b"a(b)\nA", b"H`", True, None]}
    assert isinstance(lex.next(), Name) and lex.next() is END
    assert [*tokens(b"1 0 0 1 5 6 cm (x) Tj [(a) -20 (b)] TJ")] == [("cm", [1, 0, 0, 1, 5, 6]), ("Tj", [b"x"]), ("TJ", [[b"a", -20, b"b"]])]
    assert isinstance(Lexer(b"endobj").next(), Operator)


def test_inline_images_end_where_they_should():
    found = [*tokens(b"q BI /W 4 /H 1 /BPC 8 /CS /G ID EI E EI Q BT ET")]
    assert [op for op, _ in found] == ["q", "INLINE", "Q", "BT", "ET"]
    assert found[1][1][1] == b"EI E"


@pytest.mark.parametrize("data", [b"", b"x", b"hello hello hello " * 400, bytes(range(256)) * 40])
def test_filters(data):
    for name, (packed, names, parms) in packings(data).items():
        back, warnings = filters.decode(packed, names, parms)
        assert back[: len(data)] == data and not warnings, name
    assert filters.lzw(lzw_encode(data)) == data


def test_filters_in_turn_and_damaged():
    data = b"some text " * 30
    assert filters.decode(zlib.compress(data).hex().encode() + b">", ["AHx", "Fl"], [])[0] == data
    cut, warnings = filters.flate(zlib.compress(data * 50)[:-9])
    assert (data * 50).startswith(cut) and warnings
    assert filters.decode(b"\xff\xd8", ["DCTDecode"], []) == (b"\xff\xd8", ["IMAGE_FILTER_DCTDecode"])
    assert filters.flate(zlib.compress(b"a" * 10_000), 100) == (b"a" * 100, ["STREAM_TRUNCATED"])
    assert filters.predict(b"\x01\x05\x01\x01\x04\x01\x02\x03", {"Predictor": 15, "Columns": 3}) == bytes([5, 6, 7, 6, 8, 11])
    assert filters.predict(bytes([1, 1, 1, 2, 2, 2]), {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3, 2, 4, 6])


def test_text_comes_back():
    text = "One line.\nTwo é ü ß (brackets) \\ slash\nThree   spaced"
    got, doc = words(text_pdf(text))
    assert " ".join(got) == " ".join(text.split()) and not doc.warnings


def test_word_gaps():
    g = lambda t, x0, x1: {"text": t, "x0": x0, "x1": x1, "size": 10.0}
    assert join([g("A", 0, 5), g("B", 7.21, 12)]) == "A B"
    assert join([g("A", 0, 5), g("B", 7.19, 12)]) == "AB"
    assert join([g("漢", 0, 10), g("字", 14, 24)]) == "漢字" and join([g("ﬁ", 0, 5), g("n", 5, 9)]) == "fin"


def test_recovery_and_bad_lengths():
    whole = make_pdf([text_op(72, 700, "kept"), text_op(72, 700, "second")])
    broken = whole[: whole.index(b"xref\n")]
    assert words(broken)[0] == ["kept"] and words(broken, 1)[0] == ["second"]
    wrong = whole.replace(b"/Length ", b"/Length 9", 1)
    got, doc = words(wrong)
    assert got == ["kept"] and any("LENGTH" in w or "XREF" in w for w in doc.warnings)
    payload = make_pdf([text_op(72, 700, "a") + b"\n% 9 0 obj (made up) endobj"])
    doc = Document(payload[: payload.index(b"xref\n")])
    assert 9 not in doc.places or doc.get(9) != b"made up"


def test_newer_revisions_win_and_cycles_end():
    first = make_pdf([text_op(72, 700, "old")])
    doc = Document(first)
    content = next(n for n in doc.places if isinstance(doc.get(n), Stream))
    at = len(first)
    body = text_op(72, 700, "new")
    update = b"%d 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (content, len(body), body)
    start = first.rindex(b"xref\n0")
    tail = b"xref\n%d 1\n%010d 00000 n \ntrailer\n<< /Size 20 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (content, at, start, at + len(update))
    assert words(first + update + tail)[0] == ["new"]
    loop = (first + update + tail).replace(b"/Prev %d" % start, b"/Prev %d" % (at + len(update)))
    assert any("CYCLE" in w or "RECOVERED" in w for w in Document(loop).warnings)


def test_cross_reference_and_object_streams():
    members = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] /MediaBox [0 0 300 300] >>", b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> >> >> >>"]
    head, body = b"", b""
    for k, m in enumerate(members, 1):
        head += b"%d %d " % (k, len(body))
        body += m + b" "
    packed = zlib.compress(head + body)
    out = bytearray(b"%PDF-1.5\n")
    at4 = len(out)
    out += b"4 0 obj\n<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(head), len(packed), packed)
    at5 = len(out)
    content = text_op(20, 200, "from a stream")
    out += b"5 0 obj\n<< /Length 6 0 R >>\nstream\n%s\nendstream\nendobj\n" % content
    at6 = len(out)
    out += b"6 0 obj\n%d\nendobj\n" % len(content)
    at7 = len(out)
    rows = [(0, 0, 255), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0), (1, at6, 0), (1, at7, 0)]
    table = b"".join(bytes([a]) + b.to_bytes(2, "big") + bytes([c]) for a, b, c in rows)
    out += b"7 0 obj\n<< /Type /XRef /Size 8 /W [1 2 1] /Root 1 0 R /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (len(table), table, at7)
    got, doc = words(bytes(out))
    assert got == ["from a stream"] and not doc.warnings
    assert Interpreter(doc, doc.pages()[0]).width == 300


def test_encrypted_files_are_refused():
    data = make_pdf([b""]).replace(b"/Size ", b"/Encrypt << /Filter /Standard >> /Size ")
    with pytest.raises(PdfError, match="encrypted"):
        Document(data)
    assert [r["kind"] for r in parse(data)] == ["error"] and [r["kind"] for r in parse(b"junk")][-1] in ("warning", "error")


def test_page_selection_and_rotation():
    assert parse_pages("1,3-5") == {1, 3, 4, 5} and parse_pages("4-", 6) == {4, 5, 6} and parse_pages(None) is None
    data = make_pdf([text_op(72, 700, f"page {k}") for k in range(1, 6)])
    assert [r["text"] for r in parse(data, "2,4-") if r["kind"] == "line"] == ["page 2", "page 4", "page 5"]
    turned = Document(make_pdf([text_op(100, 50, "x")], page_attrs=b"/Rotate 90 /UserUnit 2 "))
    it = Interpreter(turned, turned.pages()[0])
    g = it.run().glyphs[0]
    assert (it.width, it.height) == (1584, 1224) and not g["upright"] and abs(g["y0"] - 200) < 1e-6


def test_visibility_marks_and_clips():
    stream = b"\n".join([
        text_op(72, 700, "shown"), text_op(72, 680, "hidden", mode=3), b"/Artifact BMC " + text_op(72, 660, "margin") + b" EMC", b"/Span << /ActualText (whole) /MCID 4 >> BDC " + text_op(72, 640, "frag") + text_op(120, 640, "ments") + b" EMC",
        b"q 0 0 50 50 re W n " + text_op(72, 620, "outside") + b" Q", text_op(72, 600, "twice"), text_op(72, 600, "twice"),
    ])
    got, doc = words(make_pdf([stream]))
    assert got == ["shown", "whole", "twice"]
    glyphs = Interpreter(doc, doc.pages()[0]).run().glyphs
    assert [g["mcid"] for g in glyphs if g["text"] == "whole"] == [4]


def test_rules_fills_and_forms():
    form = b"<< /Type /XObject /Subtype /Form /BBox [0 0 100 100] /Matrix [1 0 0 1 10 20] /Length 27 >>\nstream\n0 0 50 50 re f /Me Do 1 w S\nendstream"
    data = make_pdf([rule_op(72, 700, 200, 700, 2) + b" " + fill_op(72, 600, 100, 40, 0.8) + b" 72 500 200 0.5 re f 10 10 m 20 20 30 20 40 10 c S"], extra=[form])
    doc = Document(data)
    rows = Interpreter(doc, doc.pages()[0]).run()
    assert [(s["x0"], s["y0"], s["x1"], s["width"]) for s in rows.segments] == [(72, 92, 200, 2), (72, 291.75, 272, 0.5)]
    assert [(f["x0"], f["y0"], f["x1"], f["y1"]) for f in rows.fills] == [(72, 152, 172, 192)] and rows.paths[0]["curves"] == 1


def test_fonts():
    assert glyph_text("uni0041.alt") == "A" and glyph_text("f_i") == "fi" and glyph_text("eacute") == "é" and glyph_text("g123") is None and glyph_text("u1F600") == "😀"
    assert traits("ABCDEF+CMBX10")[0] and traits("Times-Italic")[1] and traits("Courier")[2] and not traits("Foo-Medium")[0]
    cmap = parse_cmap(b"begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange beginbfchar <41> <00660066> endbfchar beginbfrange <8001> <8003> <0391> <42> <43> [<0062> <0063>] <44> <45 [ endbfrange")
    assert cmap.split(b"A\x80\x01B", 1) == [b"A", b"\x80\x01", b"B"] and cmap.texts == {b"A": "ff", b"\x80\x01": "Α", b"\x80\x02": "Β", b"\x80\x03": "Γ", b"B": "b", b"C": "c"}
    assert text_string(b"\xfe\xff\x00A\x20\xac") == "A€" and text_string(b"\xef\xbb\xbf\xc3\xa9") == "é" and text_string(b"\x84x") == "—x"


def test_structure():
    doc = Document(_structured_pdf([(0, "ALGERIA", 0), (4, "EGYPT", 4), (3, "CANADA", 1)]))
    assert [(o["title"], o["page"], o["y"]) for o in outline(doc)] == [("ALGERIA", 1, 700), ("EGYPT", 2, 699), ("CANADA", 3, 698)]
    assert [(f["name"], f["kind"], f["value"]) for f in form_fields(doc)] == [("nation.n0", "radio", "v0"), ("nation.n4", "text", "[redacted]"), ("nation.n3", "radio", "v1")]
    assert [(t["kind"], t["page"], t["confidence"]) for t in tagged_nodes(doc)] == [("paragraph", 1, 0.995), ("heading", 2, 0.995), ("paragraph", 3, 0.995)]


def test_role_maps_that_lead_nowhere():
    objects = [b"<< /Type /Catalog /Pages 2 0 R /StructTreeRoot 3 0 R >>", b"<< /Type /Pages /Count 0 /Kids [2 0 R] >>", b"<< /K [4 0 R 4 0 R] /RoleMap << /A /B /B /A >> >>", b"<< /S /A /K [4 0 R] >>"]
    doc = Document(assemble(objects))
    assert [(t["role"], t["kind"]) for t in tagged_nodes(doc)] == [("A", "section")] and doc.pages() == [] and len(doc.warnings) >= 1


def test_folders_and_streams(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.pdf").write_bytes(text_pdf(f"file number {k}"))
    got = {r.text for r in read_pdfs(spark, str(tmp_path)).filter("kind = 'line'").collect()}
    assert got == {f"file number {k}" for k in range(3)}
    query = stream_pdfs(spark, str(tmp_path)).filter("kind = 'line'").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.text for r in spark.table("arrived").collect()} == got


def test_data_source(spark, tmp_path):
    from glyphweave.ship import ship
    from glyphweave.sources.pdf.reader import PdfSource

    ship(spark)
    (tmp_path / "a.pdf").write_bytes(text_pdf("through a source"))
    spark.dataSource.register(PdfSource)
    rows = spark.read.format("pdf").option("path", str(tmp_path)).load()
    assert [r.text for r in rows.filter("kind = 'line'").collect()] == ["through a source"]


def test_small_files_share_a_task(tmp_path):
    from glyphweave.sources.pdf.reader import PdfReader

    for k in range(5):
        (tmp_path / f"{k}.pdf").write_bytes(b"x" * 40)
    (tmp_path / "note.txt").write_text("x")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        assert [len(p.value) for p in PdfReader({"path": path, "taskbytes": "100"}).partitions()] == [2, 2, 1]
    assert [p.value for p in PdfReader({"path": str(tmp_path / "3.pdf")}).partitions()] == [[str(tmp_path / "3.pdf")]]
    with pytest.raises(FileNotFoundError):
        PdfReader({"path": str(tmp_path / "none")}).partitions()
