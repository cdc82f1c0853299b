from __future__ import annotations

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphweave import cli
from glyphweave.operators import figures, folds
from glyphweave.render import mini
from glyphweave.sources.pdf.content import Interpreter
from glyphweave.sources.pdf.document import Document
from glyphweave.sources.pdf.synthetic import fill_op, make_pdf, rule_op, text_op, text_pdf


def test_overlap_and_suppression():
    a, b, c = (0, 0, 10, 10), (1, 1, 9, 9), (100, 0, 110, 10)
    assert folds.overlap(a, b) == 1.0 and folds.overlap(a, c) == 0.0
    assert folds.suppress([a, b, c, (5, 0, 15, 10)]) == [0, 2, 3] and folds.suppress([]) == []


def test_centroids_hang_on_order():
    assert folds.centroid_clusters([0, 4, 8], 5) == [[0, 4], [8]]
    assert folds.centroid_clusters([4, 0, 8], 5) == [[4, 0], [8]] and folds.centroid_clusters([4, 8, 0], 5) == [[4, 8], [0]]


def test_groups_end_where_seq_or_place_jumps():
    rows = [(1, (0, 0, 5, 5)), (2, (6, 0, 9, 5)), (4, (10, 0, 12, 5)), (5, (200, 0, 210, 5))]
    assert folds.contiguous_groups(rows) == [[0, 1], [2], [3]]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 7), max_size=4), max_size=6), st.frozensets(st.integers(0, 7), max_size=5))
def test_cover(sets, wanted):
    found = folds.cover(wanted, list(enumerate(sets)))
    possible = wanted <= frozenset().union(*sets) if sets else not wanted
    assert (found is not None) == possible
    if found is not None:
        assert wanted <= frozenset().union(*(sets[k] for k in found)) and len(set(found)) == len(found)


def test_spans_are_passed_over():
    assert folds.place_spans([[(2, 1), (1, 2)], [(1, 1), (1, 1)], [(1, 3)]]) == [[0, 1], [1, 2], [0]]
    assert folds.place_spans([[(1, 1), (3, 1)], [(1, 1)], [(1, 1), (1, 1)]]) == [[0, 1], [0], [0, 2]]


def test_nesting():
    assert folds.nest([10, 30, 32, 50, 10, 29], 4) == [0, 1, 1, 2, 0, 1]


def drawing(*ops):
    doc = Document(make_pdf([b"\n".join(ops)]))
    return Interpreter(doc, doc.pages()[0]).run()


def test_diagrams_take_their_text():
    ops = []
    for k in range(4):
        ops += [fill_op(80 + 100 * k, 600, 80, 40, 0.8), text_op(84 + 100 * k, 615, f"Box {k}", size=9)]
        ops += [rule_op(160 + 100 * k, 620, 180 + 100 * k, 612)] * (k < 3)
    rows = drawing(*ops, text_op(72, 300, "stays"))
    (found,) = figures.diagrams(rows.segments, rows.fills, rows.glyphs, (612, 792))
    assert found.alt == "Box 0 · Box 1 · Box 2 · Box 3" and found.svg.count(b"<rect") == 4 and found.svg.count(b"<line") == 3 and b"stays" not in found.svg
    again = figures.diagrams(rows.segments, rows.fills, rows.glyphs, (612, 792))[0]
    assert again.svg == found.svg and again.name == found.name
    assert figures.diagrams(rows.segments, rows.fills, rows.glyphs, (612, 792), [found.box]) == []
    plain = drawing(fill_op(80, 600, 60, 10), rule_op(72, 500, 300, 500))
    assert figures.diagrams(plain.segments, plain.fills, plain.glyphs, (612, 792)) == []


def test_formulas_need_curves_and_a_sign():
    curve = b"%d 500 m %d 510 %d 520 %d 500 c %d 490 %d 480 %d 500 c %d 510 %d 515 %d 505 c f"
    ops = [curve % tuple(100 + 8 * k + j for j in range(10)) for k in range(4)]
    rows = drawing(*ops, text_op(150, 500, "= x"))
    assert len(figures.formulas(rows.paths, rows.glyphs)) == 1
    assert figures.formulas(rows.paths, []) == [] and figures.formulas(rows.paths[:2], rows.glyphs) == []


def test_printed_forms():
    column = [(72, 100 + 40 * k, 200, 120 + 40 * k) for k in range(5)]
    assert figures.form_columns(column) and figures.form_columns([*column, *[(300, b[1], 400, b[3]) for b in column[:3]]])
    assert not figures.form_columns([(72 + 50 * k, 100, 100, 120) for k in range(6)]) and not figures.form_columns(column[:3])


def test_scripts():
    g = lambda t, x, y, size: {"text": t, "x0": x, "x1": x + 5, "y0": y, "y1": y + size, "size": size}
    row = [g("x", 0, 0, 10), g("2", 6, -3, 6), g("+", 12, 0, 10), g("a", 18, 0, 10), g("i", 24, 6, 6)]
    assert figures.math_ml(row) == "<math><mrow><msup><mi>x</mi><mn>2</mn></msup><mo>+</mo><msub><mi>a</mi><mi>i</mi></msub></mrow></math>"


def test_markdown_to_html():
    out = mini.to_html("# A b\n\n# A b\n\nx **y** `<z>` [l](https://q) [bad](javascript:x)\n\n- one\n    1. in\n- [x] two\n\n| a | b |\n| --- | :---: |\n| 1\\|2 | 3 |\n\n> q\n> r\n\n---\n\n```\n<c>\n```")
    assert '<h1 id="a-b">A b</h1>\n<h1 id="a-b-2">A b</h1>' in out and '<a href="https://q">l</a>' in out and "[bad](javascript:x)" in out
    assert "<ul><li>one<ol><li>in</li></ol></li><li>☑ two</li></ul>" in out and "<td>1|2</td><td>3</td>" in out
    assert "<blockquote><p>q r</p></blockquote>" in out and "<hr>" in out and "<pre><code>&lt;c&gt;</code></pre>" in out and "<code>&lt;z&gt;</code>" in out


def test_choice_is_all_or_nothing():
    assert mini.choose("lay", "sem", True, {}) == "sem" and mini.choose("lay", "", True, {}) == "lay"
    assert mini.choose("a\n\nb\n\nc", "", False, {"a": "A", "c": "C"}) == "A\n\nb\n\nC"
    assert mini.choose("a\n\na\n\nc", "", False, {"a": "A", "c": "C"}) == "a\n\na\n\nc"


@pytest.mark.parametrize("what", ["convert", "inspect", "explain", "trace", "overlay", "time"])
def test_command_line(what, tmp_path, capsys):
    (tmp_path / "a.pdf").write_bytes(text_pdf("Some words\n- item"))
    assert cli.main([what, str(tmp_path / "a.pdf")]) == 0 and capsys.readouterr().out.strip()


def test_diff(tmp_path, capsys):
    for name, text in (("a", "x\ny\n"), ("b", "x\r\nz\r\n"), ("c", "x\r\ny\r\n")):
        (tmp_path / name).write_bytes(text.encode())
    assert cli.main(["diff", str(tmp_path / "a"), str(tmp_path / "b")]) == 1 and "+z" in capsys.readouterr().out
    assert cli.main(["diff", str(tmp_path / "a"), str(tmp_path / "c")]) == 0


def test_every_row_of_the_plan_is_named_once():
    from glyphweave import plans

    rows = list(itertools.chain.from_iterable(plans.COVERS.values()))
    assert all(r[0] in "SPJAWOUFDRMX" and r[1] == "-" for r in rows) and set(plans.SQL) <= set(plans.QUERIES)
