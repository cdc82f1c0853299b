from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphweave.convert import Options, convert, convert_bytes, node_table, validate
from glyphweave.functions import bidi
from glyphweave.metrics import tables as metrics
from glyphweave.operators import blocks
from glyphweave.plans.documents import _tree, order_sheet
from glyphweave.render import html, markdown
from glyphweave.sources.pdf.synthetic import fill_op, make_pdf, rule_op, text_op, text_pdf

BODY = "The body of the page is set in ten and a half points"


def page(*ops):
    return make_pdf([b"\n".join(ops)])


def kinds(data, **options):
    return [(n["kind"], n["attrs"].get("level"), n["text"]) for n in convert_bytes(data, Options(**options))["nodes"] if n["depth"] == 0]


def body(y, n=3):
    return [text_op(72, y - 13 * k, BODY, "F1", 10.5) for k in range(n)]


def test_heading_ladder():
    data = page(text_op(72, 740, "Third", "F2", 13.5), *body(720), text_op(72, 660, "Fourth", "F2", 11.5), *body(640), text_op(72, 580, "Fifth", "F2", 10.5), *body(560), text_op(72, 500, "SIXTH LABEL", "F2", 9.5), *body(480))
    assert [(level, t) for kind, level, t in kinds(data) if kind == "heading"] == [(3, "Third"), (4, "Fourth"), (5, "Fifth"), (6, "SIXTH LABEL")]
    assert {level for kind, level, _ in kinds(data, heading_levels="flat") if kind == "heading"} == {1}
    with pytest.raises(ValueError):
        Options(heading_levels="other")


def test_what_is_no_heading():
    data = page(text_op(72, 740, "Figure 2. A caption set large", "F1", 18), *body(700), text_op(72, 640, "A bold sentence ends with a stop.", "F2", 10.5), *body(620), text_op(72, 560, "Close display", "F1", 13), *body(546))
    found = kinds(data)
    assert "heading" not in [k for k, _, _ in found] and found[0][0] == "caption"
    assert "**A bold sentence ends with a stop.**" in convert_bytes(data)["markdown"]


def test_isolated_display_and_title():
    data = page(text_op(72, 740, "A Title", "F2", 22), *body(700), text_op(72, 560, "On Its Own", "F1", 18), *body(480))
    assert [(level, t) for kind, level, t in kinds(data) if kind == "heading"] == [(1, "A Title"), (2, "On Its Own")]


def test_lists_and_code():
    data = page(*body(740), text_op(72, 690, "- one"), text_op(72, 677, "- [x] two"), text_op(92, 664, "1. inner"), text_op(92, 651, "2. second"), text_op(72, 638, "- three"), text_op(72, 600, "def f():", "F4", 10), text_op(96, 588, "return 1", "F4", 10))
    md = convert_bytes(data)["markdown"]
    assert "- one\n- [x] two\n    1. inner\n    2. second\n- three" in md
    assert "```\ndef f():\n    return 1\n```" in md


def test_paragraphs_and_hyphens():
    assert blocks.join_lines(["the pro-", "vided text"]) == "the provided text"
    assert blocks.join_lines(["a well-", "known case"]) == "a well-known case"
    assert blocks.join_lines(["soft­", "hyphen"]) == "softhyphen" and blocks.join_lines(["NATO-", "led"]) == "NATO- led"


def test_columns_are_read_one_after_the_other():
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    left = [text_op(60, 720 - 14 * k, f"left {words[k]} has several words", size=10) for k in range(8)]
    right = [text_op(330, 720 - 14 * k, f"right {words[k]} has several words", size=10) for k in range(8)]
    text = " ".join(t for _, _, t in kinds(page(*[x for pair in zip(left, right, strict=True) for x in pair])))
    assert text.index("left theta") < text.index("right alpha")


def test_furniture_goes():
    pages = [b"\n".join([text_op(72, 770, "Running head"), *body(700), text_op(300, 20, f"Page {k}"), text_op(72, 600, f"unique {k} words")]) for k in range(1, 5)]
    md = convert_bytes(make_pdf(pages))["markdown"]
    assert "Running head" not in md and "Page 3" not in md and "unique 3 words" in md


def test_ruled_tables_spans_and_continuation():
    md = convert_bytes(order_sheet(7, [("A", "F", "1"), ("N", "O", "22")]))["markdown"]
    assert "| Flag | Status | Qty |\n| --- | --- | --- |\n| A | F | 1 |\n| N | O | 22 |" in md
    rules = [rule_op(72, y, 272, y) for y in (700, 680, 660)] + [rule_op(x, 700, x, 660) for x in (72, 272)] + [rule_op(172, 680, 172, 660)]
    page_html = convert_bytes(page(*rules, text_op(80, 685, "both"), text_op(80, 665, "a"), text_op(180, 665, "b")))["markdown"]
    assert '<td colspan="2">both</td>' in page_html and "<td>a</td><td>b</td>" in page_html

    def part(y, rows):
        grid = [("K", "V"), *rows]
        return b"\n".join([*[rule_op(72, y - 20 * k, 272, y - 20 * k) for k in range(len(grid) + 1)], *[rule_op(x, y, x, y - 20 * len(grid)) for x in (72, 172, 272)], *[text_op(76 + 100 * c, y - 15 - 20 * r, t, "F2" if r == 0 else "F1") for r, row in enumerate(grid) for c, t in enumerate(row)]])

    both = convert_bytes(make_pdf([part(140, [("a", "1"), ("b", "2")]), part(740, [("c", "3")])]))
    assert both["markdown"].count("| K | V |") == 1 and "| c | 3 |" in both["markdown"]
    assert any("multi_page_table_continuation" in n["evidence"] for n in both["nodes"])
    assert convert_bytes(make_pdf([part(740, [("a", "1")]), part(740, [("c", "3")])]))["markdown"].count("| K | V |") == 2


def test_fills_alone_make_no_table():
    assert all(k != "table" for k, _, _ in kinds(page(fill_op(72, 600, 200, 60), *body(640))))


def test_conversion_is_deterministic_and_valid(spark):
    files = spark.createDataFrame([(f"f{k}", bytearray(text_pdf(f"text {k} with some words\n- item {k}"))) for k in range(4)] + [("bad", bytearray(b"not a file")), ("none", None)], "path string, content binary")
    a, b = ({r.path: tuple(r) for r in convert(files).collect()} for _ in range(2))
    assert a == b and set(a) == {"f0", "f1", "f2", "f3", "bad", "none"}
    reports = [json.loads(r.report) for r in convert(files).filter("error IS NULL").collect()]
    assert all(r["valid"] and not r["errors"] for r in reports)
    assert node_table(convert(files)).filter("kind = 'list'").count() == 4


def test_validation_finds_faults():
    good = {"node": 0, "parent": None, "kind": "paragraph", "confidence": 0.9, "lines": ["x"]}
    assert validate([good]) == []
    assert len(validate([good, good, {**good, "node": 2, "kind": "blink"}, {**good, "node": 3, "confidence": 1.5}, {**good, "node": 4, "lines": []}, {**good, "node": 5, "parent": 9}])) == 5


def test_streaming_equals_batch(spark, tmp_path):
    from glyphweave.convert import convert_files
    from glyphweave.streaming import convert_stream

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.pdf").write_bytes(text_pdf(f"stream {k}"))
    (tmp_path / "in" / "again.pdf").write_bytes(text_pdf("stream 0"))
    got: list[str] = []
    convert_stream(spark, str(tmp_path / "in"), lambda df, _: got.extend(r.markdown for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(got) == sorted({r.markdown for r in convert_files(spark, str(tmp_path / "in")).collect()})


def test_streaming_of_every_path(spark, tmp_path):
    from glyphweave.streaming import convert_stream

    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.pdf").write_bytes(text_pdf("the same"))
    got: list[str] = []
    convert_stream(spark, str(tmp_path / "in"), lambda df, _: got.extend(r.path for r in df.collect()), str(tmp_path / "cp"), every_path=True).awaitTermination()
    assert sorted(p.rsplit("/", 1)[1] for p in got) == ["a.pdf", "b.pdf"]


def test_markdown_marks():
    assert markdown.escape("a*b_c _d_ [x]") == "a\\*b_c \\_d\\_ \\[x\\]" and markdown.wrap("**", " a ") == " **a** " and markdown.fence("x ```` y") == "`````"


@pytest.mark.parametrize(("fragment", "safe"), [
    ("<p>a</p>", True), ("<p>a</p><p>b</p>", False), ("<p>a", False), ("<p onclick='x'>a</p>", False), ("<script>x</script>", False), ("<!-- c --><p>a</p>", False), ("<table><tr><td colspan='2'>a</td></tr></table>", True),
    ("<table>x<tr><td>a</td></tr></table>", False), ("<tr><td>a</td></tr>", False), ("<a href='javascript:x'>a</a>", False), ("<a href='https://x/y'>a</a>", True), ("<img src='../x.png' alt=''>", False), ("<img src='a/x.png' alt=''>", True), ("<td rowspan='0'>a</td>", False), ("", False),
])
def test_allowed_html(fragment, safe):
    assert html.is_safe(fragment) == safe


def test_html_has_no_way_out():
    out = convert_bytes(page(*body(700), text_op(72, 600, "<script>alert(1)</script>")))["html"]
    assert "<script" not in out and "default-src 'none'" in out and "&lt;script&gt;" in out


def test_teds():
    rows = [{"flag": a, "status": b, "qty": c} for a, b, c in (("A", "F", "1"), ("N", "O", "2"), ("R", "F", "3"), ("A", "O", "4"))]
    same, changed = _tree(rows), _tree(rows, True)
    assert metrics.teds(same, same) == 1.0 and metrics.score(same, same)["span_exact"] == 1.0
    got = metrics.score(same, changed)
    assert got["cell_exact"] == got["span_exact"] == 0.0 and abs(got["teds"] - (1 - (4 + 1 / 7) / 17)) < 1e-12
    one = _tree([{**rows[0], "qty": "10"}, *rows[1:]])
    assert abs(metrics.teds(same, one) - (1 - 1 / 8 / 17)) < 1e-12


def slow_distance(a, b):
    """Forest edit distance by its definition."""
    from functools import lru_cache

    freeze = lambda t: (t[0], tuple(map(freeze, t[1])))

    @lru_cache(None)
    def cost(f, g):
        if not f and not g:
            return 0.0
        out = []
        if f:
            out.append(cost(f[:-1] + f[-1][1], g) + 1)
        if g:
            out.append(cost(f, g[:-1] + g[-1][1]) + 1)
        if f and g:
            out.append(cost(f[-1][1], g[-1][1]) + cost(f[:-1], g[:-1]) + metrics.rename_cost(f[-1][0], g[-1][0]))
        return min(out)

    return cost((freeze(a),), (freeze(b),))


trees = st.recursive(st.tuples(st.sampled_from(["a", "b:x", "b:xy", "c"]), st.just([])), lambda t: st.tuples(st.sampled_from(["a", "b:x", "c"]), st.lists(t, max_size=3)), max_leaves=7)


@settings(max_examples=120, deadline=None)
@given(trees, trees)
def test_tree_distance(a, b):
    assert abs(metrics.tree_distance(metrics.flatten(a), metrics.flatten(b)) - slow_distance(a, b)) < 1e-9


def test_bidi():
    assert bidi.visual("abc אבג def") == "abc גבא def" and bidi.visual("אבג (1) abc") == "abc (1) גבא"
    assert bidi.visual("שלום 123 ו-45", 1).startswith("45") and bidi.resolve("אב 12").base == 1 and bidi.resolve("אב 12").levels == [1, 1, 1, 2, 2]
    assert bidi.visual("‮abc‬") == "cba" and bidi.visual("a⁧bא⁩c") == "aאbc"
    assert bidi.mirror("(") == ")" and bidi.mirror("≤") == "≥" and bidi.mirror("a") == "a" and bidi.bracket("[") == ("o", "[") and bidi.bracket("a") is None
    assert bidi.is_rtl("שלום a") and not bidi.is_rtl("hello א") and bidi.has_rtl("x א")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab אב12-+,.()[]ا٣ ‪‫‬‭‮⁦⁧⁨⁩\n", max_size=30))
def test_bidi_loses_nothing(text):
    r = bidi.resolve(text)
    assert sorted(r.order) == [i for i, level in enumerate(r.levels) if level is not None]
    assert all(level is None or 0 <= level <= 126 for level in r.levels)


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab cé", max_size=40), st.text(alphabet="ab cé", max_size=40))
def test_reading_similarity(a, b):
    x, y = " ".join(a.split()), " ".join(b.split())
    want = 2 * plain_common(x, y) / (len(x) + len(y)) if x or y else 1.0
    assert metrics.normalised_distance(a, b) == want and metrics.normalised_distance(a, a) == 1.0


def test_heading_similarity():
    text = "# One\nwords here\n## Two\nmore words\n"
    assert metrics.heading_similarity(text, text) == 1.0 and metrics.heading_similarity("no heading", text) is None
    assert metrics.heading_tree(text, flat=False) == ("document", [("heading:one", [("text:words here", []), ("heading:two", [("text:more words", [])])])])
    assert metrics.heading_similarity(text, "# One\nwords here\n# Two\nmore words\n") == 1.0
    assert abs(metrics.heading_similarity(text, "# One\nwords here\n") - (1 - 2 / 5)) < 1e-12
    assert metrics.heading_similarity(text, text.replace("more", "other"), structure=True) == 1.0 > metrics.heading_similarity(text, text.replace("more", "other"))


def test_html_links_and_direction():
    links = [{"text": "[1]", "target": "reference-1"}, {"text": "Fig. 2", "target": "figure-2"}, {"text": "2", "target": "x"}, {"text": "none", "target": "y"}]
    assert html.linked("a < [1] & Fig. 2", links) == 'a &lt; <a href="#reference-1">[1]</a> &amp; <a href="#figure-2">Fig. 2</a>'
    assert html.linked("plain", []) == "plain"
    assert html.block({"kind": "paragraph", "text": "שלום עולם", "attrs": {}, "children": []}) == '<p dir="rtl">שלום עולם</p>'
    assert html.block({"kind": "heading", "text": "Hello", "attrs": {"level": 2}, "children": []}) == "<h2>Hello</h2>"
