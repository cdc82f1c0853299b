from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from glyphweave.llm.main_text import extract, main_text, path_scores, read_page, tag_paths

LONG = "A sentence that is long enough to weigh, with commas, and with a full stop. " * 3


def page(article, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p><p>no</p>';</script></head><body>{before}<article>{article}</article>{after}</body></html>"


def test_article_without_its_surroundings():
    before = "<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='cookie-notice'>We use them, all of them, and more.</div>"
    after = f"<aside>{LONG}</aside><div id=comments><p>{LONG}</p></div><form><p>Mail</p></form><footer>&copy; me</footer><div class=\"ad\">{LONG}</div>"
    html = page(f"<h1>Head &amp; line</h1><p>One\n  two<br>three</p><!-- <p>x</p> --><p>{LONG}</p><p>Be.</p>", before, after)
    assert main_text(html).split("\n") == ["Head & line", "One two three", LONG.strip(), "Be."]


def test_open_elements_and_cut_pages():
    assert main_text("<article><h1>H</h1><p><b>One.<br><p>Two &lt;b&gt; &#233;&nbsp;x.<p>Three.") == "H\nOne.\nTwo <b> é x.\nThree."
    assert main_text("<article><p>Kept.</p></article><footer>gone") == "Kept."
    assert main_text("<article><p>Kept.</p><script>never ends <p>x") == "Kept."
    assert main_text("<p>a < b & c</p>") == "a < b & c"
    assert main_text("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y<tr><td>z</table></article>") == "one\ntwo\nx\ny\nz"


def test_no_text():
    for html in (None, "", "   ", "<nav>only</nav>", "<script>x</script>", "<!-- c"):
        assert main_text(html) == ""


def test_link_lists_outside_zones_score_low():
    html = "<body><div><p>" + LONG + "</p><p>" + LONG + "</p></div><div><div><div><div><div><div><ul>" + "<li><a href=x>go</a></li>" * 30 + "</ul></div></div></div></div></div></div></body>"
    paths = tag_paths(*read_page(html))
    scores = path_scores(paths)
    assert paths[scores.index(max(scores))].name == "p"
    assert main_text(html) == "\n".join([LONG.strip()] * 2)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-\"'= apdivscrt&;\n", max_size=120))
def test_any_markup_is_read(html):
    main_text(html)


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", page("<p>É one.</p>"), "x", 1), (1, "u", page("<p>É one.</p>"), "x", 1), (None, None, None, None, None), (3, "v", page(f"<p>{LONG * 5000}</p>"), "x", 1)]
    got = extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.url, r.n_chars) for r in got if r.page_id != 3) == [(0, None, 0), (1, "u", 6), (1, "u", 6)]
    assert next(r.n_chars for r in got if r.page_id == 3) == len((LONG * 5000).strip())
    assert extract(spark.createDataFrame([], schema)).count() == 0
