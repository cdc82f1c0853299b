from __future__ import annotations

from glyphweave.convert import convert_bytes
from glyphweave.functions.cites import cites
from glyphweave.sources.pdf.synthetic import make_pdf, text_op

BODY = "The body of the page is set in ten points and goes on"


def page(*ops):
    return b"\n".join(ops)


def nodes(*pages):
    return convert_bytes(make_pdf(list(pages)))["nodes"]


def test_references_and_citations():
    text = [text_op(72, 740, "Work", "F2", 16), text_op(72, 715, "Shown before [1, 2] and by others [7].")]
    refs = [text_op(72, 640, "References", "F2", 16), text_op(72, 615, "[1] Smith, J. A book. Some Press, 1999."), text_op(72, 590, "[2] Jones, K. A paper. Journal of It, 2004."), text_op(72, 540, "Afterword", "F2", 16), text_op(72, 515, "[3] not an entry.")]
    found = nodes(page(*text, *refs))
    assert [(n["attrs"]["label"], n["text"][:5]) for n in found if n["kind"] == "reference"] == [("1", "Smith"), ("2", "Jones")]
    links = next(n["attrs"]["links"] for n in found if n["text"].startswith("Shown"))
    assert [x["target"] for x in links] == ["reference-1", "reference-2"]
    md = convert_bytes(make_pdf([page(*text, *refs)]))["markdown"]
    assert "[^reference-1]: Smith" in md and "[7\\]" in md


def test_numbered_prose_under_references_stays():
    found = nodes(page(text_op(72, 740, "References", "F2", 16), text_op(72, 715, "[1] first do this"), text_op(72, 690, "[2] then do that"), *[text_op(72, 600 - 13 * k, BODY) for k in range(3)]))
    assert all(n["kind"] != "reference" for n in found)
    assert cites("Doe, J. Title. 2001, pp. 3") and not cites("plain words here") and not cites("in 1999 it was") and not cites("x")


def test_footnotes_by_size_and_place():
    body = [text_op(72, 740 - 13 * k, BODY, size=10) for k in range(5)]
    found = nodes(page(*body, text_op(72, 110, "1. A small note.", size=7), text_op(72, 80, "* Another one.", size=7), text_op(72, 400, "1. A small line higher up.", size=7)))
    assert [(n["text"], n["attrs"]["label"]) for n in found if n["kind"] == "note"] == [("A small note.", "1"), ("Another one.", "*")]


def test_contents_lead_to_headings():
    toc = [text_op(72, 740, "Contents", "F2", 14), text_op(72, 715, "First Part .......... 2"), text_op(72, 690, "Second Part ......... iv"), text_op(72, 665, "Lost Part ........... 9")]
    rest = [text_op(72, 740, "First Part", "F2", 16), *[text_op(72, 700 - 13 * k, BODY) for k in range(3)], text_op(72, 600, "Second Part", "F2", 16), *[text_op(72, 560 - 13 * k, BODY) for k in range(3)]]
    found = nodes(page(*toc), page(*rest))
    assert [(n["text"], n["attrs"]["page_label"], n["attrs"]["target"]) for n in found if n["kind"] == "toc_item"] == [("First Part", "2", "first-part"), ("Second Part", "iv", "second-part"), ("Lost Part", "9", None)]


def test_pointers_to_captions_and_sections():
    ops = [text_op(72, 740, "2.1 Method", "F2", 12), *[text_op(72, 700 - 13 * k, BODY) for k in range(3)], text_op(72, 600, "As Fig. 3 and Section 2.1 show, but Table 9 does not."), text_op(72, 500, "Figure 3. What is seen.")]
    found = nodes(page(*ops))
    links = next(n["attrs"]["links"] for n in found if n["text"].startswith("As Fig"))
    assert [(x["text"], x["target"]) for x in links] == [("Fig. 3", "figure-3"), ("Section 2.1", "2-1-method")]


def test_outline_finds_headings():
    content = page(text_op(72, 740, "Opening Words", "F2", 16), *[text_op(72, 700 - 13 * k, BODY) for k in range(3)])
    entry = b"<< /Title (opening words) /Parent 1 0 R /Dest [8 0 R /XYZ 0 740 0] >>"
    data = make_pdf([content], extra=[entry], root=b"/Outlines << /First 9 0 R >> ")
    report = convert_bytes(data)["report"]
    assert [(o["title"], o["target"]) for o in report["outline"]] == [("opening words", "opening-words")] and report["valid"]
