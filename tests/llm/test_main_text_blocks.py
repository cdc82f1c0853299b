"""Blocks of the article that are short or links."""

from __future__ import annotations

import pytest

from glyphweave.llm.main_text import main_text

SENTENCE = "A sentence that is long enough to weigh, with commas, and with a full stop. "
PARAGRAPH = (SENTENCE * 8).strip()
TITLE = "A title of some sixty characters that links to the page here"


@pytest.mark.parametrize("holder", ["article", "main"])
def test_linked_title_and_linked_sources_stay(holder):
    menu = "<div><div><div><div><ul>" + "<li><a href=x>go</a></li>" * 30 + "</ul></div></div></div></div>"
    body = f"<h1><a href=/p>{TITLE}</a></h1>" + f"<p>{PARAGRAPH}</p>" * 3 + "<ul><li><a href=a>First source</a></li><li><a href=b>Second source</a></li></ul>"
    got = main_text(f"<html><body>{menu}<{holder}>{body}</{holder}></body></html>").split("\n")
    assert got == [TITLE, *[PARAGRAPH] * 3, "First source", "Second source"]


def test_short_cells_beside_long_paragraphs_stay():
    long = (SENTENCE * 60).strip()
    got = main_text(f"<body><article><p>{long}</p><table><tbody><tr><td>7</td><td>x</td></tr></tbody></table></article></body>")
    assert got.split("\n") == [long, "7", "x"]
