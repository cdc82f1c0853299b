"""Elements of the article whose class or id has a word that names a zone."""

from __future__ import annotations

import pytest

from glyphweave.llm.main_text import main_text

PARAGRAPH = ("A sentence that is long enough to weigh, with commas, and with a full stop. " * 8).strip()
ARTICLE = f"<p>{PARAGRAPH}</p>" * 3


@pytest.mark.parametrize("wrapper", ["class='content has-sidebar'", "id='page' class='layout-no-sidebar'", "class=sidebar"])
@pytest.mark.parametrize("holder", ["article", "main", "div"])
def test_wrappers_of_the_article_stay(wrapper, holder):
    aside = f"<div class=sidebar><p>{PARAGRAPH}</p></div><div id=comments><article><p>{PARAGRAPH}</p></article></div>" if holder != "div" else ""
    assert main_text(f"<body><div {wrapper}><{holder}>{ARTICLE}</{holder}>{aside}</div></body>") == "\n".join([PARAGRAPH] * 3)


@pytest.mark.parametrize("part", ["section id='discussion'", "section id=related-work", "div class='search-methods'"])
def test_parts_of_the_article_stay(part):
    html = f"<body><article>{ARTICLE}<{part}><h2>Head</h2><p>{PARAGRAPH}</p></{part.split()[0]}></article></body>"
    assert main_text(html) == "\n".join([*[PARAGRAPH] * 3, "Head", PARAGRAPH])


@pytest.mark.parametrize("name", ["related-work", "notices"])
def test_headings_stay(name):
    assert main_text(f"<body><article>{ARTICLE}<h2 id={name}>Head</h2><p>{PARAGRAPH}</p></article></body>").split("\n")[3] == "Head"


@pytest.mark.parametrize("name", ["class=ad", "class='ad-container'", "id=comments", "class='cookie-notice'", "class='comment-list'", "class='x share'"])
@pytest.mark.parametrize("inside", [True, False])
def test_zones_go(name, inside):
    zone = f"<div {name}><p>{PARAGRAPH}</p></div>"
    assert main_text(f"<body><article>{ARTICLE}{zone * inside}</article>{zone * (not inside)}</body>") == "\n".join([PARAGRAPH] * 3)


def test_link_lists_in_doubt_go():
    zone = "<section id=related><ul>" + "<li><a href=x>go</a></li>" * 9 + "</ul></section>"
    assert main_text(f"<body><article>{ARTICLE}{zone}</article></body>") == "\n".join([PARAGRAPH] * 3)
