"""What the ratios decide, and pages built to be slow."""

from __future__ import annotations

import time

import pytest

from glyphweave.llm import main_text as mt
from glyphweave.llm.main_text import main_text

SENTENCE = "A sentence that is long enough to weigh, with commas, and with a full stop. "
PARAGRAPH = (SENTENCE * 6).strip()


@pytest.fixture
def given(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]


def test_the_threshold_decides_on_the_given_pages(given):
    """Menus, adverts and footers are there until their paths' scores fall below the threshold."""
    at = main_text
    assert all(len(at(h, 0.0)) > len(at(h)) for h in given)
    assert all(at(h).split("\n")[0] in at(h, 0.0).split("\n")[1:] for h in given)


def test_ratios_alone_leave_menus_out(given, monkeypatch):
    """Without any prior, links and short nodes still fall below the threshold."""
    monkeypatch.setattr(mt, "ARTICLE", 1.0)
    monkeypatch.setattr(mt, "OUTSIDE", 1.0)
    pages = [f"<body><div><ul>{'<li><a href=x>Menu entry</a></li>' * 9}</ul></div><div>{f'<p>{PARAGRAPH}</p>' * n}</div></body>" for n in (1, 3, 9)]
    assert [main_text(h) for h in pages] == ["\n".join([PARAGRAPH] * n) for n in (1, 3, 9)]
    assert all(not main_text(h).startswith(main_text(h, 0.0).split("\n")[0]) for h in given)


def test_a_zone_that_outweighs_its_prior_stays(monkeypatch):
    html = f"<body><p>Hi</p><aside>{f'<p>{PARAGRAPH}</p>' * 4}</aside></body>"
    assert PARAGRAPH in main_text(html)
    monkeypatch.setattr(mt, "OUTSIDE", 0.0)
    assert main_text(html) == "Hi"


def test_text_in_the_middle_of_deep_elements():
    n = 5000
    html = "<div>" * n + f"<article><p>{PARAGRAPH}</p></article>" + "</div>" * n
    assert main_text(html) == PARAGRAPH
    nested = "".join(f"<div>{SENTENCE}" for _ in range(n))
    assert main_text(nested).count("weigh") == n


@pytest.mark.parametrize("part", ['<a "', '<a ">"', "<a '\"", "<!", "<script", "<p", "<div>x, y.", "<span><p>x", "</x>", "<b", "&amp", "<ul><li>x", '<a class="ad" id='])
def test_time_grows_with_length(part):
    def seconds(n):
        start = time.perf_counter()
        main_text(part * n)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(40_000) < 12 * max(seconds(10_000), 0.05)


def test_broken_quotes_lose_no_text():
    assert main_text(f"<article><p>{PARAGRAPH}</p><p>One <a href=\"x>two</a> three.</p></article>") == f"{PARAGRAPH}\nOne two three."
    assert main_text("<p>x <a 'y") == "x <a 'y"
