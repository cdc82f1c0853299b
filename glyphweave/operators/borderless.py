"""Tables that no rule draws: rows of pieces that stand in columns, keys with values, and labels with amounts at the end of leaders.

A candidate is a run of baselines with as many pieces each. It is admitted by one of the models below, in
their order, and turned down by what speaks for prose, for publications or for the columns of a page.
"""

from __future__ import annotations

import re
from statistics import median
from typing import Any

from .blocks import Node

Line = dict[str, Any]

#: How far apart, at most, baselines of a table lie (in sizes), and pieces of a column start, end or have their middle (in points).
ROW_STEP, SLACK = 2.6, 6.0
FEWEST_ROWS = 3
BOLD_HEADER = 0.65
#: Shares and sizes from which rows are no table: fixed values.
PUBLISHED, SENTENCES, MIDDLE_WORDS, TALL, TALL_SENTENCES, LONG_FIRST, LONG_WORDS = 0.45, 0.60, 8, 500.0, 0.35, 0.50, 8
LEADERS = re.compile(r"(?:\s?[.·…]){3,}")
AMOUNT = re.compile(r"^[-+(]?[$€£]?\s?\d[\d,. ]*\)?%?$")
PUBLICATION = re.compile(r"\b(?:19|20)\d\d\b|https?://|\bdoi\b", re.IGNORECASE)


def baselines(lines: list[Line]) -> list[list[Line]]:
    """Lines of a page by baseline, top to bottom, and from left to right."""
    rows: list[list[Line]] = []
    for x in sorted(lines, key=lambda x: (x["y0"] + x["y1"], x["x0"])):
        middle = (x["y0"] + x["y1"]) / 2
        if rows and abs((rows[-1][0]["y0"] + rows[-1][0]["y1"]) / 2 - middle) <= 0.35 * max(x["size"], rows[-1][0]["size"]):
            rows[-1].append(x)
        else:
            rows.append([x])
    return [sorted(r, key=lambda x: x["x0"]) for r in rows]


def runs(rows: list[list[Line]]) -> list[list[list[Line]]]:
    """Runs of neighbouring baselines with one number of pieces."""
    out: list[list[list[Line]]] = []
    for row in rows:
        last = out[-1][-1] if out else None
        if last and len(last) == len(row) and row[0]["y0"] - last[0]["y0"] <= ROW_STEP * max(row[0]["size"], last[0]["size"]):
            out[-1].append(row)
        else:
            out.append([row])
    return out


def aligned(rows: list[list[Line]]) -> bool:
    """Whether the pieces of every column begin, end or have their middle in one place, and no column reaches into the next."""
    for column in zip(*rows, strict=True):
        places = ([x["x0"] for x in column], [x["x1"] for x in column], [(x["x0"] + x["x1"]) / 2 for x in column])
        if min(max(p) - min(p) for p in places) > SLACK:
            return False
    ends = [max(x["x1"] for x in c) for c in zip(*rows, strict=True)]
    begins = [min(x["x0"] for x in c) for c in zip(*rows, strict=True)]
    return all(a < b for a, b in zip(ends, begins[1:], strict=False))


def reject_reason(rows: list[list[str]], span: float) -> str | None:
    """What speaks against rows of cells being a table."""
    if len(rows) < FEWEST_ROWS:
        return "too_few_rows"
    if len({len(r) for r in rows}) > 1:
        return "unstable_column_count"
    cells = [c for r in rows for c in r]
    if not any(c.strip() for c in cells):
        return "empty"
    whole = [" ".join(r) for r in rows]
    share = lambda hits: sum(hits) / len(rows)
    sentences = share(w.rstrip().endswith((".", "?", "!")) for w in whole)
    if share(bool(PUBLICATION.search(w)) and "," in w for w in whole) >= PUBLISHED:
        return "bibliography_pattern"
    if sentences >= SENTENCES and median(len(w.split()) for w in whole) >= MIDDLE_WORDS:
        return "article_prose"
    if span > TALL and sentences >= TALL_SENTENCES:
        return "page_spanning_columns"
    if share(len(r[0].split()) > LONG_WORDS for r in rows) >= LONG_FIRST:
        return "wrapped_prose_column"
    return None


def confidence(rows: list[list[str]], span: float) -> float:
    """Less for rows that end sentences and for tables as tall as a page."""
    if len(rows) < FEWEST_ROWS:
        return 0.55
    closing = sum(" ".join(r).endswith((".", "?", "!")) for r in rows) / len(rows)
    return max(0.5, min(0.96, 0.92 - min(0.18, 0.25 * closing) - (0.18 if span > TALL else 0.0)))


def leader_row(x: Line) -> list[str] | None:
    """Label and amount of a line with leaders between them."""
    leaders = list(LEADERS.finditer(x["text"]))
    if not leaders:
        return None
    label, amount = x["text"][: leaders[-1].start()].strip(), x["text"][leaders[-1].end() :].strip()
    return [label, amount] if label and AMOUNT.match(amount) else None


def borderless_tables(lines: list[Line]) -> tuple[list[Node], set[int]]:
    """The tables among a page's lines that aren't in ruled ones, and the seqs of their lines."""
    out: list[Node] = []
    used: set[int] = set()
    for run in runs(baselines(lines)):
        texts = [[x["text"] for x in row] for row in run]
        span = run[-1][0]["y1"] - run[0][0]["y0"]
        model = None
        if len(run[0]) == 1:
            amounts = [leader_row(row[0]) for row in run]
            # A run of contents has pages that only ever grow; amounts fall, too, or aren't whole.
            if len(run) >= FEWEST_ROWS and all(amounts) and not _pages([a[1] for a in amounts]):
                model, texts = "dot_leader_amounts", amounts
        elif len(run[0]) == 2 and len(run) >= 2 and all(row[0]["text"].rstrip().endswith(":") for row in run):
            model = "key_value_rows" if aligned(run) else None
        elif reject_reason(texts, span) is None and aligned(run):
            model = "aligned_columns"
        if model is None:
            continue
        bold = sum(x["bold_ratio"] for x in run[0]) / len(run[0]) >= BOLD_HEADER
        header = 1 if model == "aligned_columns" and bold else 0
        keys = model != "aligned_columns"
        rows = [
            Node("table_row", children=[Node("table_cell", text, attrs={"row": r, "col": c, "rowspan": 1, "colspan": 1, "role": "th" if r < header or keys and c == 0 else "td"}) for c, text in enumerate(cells)]) for r, cells in enumerate(texts)
        ]
        box = [min(x["x0"] for row in run for x in row), run[0][0]["y0"], max(x["x1"] for row in run for x in row), run[-1][0]["y1"]]
        ids = [f"line-{x['page']}-{x['seq']}" for row in run for x in row]
        attrs = {"column_count": len(texts[0]), "row_count": len(rows), "header_rows": header, "bbox": box}
        out.append(Node("table", attrs=attrs, confidence=confidence(texts, span), evidence=[model], lines=ids, children=rows))
        used |= {x["seq"] for row in run for x in row}
    return out, used


def _pages(amounts: list[str]) -> bool:
    numbers = [int(a) for a in amounts if a.isdecimal()]
    return len(numbers) == len(amounts) and numbers == sorted(numbers)
