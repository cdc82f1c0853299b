"""Tables without rules: what is admitted, and near misses."""

from __future__ import annotations

import pytest

from glyphweave.convert import convert_bytes
from glyphweave.operators.borderless import confidence, leader_row, reject_reason
from glyphweave.sources.pdf.synthetic import make_pdf, text_op


def nodes(*ops):
    return convert_bytes(make_pdf([b"\n".join(ops)]))["nodes"]


def grid(rows, xs=(72, 200, 330), bold=True, size=9, top=700):
    return [text_op(x, top - 14 * k, text, "F2" if bold and k == 0 else "F1", size) for k, row in enumerate(rows) for x, text in zip(xs, row, strict=False)]


def tables(*ops):
    found = nodes(*ops)
    cells = {n["node"]: [] for n in found if n["kind"] == "table_row"}
    for n in found:
        if n["kind"] == "table_cell":
            cells[n["parent"]].append(n["text"])
    return [(n["evidence"], n["attrs"]["header_rows"]) for n in found if n["kind"] == "table"], list(cells.values())


ROWS = [("Year", "Sales", "Cost"), ("1", "10", "7"), ("2", "20", "9"), ("3", "31", "12")]


def test_columns_with_a_bold_row():
    assert tables(*grid(ROWS)) == ([(["aligned_columns"], 1)], [list(r) for r in ROWS])
    assert tables(*grid(ROWS, bold=False))[0] == [(["aligned_columns"], 0)]


def test_numbers_set_to_the_right():
    ops = [text_op(72, 700 - 14 * k, name, size=9) for k, name in enumerate(("alpha", "be", "gamma ray"))]
    ops += [text_op(300 - 5.004 * len(n), 700 - 14 * k, n, size=9) for k, n in enumerate(("7", "1200", "31"))]
    assert tables(*ops)[0] == [(["aligned_columns"], 0)]


@pytest.mark.parametrize("rows", [ROWS[:2], [r[: 2 + k % 2] for k, r in enumerate(ROWS)], [("a b c d e f g h i j.", "k l m n o p.")] * 3])
def test_near_misses(rows):
    assert tables(*grid(rows, (60, 330, 480)))[0] == []


def test_ragged_places_are_no_columns():
    assert tables(*[op for k, row in enumerate(ROWS) for op in grid([row], (72 + 11 * k, 220 - 17 * k, 330 + 13 * k), False, top=700 - 14 * k)])[0] == []


def test_keys_with_values():
    rows = [("Name:", "Ada"), ("Born:", "1815")]
    assert tables(*grid(rows, (72, 200), False)) == ([(["key_value_rows"], 0)], [list(r) for r in rows])
    assert tables(*grid([("Name", "Ada"), ("Born", "1815")], (72, 200), False))[0] == []


def test_amounts_after_leaders():
    ops = [text_op(72, 700 - 14 * k, f"{name} {'.' * 12} {amount}", size=9) for k, (name, amount) in enumerate((("Revenue", "1,204.50"), ("Costs", "(310)"), ("Tax", "12%")))]
    assert tables(*ops) == ([(["dot_leader_amounts"], 0)], [["Revenue", "1,204.50"], ["Costs", "(310)"], ["Tax", "12%"]])
    contents = [text_op(72, 700 - 14 * k, f"Part {name} {'.' * 12} {page}", size=9) for k, (name, page) in enumerate((("One", 1), ("Two", 4), ("Three", 9)))]
    assert tables(*contents)[0] == []
    assert leader_row({"text": "plain words 12"}) is None and leader_row({"text": "a ... words"}) is None


def test_reasons():
    assert reject_reason([["a", "b"]] * 2, 10) == "too_few_rows"
    assert reject_reason([["a", "b"], ["a"], ["a", "b"]], 10) == "unstable_column_count"
    assert reject_reason([["", " "]] * 3, 10) == "empty"
    assert reject_reason([["Doe, J. Title", "2001"]] * 3, 10) == "bibliography_pattern"
    assert reject_reason([["one two three four five", "six seven eight nine."]] * 3, 10) == "article_prose"
    assert reject_reason([["a", "b."]] * 3, 600) == "page_spanning_columns"
    assert reject_reason([["one two three four five six seven eight nine", "b"]] * 3, 10) == "wrapped_prose_column"
    assert reject_reason([["a", "b"]] * 3, 10) is None
    assert confidence([["a", "b"]] * 2, 10) == 0.55 and confidence([["a", "b."]] * 3, 600) < confidence([["a", "b"]] * 3, 10)
