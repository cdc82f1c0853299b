"""Pieces of content that were met before: not read again, and painted as if they were."""

from __future__ import annotations

import random

from glyphweave.convert import convert_bytes
from glyphweave.plans.documents import order_sheet
from glyphweave.sources.pdf import content, synthetic
from glyphweave.sources.pdf.reader import parse

from test_engine_cost import calls

WORDS = ["Order", "BT ET", "a(b", "x\\y", "", " ", "  two  words ", "1.", "- item", "Café", "fi\x01x", "Total:", "..... 12"]


def page(r: random.Random) -> bytes:
    """Operators that paint, set the state, or are broken, a few of each."""
    out = []
    for _ in range(r.randint(0, 20)):
        x, y = r.choice([72, 76, 176, 176.4]), r.choice([730, 700, 688, 676.2, 585, 565, 565.05, 60])
        text = synthetic.text_op(x, y, r.choice(WORDS), r.choice(["F1", "F2", "F4", "F9"]), r.choice([10, 10, 12, -10, 0]), r.choice([0, 0, 0, 3]))
        others = [
            b"/Artifact BMC " + text + b" EMC", b"BT\n/F1 11 Tf\n1 0 0 1 %d %d Tm\n(some lines) Tj\nET" % (x, y), b"BT 1 0 0 1 %d %d Tm (the font before) Tj ET" % (x, y), b"BT (unended ET", b"BT /F1 Tf (bad) Tj ET",
            b"BT /F1 9 Tf %d %d Td (a) Tj 0 -12 TD (next) Tj T* (third) Tj ET" % (x, y), b"10 10 m 20 20 l S extra 5\n7 w 10 30 m 50 30 l s", b"72 600 m 372 600 l", b"%d %d 100 20 re f" % (x, y), b"10 10 100 100 re W n",
            *b"q 1 0 0 1 5 5 cm|Q|q|0.5 g|-3 Tc|0 Tc|90 Tz|100 Tz|2 Ts|0 Ts".split(b"|"),
        ]
        out.append(r.choice([text, text, text, synthetic.rule_op(72, y, 372, y), synthetic.rule_op(x, 600, x, 500), r.choice(others)]))
    return b"\n".join(out)


def test_pieces_met_before_paint_what_they_would_paint(monkeypatch):
    r = random.Random(7)
    odd = {"F9": b"<< /Type /Font /Subtype /Type1 /BaseFont /Foo /FirstChar 65 /Widths [300 400 500] >>"}
    files = [synthetic.make_pdf([page(r) for _ in range(r.choice([1, 1, 3]))], fonts=odd if k % 2 else None) for k in range(300)]
    files += [order_sheet(10**k, [("A", "F", str(k * n)) for n in range(k)]) for k in range(9)]
    monkeypatch.setattr(content, "MET", content.Met())
    monkeypatch.setattr(content.Met, "REST", 0)
    held = [(parse(f), convert_bytes(f)) for f in files]
    assert content.MET.hits and content.MET.rows <= content.Met.ROWS
    monkeypatch.setattr(content.Met, "open", lambda self: False)
    assert held == [(parse(f), convert_bytes(f)) for f in files]


def test_a_rule_through_a_run_deals_its_glyphs():
    rules = [synthetic.rule_op(72, y, 372, y) for y in (600, 580, 560)] + [synthetic.rule_op(x, 600, x, 560) for x in (72, 172, 272, 372)]
    data = synthetic.make_pdf([b"\n".join([*rules, synthetic.text_op(160, 585, "through a rule"), synthetic.text_op(76, 565, "a")])])
    table = next(n for n in convert_bytes(data)["nodes"] if n["kind"] == "table")
    cells = [n["text"] for n in convert_bytes(data)["nodes"] if n["kind"] == "table_cell"]
    assert table["attrs"]["column_count"] == 3 and "".join(cells[:3]).replace(" ", "") == "througharule" and cells[0] and cells[1] and cells[3] == "a"


def test_a_sheet_like_the_last_takes_few_calls():
    made = lambda k: convert_bytes(order_sheet(k, [("A", "F", str(n)) for n in range(7)]), outputs=frozenset({"markdown"}))["markdown"]
    assert made(12).startswith("# Order 12\n")
    assert calls(lambda: made(34)) < 4000 and made(34).startswith("# Order 34\n")


def test_sheets_are_made_and_converted_in_one_step(spark, tmp_path):
    from glyphweave.plans import queries

    rows = [(7, 2, "N", "O", 3.0), (7, 1, "A", "F", 17.0), (7, 2, "B", "O", 5.0), (9, 4, "R", "F", 50.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = queries()["converted_sheets"](spark, str(tmp_path))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    found = {r.table_id: r.markdown.split("\n")[-4:] for r in made.collect()}
    assert found == {7: ["| --- | --- | --- |", "| A | F | 17 |", "| B | O | 3 |", ""], 9: ["| Flag | Status | Qty |", "| --- | --- | --- |", "| R | F | 50 |", ""]}
