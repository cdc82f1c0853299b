"""What the engine does for a document, counted in calls, which no load on the machine changes."""

from __future__ import annotations

import cProfile
import random

from glyphweave.convert import Options, convert_bytes
from glyphweave.sources.pdf import synthetic


def calls(f) -> int:
    profile = cProfile.Profile()
    profile.runcall(f)
    return sum(x.callcount for x in profile.getstats())


def test_a_conversion_makes_few_calls_a_glyph():
    r = random.Random(3)
    text = "\n".join(" ".join("abcdefgh"[: r.randint(2, 8)] for _ in range(14)) for _ in range(300))
    data = synthetic.text_pdf(text)
    assert calls(lambda: convert_bytes(data, Options(heading_levels="flat"), frozenset({"nodes"}))) < 18 * len(text)


def test_a_conversion_grows_with_its_pages_not_with_their_square():
    import time

    def took(pages: int) -> float:
        data = synthetic.make_pdf([synthetic.text_op(72, 700, f"page {k} has a line of words on it") for k in range(pages)])
        began = time.perf_counter()
        assert convert_bytes(data, outputs=frozenset())["report"]["pages"] == pages
        return time.perf_counter() - began

    took(50)
    assert took(1600) < 9 * took(400)


def test_failures_are_told_without_outputs_that_nobody_reads(spark, tmp_path, monkeypatch):
    from glyphweave.plans import more, queries

    asked = []
    convert = more.convert
    monkeypatch.setattr(more, "convert", lambda files, **how: asked.append(how.get("outputs")) or convert(files, **how))
    spark.createDataFrame([(3, "one line"), (4, "# two\n\nlines"), (5, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["prediction_failures"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.failed for r in found} == {3: True, 4: False, 5: False} and asked == [frozenset()]


def test_only_the_columns_that_are_asked_for_are_made(spark):
    from glyphweave.sources.pdf.reader import parse_table

    made = [synthetic.make_pdf([synthetic.text_op(72, 700, f"a line {k}"), synthetic.rule_op(10, 20, 30, 20)]) for k in range(3)] + [b"no file"]
    files = spark.createDataFrame([(str(k), x) for k, x in enumerate(made)], "path string, content binary").coalesce(1)
    names = ["path", "kind", "page", "x0", "x1"]
    few = parse_table(files, columns=reversed(names))
    assert few.columns == names
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, few.collect())) == sorted(map(key, parse_table(files).select(*names).collect()))


def test_a_row_less_and_a_wider_cell_take_few_calls():
    from glyphweave.metrics import tables

    def tree(rows: int, wide: int) -> dict:
        cell = lambda r, c: {"kind": "table_cell", "text": f"{r * c}", "attrs": {"colspan": wide if (r, c) == (1, 2) else 1}, "children": []}
        return {"kind": "table", "children": [{"kind": "table_row", "children": [cell(r, c) for c in range(3)]} for r in range(rows)]}

    a, b = tree(12, 1), tree(11, 2)
    assert round(tables.teds(a, b), 9) == round(1 - (4 + 1 / 7) / 49, 9)
    assert calls(lambda: tables.teds(a, b)) < 5000
    assert tables.teds({"kind": "table", "children": [{"kind": "table_row", "children": [{"kind": "table_cell", "attrs": {"rowspan": 2.0}}]}]}, {"kind": "table", "children": [{"kind": "table_row", "children": [{"kind": "table_cell", "attrs": {"rowspan": 2}}]}]}) < 1


def test_bounds_of_the_tree_distance_hold_it_and_it_is_unchanged():
    from glyphweave.metrics import tables

    r = random.Random(11)

    def tree(depth: int = 0) -> tuple[str, list]:
        return r.choice(["td:r1:c1:a", "td:r1:c2:a", "td:r1:c1:abc", "tr", "table"]), [tree(depth + 1) for _ in range(r.randint(0, 4 if depth < 2 else 0))]

    def changed(t: tuple[str, list]) -> tuple[str, list]:
        kids = [changed(k) for k in t[1]][r.random() < 0.1 :]
        return (r.choice(["tr", "td:r2:c1:a"]) if r.random() < 0.1 else t[0]), kids[: len(kids) - (r.random() < 0.1)]

    for k in range(400):
        t = tree()
        a, b = tables.flatten(t), tables.flatten(changed(t) if k % 2 else tree())
        whole = tables._weighed(a, b)
        assert tables.least_cost(a, b) <= whole + 1e-9 and min(tables.beside(a, b, 1), tables.beside(a, b, -1)) >= whole - 1e-9
        assert abs(tables.tree_distance(a, b) - whole) < 1e-9


def test_a_sheet_takes_few_calls():
    from glyphweave.plans.documents import order_sheet

    data = order_sheet(7, [("A", "F", str(k)) for k in range(7)])
    made = lambda: convert_bytes(data, outputs=frozenset({"markdown"}))
    assert made()["markdown"].endswith("| A | F | 6 |\n")
    assert calls(made) < 12_000


def test_words_that_look_alike_are_told_apart_in_a_content_stream():
    from glyphweave.sources.pdf.content import tokens

    found = list(tokens(b"true null 1 .5 /N#41 (a\\)b) [1 (x)] <41> << /K 2 >> BDC % c\nq ] 3 Q BI /W 1 /H 1 /CS /G ID \x00 EI 7 w"))
    assert found[:3] == [("BDC", [True, None, 1, 0.5, "NA", b"a)b", [1, b"x"], b"A", {"K": 2}]), ("q", []), ("Q", [3])]
    assert found[3][0] == "INLINE" and found[4] == ("w", [7])
