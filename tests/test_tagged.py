"""Nodes after their tags."""

from __future__ import annotations

from glyphweave.operators.blocks import Node
from glyphweave.operators.tagged import line_owner, owners, reconcile


def line(seq, *mcids, text="some text"):
    return {"page": 1, "seq": seq, "text": text, "mcids": list(mcids)}


def tag(what, *mcids, role="P", confidence=0.9):
    return {"what": what, "role": role, "confidence": confidence, "mcids": [{"page": 1, "mcid": m} for m in mcids]}


def node(kind, *seqs, text="x"):
    return Node(kind, text, 1, {}, 0.8, [], [f"line-1-{s}" for s in seqs])


def kinds(nodes):
    return [(n.kind, n.text) for n in nodes]


def test_owners():
    owned = owners([tag("paragraph", 1, 2), tag("heading", 2, 3)])
    assert owned == {(1, 1): 0, (1, 3): 1}
    assert line_owner(line(0, 1), owned) == 0 and line_owner(line(0, 1, 3), owned) is None and line_owner(line(0), owned) is None


def test_a_tag_names_a_node_that_it_owns_whole():
    lines = [line(0, 1), line(1, 2)]
    (n,) = reconcile([node("paragraph", 0, 1)], [tag("heading", 1, 2, role="H3")], lines)
    assert (n.kind, n.attrs["level"], n.evidence) == ("heading", 3, ["tagged"]) and n.confidence == 0.9
    (n,) = reconcile([node("paragraph", 0)], [tag("heading", 1, 2, role="H3")], lines)
    assert n.kind == "paragraph"


def test_unsure_tags_and_changes_that_are_not_allowed():
    lines = [line(0, 1)]
    assert kinds(reconcile([node("paragraph", 0)], [tag("heading", 1, confidence=0.3)], lines)) == [("paragraph", "x")]
    assert kinds(reconcile([node("code_block", 0)], [tag("heading", 1)], lines)) == [("code_block", "x")]
    assert kinds(reconcile([node("paragraph", 0)], [], lines)) == [("paragraph", "x")]


def test_paragraphs_of_several_tags_are_parted():
    lines = [line(0, 1, text="Head"), line(1, 2, text="first"), line(2, 2, text="second"), line(3, text="loose")]
    tags = [tag("heading", 1, role="H1"), tag("paragraph", 2)]
    assert kinds(reconcile([node("paragraph", 0, 1, 2)], tags, lines)) == [("heading", "Head"), ("paragraph", "first second")]
    assert kinds(reconcile([node("paragraph", 0, 1, 2, 3)], tags, lines)) == [("paragraph", "x")]


def list_tags(*marks):
    tags = [{"node": 0, "parent": None, "what": "list", "role": "L", "mcids": []}]
    for k, m in enumerate(marks):
        tags += [
            {"node": 2 * k + 1, "parent": 0, "what": "item", "role": "LI", "mcids": []},
            {"node": 2 * k + 2, "parent": 2 * k + 1, "what": "item_body", "role": "LBody", "mcids": [{"page": 1, "mcid": m}]},
        ]
    return tags


def glyphs(*texts):
    out = []
    for m, text in enumerate(texts, 1):
        out += [{"page": 1, "mcid": m, "text": c, "x0": 72.0 + 6 * k, "x1": 77.5 + 6 * k, "y0": 20.0 * m, "y1": 20.0 * m + 9, "size": 10.0, "invisible": False, "artifact": False} for k, c in enumerate(text)]
    return out


def test_tagged_lists_are_made_of_neighbours():
    from glyphweave.operators.tagged import materialise

    lines = [line(0, 1), line(1, 2), line(2, 3)]
    (made, rest) = materialise([node("paragraph", 0), node("paragraph", 1), node("paragraph", 2)], list_tags(1, 2), lines, glyphs("one", "two", "three"))
    assert (made.kind, [c.text for c in made.children], rest.kind) == ("list", ["one", "two"], "paragraph")
    apart = [node("paragraph", 0), node("paragraph", 2), node("paragraph", 1)]
    assert materialise(apart, list_tags(1, 2), lines, glyphs("one", "two", "three")) == apart
    incomplete = [node("paragraph", 0), node("paragraph", 2)]
    assert materialise(incomplete, list_tags(1, 2), lines, glyphs("one", "two", "three")) == incomplete
    mixed = [node("paragraph", 0, 2), node("paragraph", 1)]
    assert materialise(mixed, list_tags(1, 2), lines, glyphs("one", "two", "three")) == mixed
