"""Tags of a document against what its geometry says: who owns a line, and which of the two names its kind."""

from __future__ import annotations

from typing import Any

from ..sources.pdf.lines import join, visible
from .admission import CHANGES
from .blocks import Node, join_lines

ENOUGH, MOST = 0.55, 0.97
Key = tuple[int, int]


def owners(tags: list[dict[str, Any]]) -> dict[Key, int]:
    """The one tag that owns each piece of marked content, by page and mark; what two tags claim is nobody's."""
    out: dict[Key, int] = {}
    twice: set[Key] = set()
    for k, t in enumerate(tags):
        for m in t["mcids"]:
            key = (m["page"], m["mcid"])
            twice |= {key} if key in out else set()
            out[key] = k
    return {key: k for key, k in out.items() if key not in twice}


def line_owner(line: dict[str, Any], owned: dict[Key, int]) -> int | None:
    """The tag that owns all marks of a line, if one does."""
    found = {owned.get((line["page"], m)) for m in line["mcids"]}
    return found.pop() if len(found) == 1 else None


def reconcile(nodes: list[Node], tags: list[dict[str, Any]], lines: list[dict[str, Any]]) -> list[Node]:
    """Nodes after their tags.

    A paragraph whose lines belong to several tags is parted at their borders. A node whose lines are just
    those of one tag takes its kind, if that change is allowed and the tag sure enough; else it stays as it is.
    """
    owned = owners(tags)
    by_id = {f"line-{x['page']}-{x['seq']}": x for x in lines}
    of_tag: dict[int, set[str]] = {}
    owner = {name: line_owner(x, owned) for name, x in by_id.items()}
    for name, k in owner.items():
        if k is not None:
            of_tag.setdefault(k, set()).add(name)
    out: list[Node] = []
    for n in nodes:
        held = [owner.get(name) for name in n.lines]
        if n.kind == "paragraph" and len(set(held)) > 1 and None not in held:
            out += [_renamed(part, tags, owner, of_tag) for part in _parted(n, held, by_id)]
        else:
            out.append(_renamed(n, tags, owner, of_tag))
    return out


def mark_texts(glyphs: list[dict[str, Any]]) -> dict[Key, str]:
    """The text of each piece of marked content: glyphs by baseline, then from left to right."""
    held: dict[Key, list[dict[str, Any]]] = {}
    for g in visible(glyphs):
        if g["mcid"] is not None:
            held.setdefault((g["page"], g["mcid"]), []).append(g)
    out = {}
    for key, found in held.items():
        rows: dict[int, list[dict[str, Any]]] = {}
        for g in found:
            rows.setdefault(round(g["y0"]), []).append(g)
        out[key] = " ".join(join(sorted(row, key=lambda g: g["x0"])).strip() for _, row in sorted(rows.items()))
    return out


class Tree:
    """Tags by their parents, and what is marked under each."""

    def __init__(self, tags: list[dict[str, Any]], texts: dict[Key, str]):
        self.tags, self.texts = tags, texts
        self.under: dict[int | None, list[dict[str, Any]]] = {}
        for t in tags:
            self.under.setdefault(t["parent"], []).append(t)

    def kids(self, tag: dict[str, Any], *kinds: str) -> list[dict[str, Any]]:
        """Tags of some kinds below a tag, through sections of tables and the like, in order."""
        out: list[dict[str, Any]] = []
        for t in self.under.get(tag["node"], []):
            out += [t] if t["what"] in kinds else self.kids(t, *kinds) if t["what"] not in ("list", "table") else []
        return out

    def keys(self, tag: dict[str, Any], without: tuple[str, ...] = ()) -> list[Key]:
        out = [(m["page"], m["mcid"]) for m in tag["mcids"]]
        for t in self.under.get(tag["node"], []):
            out += self.keys(t, without) if t["what"] not in without else []
        return out

    def text(self, tag: dict[str, Any], without: tuple[str, ...] = ()) -> str:
        return " ".join(x for k in self.keys(tag, without) if (x := self.texts.get(k, "")))

    def as_list(self, tag: dict[str, Any]) -> Node:
        items = []
        for t in self.kids(tag, "item"):
            marker = " ".join(self.text(x) for x in self.kids(t, "label"))
            item = Node("item", self.text(t, ("label", "list", "table")), attrs={"ordered": any(c.isdigit() for c in marker), "marker": marker or "•"}, confidence=0.95)
            item.children = [self.as_list(x) for x in self.kids(t, "list")]
            items.append(item)
        return Node("list", attrs={"ordered": bool(items) and all(i.attrs["ordered"] for i in items)}, confidence=0.95, evidence=["tagged"], children=items)

    def as_table(self, tag: dict[str, Any]) -> Node:
        rows = []
        for r, row in enumerate(self.kids(tag, "table_row")):
            cells = [Node("table_cell", self.text(c), attrs={"row": r, "col": k, "rowspan": 1, "colspan": 1, "role": "th" if c["role"] == "TH" else "td"}) for k, c in enumerate(self.kids(row, "table_cell"))]
            rows.append(Node("table_row", children=cells))
        header = next((k for k, row in enumerate(rows) if any(c.attrs["role"] != "th" for c in row.children)), len(rows))
        return Node("table", attrs={"column_count": max((len(r.children) for r in rows), default=0), "row_count": len(rows), "header_rows": min(header, 1)}, confidence=0.95, evidence=["tagged"], children=rows)


def materialise(nodes: list[Node], tags: list[dict[str, Any]], lines: list[dict[str, Any]], glyphs: list[dict[str, Any]]) -> list[Node]:
    """Tagged lists and tables in the place of the nodes that their marks cover.

    Their nodes must be neighbours and hold all that is marked under the tag and nothing else; otherwise
    they stay as they are.
    """
    tree = Tree(tags, mark_texts(glyphs))
    marks = {f"line-{x['page']}-{x['seq']}": {(x["page"], m) for m in x["mcids"]} for x in lines}
    kinds = {t["node"]: (t["what"], t["parent"]) for t in tags}

    def within(tag: dict[str, Any]) -> bool:
        up = tag["parent"]
        while up is not None:
            what, up = kinds[up]
            if what in ("list", "table"):
                return True
        return False

    for tag in tags:
        if tag["what"] not in ("list", "table") or within(tag):
            continue
        keys = set(tree.keys(tag))
        held = [set().union(*(marks.get(name, set()) for name in n.lines)) for n in nodes]
        covered = [k for k, (n, m) in enumerate(zip(nodes, held, strict=True)) if n.lines and m and all(marks.get(x) for x in n.lines) and m <= keys]
        if not covered or covered != list(range(covered[0], covered[-1] + 1)) or set().union(*(held[k] for k in covered)) != keys:
            continue
        made = tree.as_list(tag) if tag["what"] == "list" else tree.as_table(tag)
        if made.children:
            made.page, made.lines = nodes[covered[0]].page, [x for k in covered for x in nodes[k].lines]
            nodes = [*nodes[: covered[0]], made, *nodes[covered[-1] + 1 :]]
    return nodes


def _parted(n: Node, held: list[int | None], by_id: dict[str, dict[str, Any]]) -> list[Node]:
    out: list[Node] = []
    for k, (name, tag) in enumerate(zip(n.lines, held, strict=True)):
        if k and held[k - 1] == tag:
            out[-1].lines.append(name)
        else:
            out.append(Node(n.kind, "", n.page, dict(n.attrs), n.confidence, [*n.evidence], [name]))
    for part in out:
        part.text = join_lines([by_id[name]["text"] for name in part.lines])
    return out


def _renamed(n: Node, tags: list[dict[str, Any]], owner: dict[str, int | None], of_tag: dict[int, set[str]]) -> Node:
    held = {owner.get(name) for name in n.lines}
    k = held.pop() if len(held) == 1 else None
    if k is None or of_tag[k] != set(n.lines):
        return n
    kind, sure = tags[k]["what"], float(tags[k].get("confidence") or 0.0)
    if kind == n.kind or (n.kind, kind) in CHANGES and sure >= ENOUGH:
        if kind != n.kind:
            n.kind = kind
            n.attrs.pop("strong", None)
            if kind == "heading":
                role = str(tags[k].get("role") or "")
                n.attrs["level"] = int(role[1:]) if role[:1] == "H" and role[1:] in tuple("123456") else 1
            else:
                n.attrs.pop("level", None)
        n.confidence = min(MOST, max(n.confidence, sure))
        n.evidence.append("tagged")
    return n
