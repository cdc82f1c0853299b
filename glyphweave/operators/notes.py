"""What points where in a document: references, notes, citations, cross-references, contents, outline."""

from __future__ import annotations

from typing import Any

from ..functions.cites import cites
from .blocks import Node

#: Titles of sections, as title_words gives them: references, notes, contents.
SECTIONS = {
    "reference": {"references", "reference list", "bibliography", "literature", "literature cited", "works cited", "quellen", "literaturverzeichnis", "bibliographie", "bibliografía"},
    "note": {"notes", "endnotes", "end notes", "anmerkungen", "notas"},
    "contents": {"contents", "table of contents", "inhalt", "inhaltsverzeichnis", "table des matières", "sommaire", "índice"},
}
#: Marks that stand for a note without a number.
MARKS = "*†‡§¶"
#: Words that point at something, and what they point at.
POINTS_AT = {"figure": "figure", "fig": "figure", "figs": "figure", "table": "table", "tab": "table", "section": "section", "sec": "section", "equation": "equation", "eq": "equation", "appendix": "appendix", "chapter": "section"}
LEADERS = ".·…"
LOOK_AHEAD = 80
#: Shares of equal words from which titles are taken for one, and that of a title that begins another: fixed values.
MATCH, BEGINS = 0.72, 0.95


def title_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() or c == "_" else " " for c in text.casefold()).split()


def section_kind(text: str) -> str | None:
    title = " ".join(title_words(text))
    return next((kind for kind, titles in SECTIONS.items() if title in titles), None)


def leading_label(text: str) -> tuple[str, str] | None:
    """The label at the start of a note or entry, and what follows it: [3] x, 3. x, 3) x, * x."""
    t = text.strip()
    if t[:1] and t[0] in MARKS:
        rest = t[1:].strip()
        return (t[0], rest) if rest else None
    opened = t.startswith("[")
    digits = t[opened:][: next((k for k, c in enumerate(t[opened:]) if not c.isdecimal()), len(t) - opened)]
    rest = t[opened + len(digits) :]
    closed = rest[:1] == "]" if opened else rest[:1] in (".", ")") and rest != ""
    return (digits, rest[1:].strip()) if digits and closed and rest[1:].strip() else None


def cited_labels(text: str) -> list[tuple[str, list[str]]]:
    """Groups of numbers in square brackets that stand apart from words: the group as written, and its labels."""
    out, at = [], 0
    while (lo := text.find("[", at)) >= 0 and (hi := text.find("]", lo)) >= 0:
        labels = [x.strip() for x in text[lo + 1 : hi].replace(";", ",").split(",")]
        apart = not text[lo - 1 : lo].isalnum() and not text[hi + 1 : hi + 2].isalnum()
        if apart and all(x.isdecimal() for x in labels):
            out.append((text[lo : hi + 1], labels))
            at = hi + 1
        else:
            at = lo + 1
    return out


def pointers(text: str) -> list[tuple[str, str, str]]:
    """Words such as Figure with the label after them: as written, what they point at, and the label."""
    words = text.split()
    out = []
    for word, label in zip(words, words[1:], strict=False):
        kind = POINTS_AT.get(word.strip("([.,;").lower())
        name = label.strip("()[]")
        while name and not name[-1].isalnum():
            name = name[:-1]
        if kind and name and (any(c.isdigit() for c in name) or len(name) == 1 and name.isupper()) and all(c.isalnum() or c in ".-" for c in name):
            out.append((f"{word.lstrip('([')} {name}", kind, name.lower()))
    return out


def contents_entry(line: str) -> tuple[str, str] | None:
    """Title and page of a line of contents: leaders of two or more marks, then a number or a roman numeral."""
    t = line.strip()
    k = len(t)
    while k and t[k - 1].isalnum():
        k -= 1
    page, before = t[k:], t[:k]
    title = before.rstrip(LEADERS + " ")
    leaders = before[len(title) :].replace(" ", "")
    numbered = page.isdecimal() or page != "" and set(page.lower()) <= set("ivxlcdm")
    return (title.strip(), page) if title.strip() and numbered and (len(leaders) > 1 or "…" in leaders) else None


def section_after(nodes: list[Node], k: int) -> int:
    """Where the section of the heading at k ends: the next heading of its level or above."""
    level = nodes[k].attrs["level"]
    return next((j for j in range(k + 1, len(nodes)) if nodes[j].kind == "heading" and nodes[j].attrs["level"] <= level), len(nodes))


def mark_references(nodes: list[Node]) -> None:
    """Numbered entries under a heading of references or notes become such if they are two or more, one after the other; references must read like it."""
    for k, n in enumerate(nodes):
        wanted = section_kind(n.text) if n.kind == "heading" else None
        if wanted not in ("reference", "note"):
            continue
        entries = [(x, label, body) for x in _parts(nodes[k + 1 : section_after(nodes, k)]) for label, body in _numbered(x)]
        first = entries[0][1] if entries else 0
        if len(entries) < 2 or [label for _, label, _ in entries] != list(range(first, first + len(entries))):
            continue
        if wanted == "note" or all(cites(body) for _, _, body in entries):
            for node, label, body in entries:
                node.kind, node.text = wanted, body
                node.attrs.update(label=str(label), anchor=f"{wanted}-{label}")
                node.evidence.append(f"{wanted}_section")


def _parts(nodes: list[Node]) -> list[Node]:
    return [x for n in nodes for x in (n.children if n.kind == "list" and n.attrs.get("ordered") else [n])]


def _numbered(node: Node) -> list[tuple[int, str]]:
    """The number of an entry, of a list or of its own, and its text."""
    if node.kind == "item":
        digits = "".join(c for c in node.attrs.get("marker", "") if c.isdecimal())
        return [(int(digits), node.text)] if digits else []
    found = leading_label(node.text) if node.kind == "paragraph" else None
    return [(int(found[0]), found[1])] if found and found[0].isdecimal() else []


def mark_footnotes(nodes: list[Node], sizes: dict[str, tuple[float, float]], body: float) -> None:
    """Small paragraphs or list items with a mark in the lower part of a page become notes. sizes: a line's size and place on its page."""

    def low(n: Node) -> bool:
        held = [sizes[x] for x in n.lines if x in sizes]
        return bool(held) and all(size <= 0.95 * body and place > 0.65 for size, place in held)

    def as_note(node: Node, label: str, text: str) -> Node:
        return Node("note", text, node.page, {"label": label, "anchor": f"note-{node.page}-{label}"}, node.confidence, [*node.evidence, "footnote_geometry"], node.lines)

    out: list[Node] = []
    for n in nodes:
        labels = ["".join(c for c in x.attrs["marker"] if c.isdecimal() or c in MARKS) for x in n.children] if n.kind == "list" else []
        found = leading_label(n.text) if n.kind == "paragraph" else None
        found = found if found and low(n) else None
        if labels and all(labels) and all(low(x) and not x.children for x in n.children):
            out += [as_note(x, label, x.text) for x, label in zip(n.children, labels, strict=True)]
        else:
            out.append(as_note(n, *found) if found else n)
    nodes[:] = out


def link(nodes: list[Node]) -> None:
    """Citations to references and notes, and pointers to captions and numbered headings; what finds nothing stays text."""
    cited = {n.attrs["label"]: n.attrs["anchor"] for n in _walk(nodes) if n.kind in ("reference", "note") and "label" in n.attrs}
    targets: dict[tuple[str, str], str] = {}
    for k, n in enumerate(nodes):
        if n.kind == "caption" and (at := pointers(" ".join(n.text.split()[:2]))):
            _, kind, label = at[0]
            targets.setdefault((kind, label), n.attrs.setdefault("anchor", f"{kind}-{label}"))
        elif n.kind == "heading" and (number := n.text.split(" ")[0].rstrip(".")) and all(x.isdecimal() for x in number.split(".")) and " " in n.text:
            targets.setdefault(("section", number), n.attrs.get("anchor") or f"node-{k}")
    if not cited and not targets:
        return
    for n in _walk(nodes):
        if n.kind not in ("paragraph", "item", "quote", "note"):
            continue
        found = [(written, cited.get(label)) for written, labels in cited_labels(n.text) for label in labels]
        found += [(written, targets.get((kind, label))) for written, kind, label in pointers(n.text)]
        if kept := [{"text": written, "target": target} for written, target in found if target]:
            n.attrs["links"] = kept


def _walk(nodes: list[Node]):
    todo = nodes[::-1]
    while todo:
        n = todo.pop()
        yield n
        todo += n.children[::-1]


def contents(nodes: list[Node], look_ahead: int = LOOK_AHEAD) -> None:
    """Entries with leaders after a heading of contents become one table of contents, each with the heading it names."""
    headings = {" ".join(title_words(n.text)): n for n in nodes if n.kind == "heading"}
    for at in [k for k, n in enumerate(nodes) if n.kind == "heading" and section_kind(n.text) == "contents"][::-1]:
        items: list[Node] = []
        end = at + 1
        while end < min(len(nodes), at + 1 + look_ahead):
            n = nodes[end]
            found = [contents_entry(x) for x in (n.text.split("\n") if n.kind == "code_block" else [n.text])]
            if not any(found) or n.kind == "heading" and not all(found):
                break
            for title, page in filter(None, found):
                target = headings.get(" ".join(title_words(title)))
                items.append(Node("toc_item", title, n.page, {"page_label": page, "target": target.attrs.get("anchor") if target else None}, 0.9, ["dot_leaders"], list(n.lines)))
            end += 1
        if len(items) > 1:
            nodes[at + 1 : end] = [Node("toc", "", nodes[at].page, {}, 0.9, ["contents_heading"], [x for n in nodes[at + 1 : end] for x in n.lines], items)]


def outline_targets(entries: list[dict[str, Any]], nodes: list[Node]) -> list[dict[str, Any]]:
    """The heading that each outline entry names: on its page if it has one, by equal titles or by shared words."""
    out = []
    for e in entries:
        words = title_words(e["title"])
        best: tuple[float, int, Node] | None = None
        for k, n in enumerate(nodes):
            if n.kind != "heading" or e["page"] is not None and n.page != e["page"]:
                continue
            other = title_words(n.text)
            score = 1.0 if words == other else BEGINS if words and other[: len(words)] == words else len(set(words) & set(other)) / max(1, len(set(words) | set(other)))
            if score >= MATCH and (best is None or score > best[0]):
                best = (score, -k, n)
        out.append({**e, "target": best[2].attrs.get("anchor") if best else None, "score": best[0] if best else None})
    return out


def enrich(nodes: list[Node], rows: list[dict[str, Any]], body: float) -> None:
    """All of the above, in the order in which each needs the others."""
    heights = {r["page"]: r["y1"] for r in rows if r["kind"] == "page"}
    sizes = {f"line-{r['page']}-{r['seq']}": (r["size"], r["y0"] / max(heights.get(r["page"], 792.0), 1.0)) for r in rows if r["kind"] == "line"}
    mark_references(nodes)
    mark_footnotes(nodes, sizes, body)
    contents(nodes)
    link(nodes)
