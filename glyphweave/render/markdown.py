"""Nodes to Markdown."""

from __future__ import annotations

import re
from typing import Any

from ..metrics.tables import node_text
from .html import block as html_block


_SPECIAL = re.compile(r"[\\`*~\[\]<>_]")


def escape(text: str) -> str:
    if not _SPECIAL.search(text):
        return text
    text = text.replace("\\", "\\\\")
    text = re.sub(r"([`*~\[\]<>])", r"\\\1", text)
    return re.sub(r"(?<!\w)_|_(?!\w)", r"\\_", text)


def wrap(mark: str, text: str) -> str:
    """Marks around the text, blanks kept outside them."""
    core = text.strip()
    if not core:
        return text
    lead, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    return f"{lead}{mark}{core}{mark}{tail}"


def fence(text: str) -> str:
    longest = max((len(m) for m in re.findall("`+", text)), default=0)
    return "`" * max(3, longest + 1)


def complex_table(table: dict[str, Any]) -> bool:
    """Whether a table is more than pipes can say: spans, several header rows, row headers or blocks in cells."""
    cells = [c for r in table["children"] if r["kind"] == "table_row" for c in r["children"]]
    spans = any(c["attrs"].get("colspan", 1) > 1 or c["attrs"].get("rowspan", 1) > 1 for c in cells)
    row_headers = any(c["attrs"].get("role") == "th" and c["attrs"].get("row", 0) >= table["attrs"].get("header_rows", 0) for c in cells)
    return spans or row_headers or table["attrs"].get("header_rows", 0) > 1 or any(c.get("children") for c in cells)


def table(node: dict[str, Any]) -> str:
    if complex_table(node):
        return html_block(node)
    rows = [[escape(node_text(c)).replace("|", "\\|").replace("\n", " ") for c in r["children"]] for r in node["children"] if r["kind"] == "table_row"]
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows]
    if not node["attrs"].get("header_rows"):
        rows.insert(0, [""] * width)
    marks = {"left": ":---", "right": "---:", "center": ":---:"}
    rule = [marks.get(a, "---") for a in (node["attrs"].get("alignments") or [""] * width)]
    return "\n".join(f"| {' | '.join(r)} |" for r in (rows[0], rule, *rows[1:]))


def items(node: dict[str, Any], depth: int = 0) -> list[str]:
    out = []
    for k, item in enumerate(node["children"], 1):
        mark = f"{k}." if node["attrs"].get("ordered") else "-"
        task = {True: "[x] ", False: "[ ] "}.get(item["attrs"].get("checked"), "")
        out.append(f"{'    ' * depth}{mark} {task}{escape(item['text'])}")
        for child in item["children"]:
            out += items(child, depth + 1)
    return out


def label(node: dict[str, Any]) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]", "-", node["attrs"].get("anchor") or "note")


def link(node: dict[str, Any]) -> str:
    target = node["attrs"].get("target")
    return f"[{escape(node['text'])}](#{target})" if target else escape(node["text"])


def linked(node: dict[str, Any]) -> str:
    """Escaped text in which citations of notes and pointers to figures lead there."""
    text = escape(node["text"])
    for x in node["attrs"].get("links", []):
        old = escape(x["text"])
        new = f"[^{x['target']}]" if x["target"].startswith(("note-", "reference-")) else f"[{old}](#{x['target']})"
        if x["target"].startswith(("note-", "reference-")):
            text = text.replace(old, old + new, 1) if new not in text and "," in x["text"] else text.replace(old, new, 1)
        elif new not in text:
            text = text.replace(old, new, 1)
    return text


def block(node: dict[str, Any]) -> str:
    kind, text = node["kind"], node["text"]
    if kind in ("artifact", "outline"):
        return ""
    if kind == "heading":
        return f"{'#' * max(1, min(6, node['attrs'].get('level', 1)))} {escape(text)}"
    if kind == "list":
        return "\n".join(items(node))
    if kind == "code_block":
        f = fence(text)
        return f"{f}\n{text}\n{f}"
    if kind == "quote":
        inner = text or "\n\n".join(map(block, node["children"]))
        return "\n".join(f"> {x}" if x else ">" for x in inner.split("\n"))
    if kind == "table":
        return table(node)
    if kind == "image":
        return f"![{escape(node['attrs'].get('alt') or '')}]({node['attrs'].get('name') or ''})"
    if kind == "thematic_break":
        return "---"
    if kind == "toc":
        return "\n".join(f"- {link(c)} {c['attrs']['page_label']}" for c in node["children"])
    if kind in ("note", "reference"):
        return f"[^{label(node)}]: {linked(node)}"
    return wrap("**", escape(text)) if node["attrs"].get("strong") else wrap("*", escape(text)) if kind == "caption" else linked(node)


def render(nodes: list[dict[str, Any]]) -> str:
    """Blocks parted by an empty line."""
    parts = [b for b in map(block, nodes) if b.strip()]
    return "\n\n".join(parts) + "\n" * bool(parts)
