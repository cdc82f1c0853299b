"""Nodes to HTML, and which HTML is let through."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser
from typing import Any

from ..functions.bidi import has_rtl, is_rtl
from ..metrics.tables import node_text

#: What a page made here needs, by directive: nothing but images beside it or within it. Everything else falls back to none.
NEEDS = {"default-src": "'none'", "img-src": "'self' data:", "form-action": "'none'", "base-uri": "'none'"}
POLICY = "; ".join(f"{directive} {sources}" for directive, sources in NEEDS.items())


def direction(text: str) -> str:
    """The attribute of an element whose text is mostly from right to left."""
    return ' dir="rtl"' if not text.isascii() and has_rtl(text) and is_rtl(text) else ""


def linked(text: str, links: list[dict[str, str]]) -> str:
    """Escaped text in which what points at something is a link to it: each written form once, the first that isn't in another."""
    out, at = [], 0
    places: list[tuple[int, int, str]] = []
    for x in links:
        lo = text.find(x["text"])
        if lo >= 0 and all(lo >= b or lo + len(x["text"]) <= a for a, b, _ in places):
            places.append((lo, lo + len(x["text"]), x["target"]))
    for a, b, target in sorted(places):
        out += [escape(text[at:a]), f'<a href="#{escape(target)}">{escape(text[a:b])}</a>']
        at = b
    return "".join([*out, escape(text[at:])])


def block(node: dict[str, Any]) -> str:
    kind, a = node["kind"], node["attrs"]
    text, way = linked(node["text"], a.get("links") or []), direction(node["text"])
    if kind in ("artifact", "outline"):
        return ""
    if kind == "heading":
        level = max(1, min(6, a.get("level", 1)))
        anchor = f' id="{escape(a["anchor"])}"' if a.get("anchor") else ""
        return f"<h{level}{anchor}{way}>{text}</h{level}>"
    if kind == "list":
        tag = "ol" if a.get("ordered") else "ul"
        return f"<{tag}>{''.join(map(_item, node['children']))}</{tag}>"
    if kind == "code_block":
        return f"<pre><code>{text}</code></pre>"
    if kind == "quote":
        return f"<blockquote>{f'<p>{text}</p>' if text else ''.join(map(block, node['children']))}</blockquote>"
    if kind == "table":
        return table(node)
    if kind == "image":
        return f'<figure><img src="{escape(a.get("name") or "")}" alt="{escape(a.get("alt") or "")}"></figure>'
    if kind == "thematic_break":
        return "<hr>"
    if kind == "toc":
        line = lambda c: f'<a href="#{escape(c["attrs"]["target"])}">{escape(c["text"])}</a>' if c["attrs"].get("target") else escape(c["text"])
        return f"<nav><ol>{''.join(f'<li>{line(c)} {escape(c["attrs"]["page_label"])}</li>' for c in node['children'])}</ol></nav>"
    if kind in ("note", "reference"):
        return f'<p id="{escape(a.get("anchor") or "")}">{escape(a.get("label") or "")} {text}</p>'
    return f"<p{way}><strong>{text}</strong></p>" if a.get("strong") else f"<p{way}>{text}</p>"


def _item(node: dict[str, Any]) -> str:
    box = {True: "☑ ", False: "☐ "}.get(node["attrs"].get("checked"), "")
    return f"<li{direction(node['text'])}>{box}{linked(node['text'], node['attrs'].get('links') or [])}{''.join(map(block, node['children']))}</li>"


def table(node: dict[str, Any]) -> str:
    header = node["attrs"].get("header_rows", 0)
    rows = [r for r in node["children"] if r["kind"] == "table_row"]
    caption = "".join(f"<caption>{escape(node_text(c))}</caption>" for c in node["children"] if c["kind"] == "caption")
    head = "".join(_row(r, True) for r in rows[:header])
    body = "".join(_row(r, False) for r in rows[header:])
    return f"<table>{caption}{f'<thead>{head}</thead>' if head else ''}<tbody>{body}</tbody></table>"


def _row(row: dict[str, Any], header: bool) -> str:
    out = ""
    for c in row["children"]:
        a = c["attrs"]
        spans = "".join(f' {k}="{a[k]}"' for k in ("rowspan", "colspan") if a.get(k, 1) > 1)
        th = header or a.get("role") == "th"
        scope = (" scope=" + ('"colgroup"' if a.get("colspan", 1) > 1 else '"col"') if header else ' scope="row"') if th else ""
        tag = "th" if th else "td"
        out += f"<{tag}{spans}{scope}>{escape(node_text(c))}</{tag}>"
    return f"<tr>{out}</tr>"


def render(nodes: list[dict[str, Any]], title: str = "", lang: str = "") -> str:
    """A whole page without scripts, that loads nothing from elsewhere."""
    body = "\n".join(b for b in map(block, nodes) if b)
    where = f' lang="{escape(lang)}"' if lang else ""
    return f'<!DOCTYPE html>\n<html{where}><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{POLICY}"><title>{escape(title)}</title></head>\n<body>\n{body}\n</body></html>\n'


def minimal(nodes: list[dict[str, Any]]) -> str:
    """Nothing but escaped text, for when all else fails."""
    return "".join(f"<p>{escape(t)}</p>" for n in nodes if (t := node_text(n)))


# What a fragment may hold: elements with their attributes, and which elements they may stand in (none: anywhere).
ALLOWED: dict[str, frozenset[str]] = {
    **dict.fromkeys(("p", "strong", "em", "code", "pre", "ul", "ol", "li", "blockquote", "caption", "thead", "tbody", "tfoot", "tr", "table", "sub", "sup", "br", "hr", "figure", "figcaption"), frozenset()),
    "td": frozenset({"rowspan", "colspan"}), "th": frozenset({"rowspan", "colspan", "scope"}), "a": frozenset({"href"}), "img": frozenset({"src", "alt"}), **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), frozenset({"id"})),
}
VOID = frozenset({"br", "hr", "img"})
PARENTS = {"li": {"ul", "ol"}, "tr": {"table", "thead", "tbody", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "caption": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
NO_TEXT = frozenset({"table", "thead", "tbody", "tfoot", "tr", "ul", "ol"})


class _Gate(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.roots = 0
        self.sound = True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        names = [k for k, _ in attrs]
        self.sound &= tag in ALLOWED and set(names) <= ALLOWED.get(tag, frozenset()) and len(names) == len(set(names))
        self.sound &= tag not in PARENTS or bool(self.stack) and self.stack[-1] in PARENTS[tag]
        for k, v in attrs:
            self.sound &= _value(k, v or "")
        self.roots += not self.stack
        if tag not in VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        self.sound &= bool(self.stack) and self.stack[-1] == tag
        if self.stack:
            self.stack.pop()

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.sound &= bool(self.stack) and self.stack[-1] not in NO_TEXT

    def handle_comment(self, data: str) -> None:
        self.sound = False

    handle_decl = handle_pi = unknown_decl = handle_comment


def _value(key: str, value: str) -> bool:
    import re

    if key in ("rowspan", "colspan"):
        return bool(re.fullmatch(r"[1-9]\d{0,3}", value))
    if key == "scope":
        return value in ("row", "col", "rowgroup", "colgroup")
    if key == "href":
        return bool(re.fullmatch(r"(?:https?:|mailto:|tel:|#)[^\s\x00-\x1f]+", value))
    if key == "src":
        return bool(re.fullmatch(r"(?:data:image/(?:png|jpeg|gif|webp);base64,[A-Za-z0-9+/=]+|[A-Za-z0-9._~@%+-]+(?:/[A-Za-z0-9._~@%+-]+)*)", value)) and ".." not in value.split("/")
    return key != "id" or bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.:-]*", value))


def is_safe(fragment: str) -> bool:
    """Whether a fragment is one closed, well-nested element of the list above."""
    gate = _Gate()
    gate.feed(fragment)
    gate.close()
    return gate.sound and not gate.stack and gate.roots == 1
