"""A small Markdown reader that gives HTML, and the choice between projections of a document."""

from __future__ import annotations

import re
from collections import Counter
from html import escape

_LIST = re.compile(r"^( *)(-|\d+\.)\s+(?:\[([ xX])\]\s+)?(.*)$")


def inline(text: str) -> str:
    out = escape(text, quote=False)
    out = re.sub(r"(`+)(.+?)\1", lambda m: f"<code>{m[2]}</code>", out)
    out = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", out)
    out = re.sub(r"(?<!\*)\*([^*]+)\*(?!\*)", r"<em>\1</em>", out)
    out = re.sub(r"\[([^\]]+)\]\(((?:https?:|mailto:|tel:|#)[^)\s]+)\)", r'<a href="\2">\1</a>', out)
    return re.sub(r"\\([\\`*~_\[\]&<>])", r"\1", out)


def cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip()[1:-1])]


def to_html(markdown: str) -> str:
    """Blocks to HTML: headings with ids of their own, nested lists and tasks, pipe tables, quotes, fences, rules, paragraphs."""
    out: list[str] = []
    used: Counter = Counter()
    lines = markdown.replace("\r\n", "\n").split("\n")
    k = 0
    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
        elif m := re.match(r"^(#{1,6})\s+(.*)$", line):
            base = re.sub(r"[^a-z0-9]+", "-", m[2].casefold()).strip("-") or "section"
            used[base] += 1
            anchor = base if used[base] == 1 else f"{base}-{used[base]}"
            out.append(f'<h{len(m[1])} id="{anchor}">{inline(m[2])}</h{len(m[1])}>')
            k += 1
        elif m := re.match(r"^(`{3,}|~{3,})", line):
            end = next((j for j in range(k + 1, len(lines)) if lines[j].startswith(m[1])), len(lines))
            out.append(f"<pre><code>{escape(chr(10).join(lines[k + 1 : end]), quote=False)}</code></pre>")
            k = end + 1
        elif re.fullmatch(r"(?:---+|\*\*\*+|___+)", line.strip()):
            out.append("<hr>")
            k += 1
        elif line.startswith(">"):
            end = k
            while end < len(lines) and lines[end].startswith(">"):
                end += 1
            out.append(f"<blockquote>{to_html(chr(10).join(re.sub(r'^> ?', '', x) for x in lines[k:end]))}</blockquote>")
            k = end
        elif _LIST.match(line):
            end = k
            while end < len(lines) and lines[end].strip() and (_LIST.match(lines[end]) or lines[end].startswith(" ")):
                end += 1
            out.append(_list(lines[k:end]))
            k = end
        elif line.strip().startswith("|") and k + 1 < len(lines) and re.fullmatch(r"\|(?:\s*:?-{3,}:?\s*\|)+", lines[k + 1].strip()):
            end = k + 2
            while end < len(lines) and lines[end].strip().startswith("|"):
                end += 1
            head = "".join(f'<th scope="col">{inline(c)}</th>' for c in cells(line))
            body = "".join(f"<tr>{''.join(f'<td>{inline(c)}</td>' for c in cells(x))}</tr>" for x in lines[k + 2 : end])
            out.append(f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
            k = end
        else:
            end = k
            while end < len(lines) and lines[end].strip() and not re.match(r"^(#{1,6}\s|>|`{3}|~{3})", lines[end]) and not _LIST.match(lines[end]):
                end += 1
            out.append(f"<p>{inline(' '.join(x.strip() for x in lines[k : max(end, k + 1)]))}</p>")
            k = max(end, k + 1)
    return "\n".join(out)


def _list(lines: list[str]) -> str:
    root: list = []
    stack: list[tuple[int, list]] = [(-1, root)]
    for line in lines:
        m = _LIST.match(line)
        if not m:
            if stack[-1][1]:
                stack[-1][1][-1]["text"] += " " + line.strip()
            continue
        depth = len(m[1])
        while len(stack) > 1 and depth < stack[-1][0]:
            stack.pop()
        if depth > stack[-1][0] and stack[-1][1]:
            stack.append((depth, stack[-1][1][-1]["children"]))
        elif stack[-1][0] < 0:
            stack.append((depth, root))
        stack[-1][1].append({"ordered": m[2] != "-", "task": m[3], "text": m[4], "children": []})
    return _items(root)


def _items(items: list) -> str:
    if not items:
        return ""
    tag = "ol" if items[0]["ordered"] else "ul"
    box = lambda i: "" if i["task"] is None else ("☑ " if i["task"] in "xX" else "☐ ")
    return f"<{tag}>{''.join(f'<li>{box(i)}{inline(i["text"])}{_items(i["children"])}</li>' for i in items)}</{tag}>"


def choose(layout: str, semantic: str, tagged: bool, replaced: dict[str, str]) -> str:
    """Which Markdown stands for a document.

    A tagged document is its own structure. Otherwise the layout's Markdown stays, with enriched blocks put in
    the place of theirs: all of them or, if any isn't there exactly once, none.
    """
    if tagged and semantic.strip():
        return semantic
    if any(not old or layout.count(old) != 1 for old in replaced):
        return layout
    for old, new in replaced.items():
        layout = layout.replace(old, new)
    return layout
