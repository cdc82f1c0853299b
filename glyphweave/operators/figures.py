"""Figures that are drawn: diagrams of panels, formulas of curves, printed forms."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from html import escape
from typing import Any

from .blocks import _touching
from .folds import Box, centroid_clusters, contiguous_groups, overlap, suppress

MIN_SIZE, MAX_SHARE, MIN_STROKES = (72.0, 28.0), 0.45, 3
ALT_LENGTH = 240
MATH = frozenset("=+−-×÷∑∏∫√≤≥<>±∞∂")


@dataclass
class Figure:
    box: Box
    kind: str
    runs: list[str] = field(default_factory=list)
    glyphs: set[int] = field(default_factory=set)
    svg: bytes = b""

    @property
    def alt(self) -> str:
        return " · ".join(dict.fromkeys(self.runs))[:ALT_LENGTH]

    @property
    def name(self) -> str:
        return f"{self.kind}-{hashlib.sha256(self.svg).hexdigest()[:16]}.svg"


def box_of(rows: list[dict[str, Any]]) -> Box:
    return (min(min(r["x0"], r["x1"]) for r in rows), min(min(r["y0"], r["y1"]) for r in rows), max(max(r["x0"], r["x1"]) for r in rows), max(max(r["y0"], r["y1"]) for r in rows))


def text_runs(glyphs: list[dict[str, Any]]) -> list[list[dict[str, Any]]]:
    """Glyphs of one baseline, parted at gaps above 8 points and 1.25 sizes."""
    out: list[list[dict[str, Any]]] = []
    for g in sorted(glyphs, key=lambda g: (round(g["y0"], 1), g["x0"], g["seq"])):
        last = out[-1][-1] if out else None
        if last and abs(last["y0"] - g["y0"]) <= 2 and g["x0"] - last["x1"] <= max(8.0, 1.25 * g["size"]):
            out[-1].append(g)
        else:
            out.append([g])
    return out


def capture(figure: Figure, glyphs: list[dict[str, Any]]) -> None:
    """Move runs into a figure if half of their glyphs or more lie in its box."""
    x0, y0, x1, y1 = figure.box
    for run in text_runs(glyphs):
        inside = sum(x0 <= (g["x0"] + g["x1"]) / 2 <= x1 and y0 <= (g["y0"] + g["y1"]) / 2 <= y1 for g in run)
        if 2 * inside >= len(run):
            figure.glyphs |= {g["seq"] for g in run}
            figure.runs.append("".join(g["text"] for g in run).strip())


def diagrams(segments: list[dict[str, Any]], fills: list[dict[str, Any]], glyphs: list[dict[str, Any]], page: tuple[float, float], taken: list[Box] = ()) -> list[Figure]:
    """Connected drawings of one page that are large enough, not too large, and no table."""
    groups = _touching([*segments, *fills])
    boxes, parts = [], []
    for group in groups:
        strokes = [g for g in group if "width" in g]
        box = box_of(group)
        w, h = box[2] - box[0], box[3] - box[1]
        slanted = sum(abs(s["x1"] - s["x0"]) > 1 and abs(s["y1"] - s["y0"]) > 1 for s in strokes)
        panels = len(group) - len(strokes)
        large = w >= MIN_SIZE[0] and h >= MIN_SIZE[1] and w * h <= MAX_SHARE * page[0] * page[1]
        if large and (slanted >= 2 or panels >= 4 and len(strokes) >= 4 or panels >= 1 and w / max(h, 1) >= 1.45 and len(strokes) >= MIN_STROKES):
            boxes.append(box)
            parts.append(group)
    out = []
    for k in suppress(boxes):
        if all(overlap(boxes[k], t) < 0.8 for t in taken):
            figure = Figure(boxes[k], "vector")
            capture(figure, glyphs)
            figure.svg = svg(figure.box, parts[k], [g for g in glyphs if g["seq"] in figure.glyphs])
            out.append(figure)
    return sorted(out, key=lambda f: (f.box[1], f.box[0]))


def formulas(paths: list[dict[str, Any]], glyphs: list[dict[str, Any]]) -> list[Figure]:
    """Groups of curves that are set like text, beside a sign of mathematics."""
    rows = sorted(paths, key=lambda p: p["seq"])
    out = []
    for group in contiguous_groups([(p["seq"], (p["x0"], p["y0"], p["x1"], p["y1"])) for p in rows]):
        part = [rows[k] for k in group]
        box = box_of(part)
        near = [g for g in glyphs if box[0] - 40 <= g["x0"] <= box[2] + 40 and box[1] - 20 <= g["y0"] <= box[3] + 20]
        marked = any(set(g["text"]) & MATH or g.get("tag") == "Formula" for g in near)
        if len(part) >= 3 and sum(p["curves"] for p in part) >= 8 and box[2] - box[0] <= 500 and box[3] - box[1] <= 120 and marked:
            figure = Figure(box, "formula")
            figure.svg = svg(box, part, [])
            out.append(figure)
    return out


def svg(box: Box, parts: list[dict[str, Any]], glyphs: list[dict[str, Any]]) -> bytes:
    """Fills, strokes and outlines by seq, then text by place: the same bytes for the same drawing."""
    x0, y0, x1, y1 = box
    num = lambda v: f"{v:.3f}"
    colour = lambda c: "#%02x%02x%02x" % tuple(round(255 * v) for v in (c or (0, 0, 0)))
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {num(x1 - x0)} {num(y1 - y0)}">']
    rank = lambda r: (2 if "curves" in r else 1 if "width" in r else 0, r["seq"])
    for r in sorted(parts, key=rank):
        a, b, c, d = (num(v - o) for v, o in ((r["x0"], x0), (r["y0"], y0), (r["x1"], x0), (r["y1"], y0)))
        if "width" in r:
            out.append(f'<line x1="{a}" y1="{b}" x2="{c}" y2="{d}" stroke="{colour(r.get("color"))}" stroke-width="{num(max(0.25, r["width"]))}"/>')
        else:
            out.append(f'<rect x="{a}" y="{b}" width="{num(r["x1"] - r["x0"])}" height="{num(r["y1"] - r["y0"])}" fill="{colour(r.get("color"))}"/>')
    for run in text_runs(glyphs):
        g = run[0]
        style = "".join(s for s, on in ((' font-family="monospace"', g.get("mono")), (' font-weight="bold"', g.get("bold")), (' font-style="italic"', g.get("italic"))) if on)
        out.append(f'<text x="{num(g["x0"] - x0)}" y="{num(g["y1"] - y0)}" font-size="{num(g["size"])}"{style}>{escape("".join(x["text"] for x in run))}</text>')
    return ("\n".join([*out, "</svg>"]) + "\n").encode()


def form_columns(boxes: list[Box], tolerance: float = 6.0) -> bool:
    """Whether boxes stand like the fields of a printed form: in one or two columns that hold most of them."""
    if len(boxes) < 4:
        return False
    columns = sorted((len(c) for c in centroid_clusters(sorted(b[0] for b in boxes), tolerance)), reverse=True)
    return columns[0] >= 0.60 * len(boxes) and sum(columns[:2]) >= 0.85 * len(boxes)


def math_ml(glyphs: list[dict[str, Any]]) -> str:
    """One line of glyphs as MathML: raised and lowered small glyphs are scripts of what stands before them."""
    row = sorted(glyphs, key=lambda g: g["x0"])
    if not row:
        return "<math></math>"
    size = max(g["size"] for g in row)
    base = [g for g in row if g["size"] >= 0.9 * size]
    middle = sum((g["y0"] + g["y1"]) / 2 for g in base) / len(base)
    out: list[str] = []
    for g in row:
        t = escape(g["text"].strip())
        tag = "mn" if t.isdigit() else "mi" if t.isalpha() else "mo"
        small = g["size"] < 0.9 * size and out
        if small:
            kind = "msup" if (g["y0"] + g["y1"]) / 2 < middle else "msub"
            out[-1] = f"<{kind}>{out[-1]}<{tag}>{t}</{tag}></{kind}>"
        elif t:
            out.append(f"<{tag}>{t}</{tag}>")
    return f"<math><mrow>{''.join(out)}</mrow></math>"
