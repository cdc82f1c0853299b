"""Glyphs to lines of text."""

from __future__ import annotations

from dataclasses import dataclass
from operator import itemgetter, lt, sub
from typing import Any

from .fonts import LIGATURES

_LEFT, _PLACE, _FIRST = itemgetter("x0"), itemgetter("x0", "seq"), itemgetter(0)

#: A gap above this share of the size is a space, and one above this many sizes parts two lines.
WORD_GAP = 0.22
LINE_GAP = 3.0


def _no_space(c: str) -> bool:
    """Whether a character's script is written without spaces."""
    o = ord(c)
    return 0x0E00 <= o <= 0x0EFF or 0x3040 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF


def visible(glyphs: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Glyphs that are seen and mean something; of those drawn twice on one spot (to a tenth of a point), the first."""
    out: list[dict[str, Any]] = []
    seen: set[tuple[str, int, int, int]] = set()
    last_y = last_size = None
    y = z = 0
    for g in glyphs:
        if g["invisible"] or g["artifact"]:
            continue
        y0, size = g["y0"], g["size"]
        if y0 != last_y or size != last_size:  # glyphs of a string share both
            last_y, last_size, y, z = y0, size, int(10 * y0 + 0.5), int(10 * size + 0.5)
        seen.add((g["text"], int(10 * g["x0"] + 0.5), y, z))
        if len(seen) > len(out):
            out.append(g)
    return out


@dataclass(slots=True)
class Run:
    """Glyphs of one string that stand one after the other, all seen, with no gutter and no two in a place; `line` is the line that they make if no others join them, None if they are blank."""

    glyphs: list[dict[str, Any]]
    n: int
    top: float
    bottom: float
    size: float
    left: float
    last: float
    right: float
    height: tuple[int, int]
    first_place: int
    last_place: int
    #: The least and the greatest middle of a glyph, and how many are bold.
    middles: tuple[float, float]
    bold: int
    line: dict[str, Any] | None

    def at(self, page: int, seq: int) -> list[dict[str, Any]]:
        """Its glyphs on a page, numbered from seq."""
        out = []
        for g in self.glyphs:
            g = g.copy()
            g["page"], g["seq"] = page, seq
            out.append(g)
            seq += 1
        return out


def run_of(glyphs: list[dict[str, Any]]) -> Run | None:
    """The run that the glyphs of a string are, None if they aren't as plain as that."""
    if not glyphs or any([g["invisible"] or g["artifact"] for g in glyphs]):
        return None
    first, last = glyphs[0], glyphs[-1]
    top, bottom, size = first["y0"], first["y1"], first["size"]
    lefts, places = [g["x0"] for g in glyphs], [int(10 * g["x0"] + 0.5) for g in glyphs]
    if not size >= 0 or not all(map(lt, lefts, lefts[1:])) or not all(map(lt, places, places[1:])):
        return None
    if any([gap > LINE_GAP * size for gap in map(sub, lefts[1:], [g["x1"] for g in glyphs])]) or any([(g["y0"], g["y1"], g["size"]) != (top, bottom, size) for g in glyphs]):
        return None
    made, middles = _line(glyphs, 0), [(g["x0"] + g["x1"]) / 2 for g in glyphs]
    return Run(glyphs, len(glyphs), top, bottom, size, first["x0"], last["x0"], last["x1"], (int(10 * top + 0.5), int(10 * size + 0.5)), places[0], places[-1], (min(middles), max(middles)), sum([bool(g["bold"]) for g in glyphs]), made)


def lines(glyphs: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Lines of a page by baseline, top to bottom: text, box, size, style shares and glyph numbers."""
    rows: list[list[dict[str, Any]]] = []
    heads: list[tuple[float, float, float, float]] = []  # of each row's first glyph: top, bottom, middle, size
    heights: dict[int, list[dict[str, Any]]] = {}
    last = None
    band: list[dict[str, Any]] = []
    for g in visible(glyphs):
        if (at := g["y0"] + g["y1"]) != last:
            last, band = at, heights.setdefault(int(5 * at + 0.5), [])
        band.append(g)
    for height in sorted(heights):
        heights[height].sort(key=_LEFT)
        was: tuple[float, float, float] | None = None
        row: list[dict[str, Any]] = []
        for g in heights[height]:
            now = (g["y0"], g["y1"], g["size"])
            if now == was:  # as its neighbour, so it goes where that went
                row.append(g)
                continue
            top, bottom, size = now
            was = now if size >= 0 else None
            middle = (top + bottom) / 2
            for k in range(len(rows) - 1, max(-1, len(rows) - 7), -1):
                head = heads[k]
                if head[0] <= middle <= head[1] and abs(head[2] - middle) <= 0.35 * (head[3] if head[3] > size else size):
                    row = rows[k]
                    row.append(g)
                    break
            else:
                row = [g]
                rows.append(row)
                heads.append((top, bottom, middle, size))
    out = []
    for row in _parted(rows):
        if (line := _line(row, len(out))) is not None:
            out.append(line)
    return out


def _line(row: list[dict[str, Any]], seq: int) -> dict[str, Any] | None:
    """The line of glyphs from left to right, None if it is blank."""
    text = join(row).strip()
    if not text:
        return None
    n = len(row)
    mcids = {g["mcid"] for g in row}
    mcids.discard(None)
    return {
        "page": row[0]["page"], "seq": seq, "text": text, "x0": row[0]["x0"], "y0": min([g["y0"] for g in row]), "x1": max([g["x1"] for g in row]), "y1": max([g["y1"] for g in row]),
        "size": sum([g["size"] for g in row]) / n, "bold_ratio": sum([g["bold"] for g in row]) / n, "mono_ratio": sum([g["mono"] for g in row]) / n, "glyphs": [g["seq"] for g in row],
        "mcids": sorted(mcids),
    }


def lines_of_runs(page: int, runs: list[tuple[int, Run]]) -> list[dict[str, Any]] | None:
    """As `lines` of the glyphs of runs, by the seq of their first: where no run reaches into another, the glyphs of one go the same way. None if some do."""
    levels: dict[tuple[float, float, float], list[tuple[float, int, Run]]] = {}
    for start, run in runs:
        levels.setdefault((run.top, run.bottom, run.size), []).append((run.left, start, run))
    bands: dict[int, tuple[float, float, float]] = {}
    places = set()
    for level, of_level in levels.items():
        bands[int(5 * (level[0] + level[1]) + 0.5)] = level
        places.add(of_level[0][2].height)
        if len(of_level) > 1:
            of_level.sort(key=_FIRST)
            if any([a[2].last >= b[0] or a[2].last_place >= b[2].first_place for a, b in zip(of_level, of_level[1:])]):  # noqa: B905
                return None
    if not len(levels) == len(bands) == len(places):
        return None  # some are so near to each other that their glyphs have to be looked at
    rows: list[list[tuple[float, int, Run]]] = []
    heads: list[tuple[float, float, float, float]] = []
    for band in sorted(bands):
        top, bottom, size = level = bands[band]
        middle = (top + bottom) / 2
        for k in range(len(rows) - 1, max(-1, len(rows) - 7), -1):
            head = heads[k]
            if head[0] <= middle <= head[1] and abs(head[2] - middle) <= 0.35 * (head[3] if head[3] > size else size):
                rows[k] = sorted(rows[k] + levels[level], key=_FIRST)
                break
        else:
            rows.append(levels[level])
            heads.append((top, bottom, middle, size))
    out: list[dict[str, Any]] = []
    for row in rows:
        parts = [row]
        if len(row) > 1:
            parts = [[row[0]]]
            for a, b in zip(row, row[1:]):  # noqa: B905
                if a[2].last >= b[0]:
                    return None
                gap = b[0] - a[2].right
                if gap > LINE_GAP * b[2].size and gap > LINE_GAP * a[2].size:
                    parts.append([b])
                else:
                    parts[-1].append(b)
        for part in parts:
            _, start, run = part[0]
            if len(part) > 1:
                line = _line([g for _, k, r in part for g in r.at(page, k)], len(out))
            elif run.line is None:
                continue
            else:
                line = run.line.copy()
                line["page"], line["seq"], line["glyphs"], line["mcids"] = page, len(out), list(range(start, start + run.n)), []
            if line is not None:
                out.append(line)
    return out


def _parted(rows: list[list[dict[str, Any]]]) -> list[list[dict[str, Any]]]:
    """Glyphs of one baseline from left to right, parted where the gap is a gutter."""
    out = []
    for row in rows:
        lefts = [g["x0"] for g in row]
        if not all(map(lt, lefts, lefts[1:])):
            row.sort(key=_PLACE)
            lefts = [g["x0"] for g in row]
        sizes = [g["size"] for g in row]
        start = 0
        for k, gap in enumerate(map(sub, lefts[1:], [g["x1"] for g in row]), 1):
            if gap > LINE_GAP * sizes[k] and gap > LINE_GAP * sizes[k - 1]:
                out.append(row[start:k])
                start = k
        out.append(row[start:])
    return out


def join(row: list[dict[str, Any]]) -> str:
    """Text of glyphs from left to right, a space where the gap is wide enough to be one."""
    out: list[str] = []
    end, right, before = "", 0.0, 0.0
    for g in row:
        text, size = g["text"], g["size"]
        if text in LIGATURES:
            text = LIGATURES[text]
        if end and end != " " and text[:1] != " ":
            gap = g["x0"] - right
            if gap > WORD_GAP * (size if size > before else before) and not (text and _no_space(end) and _no_space(text[0])):
                out.append(" ")
                end = " "
        if text:
            out.append(text)
            end = text[-1]
        right, before = g["x1"], size
    return "".join(out)
