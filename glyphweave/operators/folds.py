"""Operators whose result hangs on the order of what came before, a page or document at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

Box = tuple[float, float, float, float]


def overlap(a: Box, b: Box) -> float:
    """Shared area over the smaller area (areas of at least 1)."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    area = lambda x: max(1.0, (x[2] - x[0]) * (x[3] - x[1]))
    return max(0.0, w) * max(0.0, h) / min(area(a), area(b))


def suppress(boxes: Sequence[Box], limit: float = 0.8) -> list[int]:
    """Places of boxes that overlap no box kept before them."""
    kept: list[int] = []
    for k, box in enumerate(boxes):
        if all(overlap(box, boxes[j]) < limit for j in kept):
            kept.append(k)
    return kept


def centroid_clusters(values: Iterable[float], tolerance: float) -> list[list[float]]:
    """Each value joins the first cluster whose mean so far is near enough."""
    out: list[list[float]] = []
    for v in values:
        found = next((c for c in out if abs(sum(c) / len(c) - v) <= tolerance), None)
        if found is None:
            out.append([v])
        else:
            found.append(v)
    return out


def contiguous_groups(rows: Sequence[tuple[int, Box]], distance: float = 14.0) -> list[list[int]]:
    """Places of rows in order of seq; a group ends where seq jumps or a box lies off the group's box so far."""
    out: list[list[int]] = []
    box: Box | None = None
    for k, (seq, b) in enumerate(rows):
        gap = 0.0 if box is None else (max(0.0, max(box[0], b[0]) - min(box[2], b[2])) ** 2 + max(0.0, max(box[1], b[1]) - min(box[3], b[3])) ** 2) ** 0.5
        if box is None or seq != rows[k - 1][0] + 1 or gap > distance:
            out.append([k])
            box = b
        else:
            out[-1].append(k)
            box = (min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3]))
    return out


def cover(wanted: frozenset, candidates: Sequence[tuple[Any, frozenset]]) -> list[Any] | None:
    """Names of candidates that cover what is wanted: most new first, then fewest extras, then as given. None if they can't."""
    left, out = set(wanted), []
    while left:
        gain = [(len(keys & left), -len(keys - wanted), -k) for k, (_, keys) in enumerate(candidates)]
        best = max(gain, default=(0, 0, 0))
        if not best[0]:
            return None
        name, keys = candidates[-best[2]]
        out.append(name)
        left -= keys
    return out


def place_spans(rows: Sequence[Sequence[tuple[int, int]]]) -> list[list[int]]:
    """Columns of a table's cells, given (rowspan, colspan) in order: places that spans from above hold are passed over."""
    held: dict[int, int] = {}
    out = []
    for spans in rows:
        at, line, new = 0, [], {}
        for down, across in spans:
            while any(held.get(at + k, 0) for k in range(across)):
                at += 1
            line.append(at)
            for k in range(across):
                new[at + k] = down
            at += across
        held = {c: n - 1 for c, n in {**held, **new}.items() if n > 1}
        out.append(line)
    return out


def nest(indents: Sequence[float], tolerance: float) -> list[int]:
    """Depths of list items by a stack of indents; a small drift stays on its level."""
    stack: list[float] = []
    out = []
    for x in indents:
        while len(stack) > 1 and x < stack[-1] - tolerance:
            stack.pop()
        if not stack or x > stack[-1] + tolerance:
            stack.append(x)
        out.append(len(stack) - 1)
    return out


def by_page(df: DataFrame, keys: list[str], fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a fold on each page: rows of one page are bounded by the limits of the reader."""
    return df.groupBy(*keys).applyInPandas(fold, schema)
