"""The Unicode bidirectional algorithm (UAX #9) over one paragraph."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

MAX_DEPTH = 125
BRACKET_STACK = 63
_EMBED = {"RLE": 1, "LRE": 0, "RLO": 1, "LRO": 0}
_OVERRIDE = {"RLO": "R", "LRO": "L"}
_ISOLATE = {"RLI", "LRI", "FSI"}
_REMOVED = {"RLE", "LRE", "RLO", "LRO", "PDF", "BN"}
_NEUTRAL = {"B", "S", "WS", "ON", "LRI", "RLI", "FSI", "PDI"}


@lru_cache(maxsize=4096)
def bidi_class(c: str) -> str:
    """A character's class; unassigned ones by the defaults of their blocks."""
    found = unicodedata.bidirectional(c)
    if found:
        return found
    o = ord(c)
    if 0x0590 <= o <= 0x05FF or 0x07C0 <= o <= 0x085F or 0xFB1D <= o <= 0xFB4F or 0x10800 <= o <= 0x10FFF or 0x1E800 <= o <= 0x1EFFF:
        return "R"
    if 0x0600 <= o <= 0x07BF or 0x0860 <= o <= 0x08FF or 0xFB50 <= o <= 0xFDCF or 0xFDF0 <= o <= 0xFDFF or 0xFE70 <= o <= 0xFEFF:
        return "AL"
    return "L"


@lru_cache(maxsize=4096)
def mirror(c: str) -> str:
    """The mirrored form of a character, told by its name."""
    if not unicodedata.mirrored(c):
        return c
    name = unicodedata.name(c, "")
    for a, b in (("LEFT", "RIGHT"), ("RIGHT", "LEFT"), ("LESS-THAN", "GREATER-THAN"), ("GREATER-THAN", "LESS-THAN"), ("SUBSET", "SUPERSET"), ("SUPERSET", "SUBSET"), ("PRECEDES", "SUCCEEDS"), ("SUCCEEDS", "PRECEDES"), ("ELEMENT OF", "CONTAINS AS MEMBER")):
        if a in name:
            try:
                return unicodedata.lookup(name.replace(a, b, 1))
            except KeyError:
                continue
    return c


@lru_cache(maxsize=4096)
def bracket(c: str) -> tuple[str, str] | None:
    """("o" or "c", the canonical opening bracket) of a paired bracket."""
    if unicodedata.category(c) not in ("Ps", "Pe") or bidi_class(c) != "ON" or mirror(c) == c:
        return None
    opening = unicodedata.category(c) == "Ps"
    return ("o" if opening else "c"), unicodedata.normalize("NFD", c if opening else mirror(c))


def _matching(classes: list[str]) -> dict[int, int]:
    """Isolate initiators and the ends that match them."""
    out, stack = {}, []
    for i, c in enumerate(classes):
        if c in _ISOLATE:
            stack.append(i)
        elif c == "PDI" and stack:
            out[stack.pop()] = i
    return out


def paragraph_level(classes: list[str], start: int = 0, stop: int | None = None) -> int:
    """0 or 1 by the first strong character outside isolates (P2, P3)."""
    matching, i = _matching(classes), start
    stop = len(classes) if stop is None else stop
    while i < stop:
        if classes[i] in ("L", "R", "AL"):
            return int(classes[i] != "L")
        if classes[i] in _ISOLATE:
            i = matching.get(i, stop)
        i += 1
    return 0


@dataclass(frozen=True)
class Resolved:
    base: int
    levels: list[int | None]
    order: list[int]


def resolve(text: str, base: int | None = None) -> Resolved:
    """Levels of each character (None for those removed) and the visual order of the rest."""
    original = [bidi_class(c) for c in text]
    level = paragraph_level(original) if base is None else base
    classes, levels = _explicit(list(original), level)
    for run in _isolating_runs(original, classes, levels, level):
        _weak(run.indices, classes, run.sos)
        _brackets(text, original, run, classes)
        _neutral(run, classes)
        for i in run.indices:
            if levels[i] % 2 == 0:
                levels[i] += {"R": 1, "AN": 2, "EN": 2}.get(classes[i], 0)
            else:
                levels[i] += classes[i] in ("L", "EN", "AN")
    reset = True
    for i in range(len(text) - 1, -1, -1):
        if original[i] in ("B", "S"):
            levels[i], reset = level, True
        elif original[i] in ("WS", "FSI", "LRI", "RLI", "PDI") or original[i] in _REMOVED:
            if reset:
                levels[i] = level
        else:
            reset = False
    shown = [i for i in range(len(text)) if original[i] not in _REMOVED]
    return Resolved(level, [None if original[i] in _REMOVED else levels[i] for i in range(len(text))], _reorder(shown, levels))


def visual(text: str, base: int | None = None) -> str:
    """The text as it is set, mirrored where it runs from right to left, without controls."""
    r = resolve(text, base)
    return "".join(mirror(text[i]) if r.levels[i] % 2 else text[i] for i in r.order if bidi_class(text[i]) not in _ISOLATE and bidi_class(text[i]) != "PDI")


def _explicit(classes: list[str], base: int) -> tuple[list[str], list[int]]:
    """X1 to X8."""
    matching = _matching(classes)
    stack: list[tuple[int, str | None, bool]] = [(base, None, False)]
    overflow_isolates = overflow_embeds = valid = 0
    levels = [base] * len(classes)
    for i, c in enumerate(list(classes)):
        level, override, _ = stack[-1]
        if c in _EMBED:
            levels[i] = level
            new = level + 1 + ((level + 1) % 2 != _EMBED[c])
            if new <= MAX_DEPTH and not overflow_isolates and not overflow_embeds:
                stack.append((new, _OVERRIDE.get(c), False))
            elif not overflow_isolates:
                overflow_embeds += 1
        elif c in _ISOLATE:
            levels[i] = level
            if override:
                classes[i] = override
            rtl = c == "RLI" or c == "FSI" and paragraph_level(classes, i + 1, matching.get(i, len(classes))) == 1
            new = level + 1 + ((level + 1) % 2 != int(rtl))
            if new <= MAX_DEPTH and not overflow_isolates and not overflow_embeds:
                valid += 1
                stack.append((new, None, True))
            else:
                overflow_isolates += 1
        elif c == "PDI":
            if overflow_isolates:
                overflow_isolates -= 1
            elif valid:
                overflow_embeds = 0
                while not stack[-1][2]:
                    stack.pop()
                stack.pop()
                valid -= 1
            levels[i] = stack[-1][0]
            if stack[-1][1]:
                classes[i] = stack[-1][1]
        elif c == "PDF":
            levels[i] = level
            if overflow_isolates:
                pass
            elif overflow_embeds:
                overflow_embeds -= 1
            elif not stack[-1][2] and len(stack) > 1:
                stack.pop()
        elif c == "B":
            levels[i] = base
        else:
            levels[i] = level
            if override and c != "BN":
                classes[i] = override
    return classes, levels


@dataclass
class _Run:
    indices: list[int]
    sos: str
    eos: str
    level: int


def _isolating_runs(original: list[str], classes: list[str], levels: list[int], base: int) -> list[_Run]:
    """X9 and X10."""
    kept = [i for i, c in enumerate(original) if c not in _REMOVED]
    runs: list[list[int]] = []
    for i in kept:
        if runs and levels[runs[-1][-1]] == levels[i]:
            runs[-1].append(i)
        else:
            runs.append([i])
    matching = _matching(original)
    ends = set(matching.values())
    first_of = {r[0]: k for k, r in enumerate(runs)}
    place = {i: k for k, i in enumerate(kept)}
    out = []
    for r in runs:
        if original[r[0]] == "PDI" and r[0] in ends:
            continue
        indices = list(r)
        while original[indices[-1]] in _ISOLATE and indices[-1] in matching and matching[indices[-1]] in first_of:
            indices += runs[first_of[matching[indices[-1]]]]
        level = levels[indices[0]]
        before = place[indices[0]] - 1
        previous = levels[kept[before]] if before >= 0 else base
        last = indices[-1]
        after = place[last] + 1
        following = base if original[last] in _ISOLATE and last not in matching or after >= len(kept) else levels[kept[after]]
        side = lambda x: "R" if x % 2 else "L"
        out.append(_Run(indices, side(max(level, previous)), side(max(level, following)), level))
    return out


def _weak(indices: list[int], t: list[str], sos: str) -> None:
    """W1 to W7."""
    previous, strong = sos, sos
    for i in indices:
        if t[i] == "NSM":
            t[i] = "ON" if previous in _ISOLATE or previous == "PDI" else previous
        previous = t[i]
    for i in indices:
        if t[i] in ("L", "R", "AL"):
            strong = t[i]
        elif t[i] == "EN" and strong == "AL":
            t[i] = "AN"
    for i in indices:
        if t[i] == "AL":
            t[i] = "R"
    for a, i, b in zip(indices, indices[1:], indices[2:], strict=False):
        if t[a] == t[b] and (t[i] == "ES" and t[a] == "EN" or t[i] == "CS" and t[a] in ("EN", "AN")):
            t[i] = t[a]
    k = 0
    while k < len(indices):
        if t[indices[k]] == "ET":
            end = k
            while end < len(indices) and t[indices[end]] == "ET":
                end += 1
            if k and t[indices[k - 1]] == "EN" or end < len(indices) and t[indices[end]] == "EN":
                for i in indices[k:end]:
                    t[i] = "EN"
            k = end
        else:
            k += 1
    strong = sos
    for i in indices:
        if t[i] in ("ES", "ET", "CS"):
            t[i] = "ON"
        if t[i] in ("L", "R"):
            strong = t[i]
        elif t[i] == "EN" and strong == "L":
            t[i] = "L"


def _strong(c: str) -> str | None:
    return "R" if c in ("R", "EN", "AN") else "L" if c == "L" else None


def _brackets(text: str, original: list[str], run: _Run, t: list[str]) -> None:
    """N0."""
    stack: list[tuple[str, int]] = []
    pairs: list[tuple[int, int]] = []
    for k, i in enumerate(run.indices):
        found = bracket(text[i]) if t[i] == "ON" else None
        if found is None:
            continue
        if found[0] == "o":
            if len(stack) == BRACKET_STACK:
                break
            stack.append((found[1], k))
        else:
            at = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == found[1]), None)
            if at is not None:
                pairs.append((stack[at][1], k))
                del stack[at:]
    embedding = "R" if run.level % 2 else "L"
    for a, b in sorted(pairs):
        inside = {s for i in run.indices[a + 1 : b] if (s := _strong(t[i]))}
        if embedding in inside:
            way = embedding
        elif inside:
            other = inside.pop()
            context = next((s for i in reversed(run.indices[:a]) if (s := _strong(t[i]))), run.sos)
            way = other if context == other else embedding
        else:
            continue
        for k in (a, b):
            t[run.indices[k]] = way
            for i in run.indices[k + 1 :]:
                if original[i] != "NSM":
                    break
                t[i] = way


def _neutral(run: _Run, t: list[str]) -> None:
    """N1 and N2."""
    k, n = 0, len(run.indices)
    while k < n:
        if t[run.indices[k]] not in _NEUTRAL:
            k += 1
            continue
        end = k
        while end < n and t[run.indices[end]] in _NEUTRAL:
            end += 1
        before = _strong(t[run.indices[k - 1]]) if k else run.sos
        after = _strong(t[run.indices[end]]) if end < n else run.eos
        way = before if before == after else ("R" if run.level % 2 else "L")
        for i in run.indices[k:end]:
            t[i] = way
        k = end


def _reorder(shown: list[int], levels: list[int]) -> list[int]:
    """L2."""
    order = list(shown)
    if not order:
        return order
    for level in range(max(levels[i] for i in order), 0, -1):
        k = 0
        while k < len(order):
            if levels[order[k]] >= level:
                end = k
                while end < len(order) and levels[order[end]] >= level:
                    end += 1
                order[k:end] = order[k:end][::-1]
                k = end
            else:
                k += 1
    return order


def has_rtl(text: str) -> bool:
    return any(bidi_class(c) in ("R", "AL", "RLE", "RLO", "RLI") for c in text)


def is_rtl(text: str) -> bool:
    """Whether characters from right to left outnumber those from left to right."""
    classes = [bidi_class(c) for c in text]
    return sum(c in ("R", "AL") for c in classes) > classes.count("L")


def check_lines(lines: Iterable[str]) -> list[dict]:
    """What fails of lines of the form code points; paragraph direction (0, 1, or 2 to find it); base level; levels (x for none); visual order."""
    out = []
    for number, line in enumerate(lines, 1):
        if not line.strip() or line.startswith("#"):
            continue
        points, direction, base, levels, order = (part.strip() for part in line.split(";"))
        found = resolve("".join(chr(int(p, 16)) for p in points.split()), None if direction == "2" else int(direction))
        told = {"base": str(found.base), "levels": " ".join("x" if v is None else str(v) for v in found.levels), "order": " ".join(map(str, found.order))}
        wanted = {"base": base, "levels": levels, "order": order}
        what = next((k for k in wanted if wanted[k] != told[k]), None)
        if what:
            out.append({"line": number, "what": what, "wanted": wanted[what], "found": told[what]})
    return out
