"""Content streams: tokens, and their interpretation into glyphs, rules, fills, paths and images."""

from __future__ import annotations

import re
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from .document import Document, Page
from .fonts import Font, load_font
from .lines import Run, run_of
from .objects import CONSTANTS, END, PLAIN, Lexer, Name, Operator, Stream, name_of

FORM_DEPTH = 12
CONTENT_BYTES = 64 << 20
#: Rows of a page beyond which a hostile file is read no further: fixed values. A page that meets one has a warning row.
LIMITS = {"glyphs": 250_000, "segments": 500_000, "fills": 250_000, "paths": 250_000, "images": 50_000}
#: Sizes and spacings for which a font keeps the widths of its bytes.
STEPS = 64
Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
_SHORT_KEYS = {"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "F": "Filter", "DP": "DecodeParms", "IM": "ImageMask", "D": "Decode", "I": "Interpolate", "L": "Length"}
_COMPONENTS = {"G": 1, "DeviceGray": 1, "RGB": 3, "DeviceRGB": 3, "CMYK": 4, "DeviceCMYK": 4}


def multiply(a: Matrix, b: Matrix) -> Matrix:
    """Apply a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def apply(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def box_of(m: Matrix, x0: float, y0: float, x1: float, y1: float) -> tuple[float, float, float, float]:
    """The upright box around a rectangle's image."""
    xs, ys = zip(*(apply(m, x, y) for x in (x0, x1) for y in (y0, y1)), strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def rgb(kind: str, values: list[float]) -> tuple[float, float, float]:
    v = [min(1.0, max(0.0, float(x))) for x in values]
    if kind == "cmyk" and len(v) == 4:
        return tuple(1 - min(1.0, c + v[3]) for c in v[:3])
    if kind == "rgb" and len(v) == 3:
        return tuple(v)
    return (v[0],) * 3 if v else (0.0, 0.0, 0.0)


def tokens(data: bytes, lexer: Lexer | None = None) -> Iterator[tuple[str, list[Any]]]:
    """Operators with their operands; an inline image is one operator, `INLINE`, with attributes and bytes. A lexer that is given stands after each operator when that is."""
    lexer = lexer or Lexer(data, refs=False)
    match, at = PLAIN.match, lexer.at
    operands: list[Any] = []
    while True:
        m = match(data, at)
        if m:  # what most tokens are; Lexer.next reads them so
            at = m.end()
            kind = m.lastindex
            x = m[kind]
            if kind == 2 and x not in CONSTANTS:
                if x == b"BI":
                    lexer.at = at
                    yield "INLINE", list(_inline_image(lexer))
                    at = lexer.at
                else:
                    lexer.at = at
                    yield _word(x), operands
                operands = []
                continue
            operands.append(x if kind == 4 else (float(x) if b"." in x else int(x)) if kind == 1 else CONSTANTS[x] if kind == 2 else name_of(x))
        else:
            lexer.at = at
            x = lexer.next()
            at = lexer.at
            if x is END:
                return
            if isinstance(x, Operator):
                if x == "BI":
                    yield "INLINE", list(_inline_image(lexer))
                    at = lexer.at
                elif x not in ("]", ">>", "}", "{", ")"):
                    yield str(x), operands
                operands = []
                continue
            operands.append(x)
        if len(operands) > 512:
            operands = operands[-64:]


@lru_cache(maxsize=4096)
def _word(raw: bytes) -> str:
    return raw.decode()


def _inline_image(lexer: Lexer) -> tuple[dict[str, Any], bytes]:
    attrs: dict[str, Any] = {}
    while (key := lexer.next()) is not END and key != "ID":
        if isinstance(key, Name):
            attrs[_SHORT_KEYS.get(key, str(key))] = lexer.next()
    data, start = lexer.data, lexer.at + 1
    if isinstance(attrs.get("Length"), int):
        end = start + attrs["Length"]
    elif "Filter" not in attrs:
        parts = 1 if attrs.get("ImageMask") is True else _COMPONENTS.get(str(attrs.get("ColorSpace", "G")), 1)
        bits = 1 if attrs.get("ImageMask") is True else int(attrs.get("BitsPerComponent", 8))
        end = start + (int(attrs.get("Width", 0)) * parts * bits + 7) // 8 * int(attrs.get("Height", 0))
    else:
        end = start
    m = re.compile(rb"[\s]?EI(?=[\s]|\Z)").search(data, min(end, len(data)))
    while m and not _plausible(data[m.end() : m.end() + 40]):
        m = re.compile(rb"\sEI(?=[\s]|\Z)").search(data, m.end())
    stop = m.start() if m else len(data)
    lexer.at = m.end() if m else len(data)
    return attrs, data[start:stop]


def _plausible(tail: bytes) -> bool:
    """Whether bytes after an image's end look like operators."""
    return all(32 <= b < 127 or b in b"\t\n\r\x0c\x00" for b in tail)


@dataclass
class State:
    ctm: Matrix = IDENTITY
    font: Font | None = None
    size: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0
    fill: tuple[float, float, float] = (0.0, 0.0, 0.0)
    stroke: tuple[float, float, float] = (0.0, 0.0, 0.0)
    alpha: float = 1.0
    width: float = 1.0
    clip: tuple[float, float, float, float] | None = None


#: A text object, or a rule on a line of its own, after the blanks before it.
_PIECE = re.compile(
    rb"""[\x00\t\n\x0c\r ]*+(BT[^E<>\[\]{}%\\]{0,500}+(?:E(?!T)[^E<>\[\]{}%\\]{0,500}+){0,20}+ET(?=[\x00\t\n\x0c\r ]|\Z)|[-+.0-9][^\r\n()<>\[\]{}%/]{3,200}+(?<=[ ][SsfF])(?=[\r\n]|\Z))"""
)
#: Operators whose work depends on nothing but operands, state and fonts, and that a piece can be made of.
_WITHIN = frozenset({"BT", "ET", "Tf", "Tr", "Tm", "Td", "TD", "T*", "Tj", "Tc", "Tw", "TL", "Ts", "Tz", "g", "rg", "k", "G", "RG", "K", "w", "m", "l", "c", "v", "y", "h", "re", "S", "s", "f", "F"})
_ENDS = frozenset({"ET", "S", "s", "f", "F"})


@dataclass(slots=True)
class Piece:
    """What a piece of content painted after some state: the run that its glyphs are, or other rows without their place, the fonts it names, and the state after it."""

    run: Run | None
    kind: str
    rows: list[dict[str, Any]]
    fonts: list[tuple[str, Font]]
    after: Known
    tm: Matrix
    tlm: Matrix
    at: tuple[float, float]


@dataclass(slots=True, eq=False)
class Known:
    """A state, and the pieces that were met in it; None for what is no piece."""

    state: State
    pieces: dict[bytes, Piece | None] = field(default_factory=dict)
    #: Text objects of one string, by what stands before and after it.
    frames: dict[tuple[bytes, bytes], Frame] = field(default_factory=dict)


@dataclass(slots=True)
class Frame:
    """A text object with any string: what its glyphs share, the ways on, the place of the string and what holds after it."""

    shown: tuple[dict[int, tuple[str, float, float]], dict[str, Any], float, float, Matrix, float]
    piece: Piece


class Met:
    """Pieces that this process has met, which the files of a task share: so many rows at most, then it begins anew. Where few come again, it isn't asked for a while."""

    ROWS, TRIES, REST = 16_384, 4096, 2048

    def __init__(self) -> None:
        self.known: dict[tuple, Known] = {}
        self.rows = self.tries = self.hits = self.rest = 0

    def state(self, s: State) -> Known:
        key = (s.ctm, id(s.font), s.size, s.char_space, s.word_space, s.scale, s.leading, s.rise, s.mode, s.fill, s.stroke, s.alpha, s.width, s.clip)
        found = self.known.get(key)
        if found is None:
            self._room(1)
            found = self.known[key] = Known(copy(s))
        return found

    def put(self, known: Known, chunk: bytes, piece: Piece | None) -> None:
        self._room(1 + (len(piece.run.glyphs) if piece.run is not None else len(piece.rows)) if piece is not None else 1)
        known.pieces[chunk] = piece

    def _room(self, rows: int) -> None:
        self.rows += rows
        if self.rows > self.ROWS:
            for known in self.known.values():
                known.pieces, known.frames = {}, {}
            self.known, self.rows = {}, rows

    def open(self) -> bool:
        """Whether to look for the pieces of the next content."""
        if self.rest:
            self.rest -= 1
            return False
        if self.tries >= self.TRIES:
            if 3 * self.hits < self.tries:
                self.rest = self.REST
            self.tries = self.hits = 0
        return True


MET = Met()


class Rows:
    """What a page paints, in top-left coordinates, in painting order by seq."""

    def __init__(self, page: int = 1) -> None:
        self.page = page
        #: Runs whose glyphs nobody has asked for, by the seq of their first, and how many glyphs they hold.
        self.runs: list[tuple[int, Run]] = []
        self.in_runs = 0
        self._glyphs: list[dict[str, Any]] = []
        self.segments: list[dict[str, Any]] = []
        self.fills: list[dict[str, Any]] = []
        self.paths: list[dict[str, Any]] = []
        self.images: list[dict[str, Any]] = []

    @property
    def glyphs(self) -> list[dict[str, Any]]:
        if self.runs:
            for seq, run in self.runs:
                self._glyphs += run.at(self.page, seq)
            self.runs, self.in_runs = [], 0
        return self._glyphs

    def plain(self) -> bool:
        """Whether runs are all of its glyphs."""
        return not self._glyphs

    def count(self, kind: str) -> int:
        return len(self._glyphs) + self.in_runs if kind == "glyphs" else len(getattr(self, kind))


class Interpreter:
    def __init__(self, doc: Document, page: Page):
        self.doc, self.page, self.rows = doc, page, Rows(page.number)
        box = doc.numbers(page.attrs.get("CropBox")) or doc.numbers(page.attrs.get("MediaBox")) or [0.0, 0.0, 612.0, 792.0]
        x0, y0, x1, y1 = min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])
        unit = doc.resolve(page.attrs.get("UserUnit"))
        unit = float(unit) if isinstance(unit, (int, float)) and unit > 0 else 1.0
        turn = doc.resolve(page.attrs.get("Rotate"))
        turn = int(turn) % 360 if isinstance(turn, (int, float)) else 0
        w, h = (x1 - x0) * unit, (y1 - y0) * unit
        base = {0: (unit, 0, 0, -unit, -x0 * unit, y1 * unit), 90: (0, unit, unit, 0, -y0 * unit, -x0 * unit), 180: (-unit, 0, 0, unit, x1 * unit, -y0 * unit), 270: (0, -unit, -unit, 0, y1 * unit, x1 * unit)}
        self.base: Matrix = tuple(float(v) for v in base.get(turn, base[0]))
        self.width, self.height = (h, w) if turn in (90, 270) else (w, h)
        self.state, self.saved = State(ctm=self.base), []
        self.tm = self.tlm = IDENTITY
        self.marks: list[dict[str, Any]] = []
        self.path: list[tuple[str, list[tuple[float, float]]]] = []
        self.at = (0.0, 0.0)
        self.clipping = False
        self.seq = 0
        self.fonts: dict[int, Font] = {}
        #: Resources are held with their fonts, so that no others take their id.
        self.named: dict[tuple[int, str], tuple[dict[str, Any], Font]] = {}
        self.truncated: set[str] = set()
        #: How the last plain string was shown.
        self.shown: tuple | None = None

    def run(self) -> Rows:
        contents = self.doc.resolve(self.page.attrs.get("Contents"))
        streams = [contents] if isinstance(contents, Stream) else [self.doc.resolve(c) for c in contents or []] if isinstance(contents, list) else []
        data = b"\n".join(self.doc.bytes_of(s) for s in streams if isinstance(s, Stream))
        if len(data) > CONTENT_BYTES:
            self.doc.warn("CONTENT_TRUNCATED", str(self.page.number))
        self.execute(data[:CONTENT_BYTES], self.doc.dict_of(self.page.attrs.get("Resources")), 0, ())
        return self.rows

    def execute(self, data: bytes, resources: dict[str, Any], depth: int, forms: tuple[int, ...]) -> None:
        lexer = Lexer(data, refs=False)
        ask = MET.open()
        while True:
            if ask:
                self._pieces(data, lexer, resources)
            for op, args in tokens(data, lexer):
                self._try(op, args, resources, depth, forms)
                if ask and op in _ENDS:
                    break
            else:
                return

    def _try(self, op: str, args: list[Any], resources: dict[str, Any], depth: int, forms: tuple[int, ...]) -> None:
        try:
            self._one(op, args, resources, depth, forms)
        except (TypeError, ValueError, IndexError, ArithmeticError, AttributeError) as e:
            self.doc.warn("BAD_OPERATOR", f"{op}: {type(e).__name__}")

    def _pieces(self, data: bytes, lexer: Lexer, resources: dict[str, Any]) -> None:
        """Paint what is made of pieces from where the lexer stands on; those met before in the same state aren't read again."""
        if self.marks or self.path or self.clipping or self.state.font is not None and not self.state.font.shared:
            return
        known, last, rows, number = None, None, self.rows, self.page.number
        match, find = _PIECE.match, data.find
        agreed: dict[str, Font] = {}
        tries = 0
        at = lexer.at
        while True:
            # A piece that is known is told by its line alone; that it is followed by a blank and begins where a token may is all that its place must grant.
            if known is not None and (end := find(b"\n", at + 1)) > 0 and (piece := known.pieces.get(data[at + 1 : end])) is not None and data[at] == 10:
                chunk = None
            else:
                m = match(data, at)
                if m is None:
                    break
                chunk, end = m[1], m.end()
                if known is None:
                    known = MET.state(self.state)
                piece = known.pieces.get(chunk, MET)
            tries += 1
            if piece is MET:
                if last is not None:
                    self._stand(last)
                    last = None
                piece = self._learn(chunk, known, resources)
            else:
                MET.hits += 1
            if piece is None:
                break
            for name, font in piece.fonts:
                if agreed.get(name) is not font:
                    if self._shared(resources, name) is not font:
                        piece = None
                        break
                    agreed[name] = font
            if piece is None:
                break
            seq, run = self.seq, piece.run
            if run is not None:
                if len(rows._glyphs) + rows.in_runs + run.n > LIMITS["glyphs"]:
                    break
                rows.runs.append((seq, run))
                rows.in_runs += run.n
                seq += run.n
            elif piece.rows:
                into = getattr(rows, piece.kind)
                if len(into) + len(piece.rows) > LIMITS[piece.kind]:
                    break
                for row in piece.rows:
                    row = row.copy()
                    row["page"], row["seq"] = number, seq
                    into.append(row)
                    seq += 1
            self.seq, at, last, known = seq, end, piece, piece.after
        lexer.at = at
        MET.tries += tries
        if last is not None:
            self._stand(last)

    def _stand(self, piece: Piece) -> None:
        """Be as after a piece."""
        self.state, self.tm, self.tlm, self.at = copy(piece.after.state), piece.tm, piece.tlm, piece.at

    def _learn(self, chunk: bytes, known: Known, resources: dict[str, Any]) -> Piece | None:
        """Try what a piece that wasn't met before paints, and keep that. None if it is none. All is afterwards as before."""
        head, _, rest = chunk.partition(b"(")
        string, _, tail = rest.partition(b")")
        frame = known.frames.get((head, tail))
        if frame is not None and (piece := self._framed(frame, string)) is not None:
            MET.put(known, chunk, piece)
            return piece
        ops = list(tokens(chunk))
        found = [op for op, _ in ops]
        text = found[:1] == ["BT"]
        if not found or not _WITHIN.issuperset(found) or found[-1] not in _ENDS or text and (found[-1] != "ET" or found.count("BT") > 1) or not text and not {"BT", "Tj", "Td", "TD", "T*", "Tm"}.isdisjoint(found):
            MET.put(known, chunk, None)
            return None
        fonts = {str(args[0]): self._shared(resources, str(args[0])) for op, args in ops if op == "Tf" and args}
        if None in fonts.values():
            return None
        self.shown = None
        before = (self.rows, self.state, self.tm, self.tlm, self.at, self.seq, self.path, self.doc.warnings)
        self.rows, self.state, self.path, self.doc.warnings = Rows(), copy(self.state), [], []
        for op, args in ops:
            self._try(op, args, resources, 0, ())
        rows, state, tm, tlm, at, _, path, warned = self.rows, self.state, self.tm, self.tlm, self.at, self.seq, self.path, self.doc.warnings
        self.rows, self.state, self.tm, self.tlm, self.at, self.seq, self.path, self.doc.warnings = before
        made = [kind for kind in LIMITS if rows.count(kind)]
        run = run_of(rows.glyphs) if made == ["glyphs"] and found.count("Tj") == 1 else None
        if warned or path or len(made) > 1 or made == ["glyphs"] and run is None:
            MET.put(known, chunk, None)
            return None
        piece = Piece(run, made[0] if made else "segments", getattr(rows, made[0]) if made and run is None else [], list(fonts.items()), MET.state(state), tm, tlm, at)
        MET.put(known, chunk, piece)
        if run is not None and self.shown is not None and found[-2:] == ["Tj", "ET"] and tail.split() == [b"Tj", b"ET"] and b"(" not in string:
            known.frames[head, tail] = Frame(self.shown, piece)
        return piece

    def _framed(self, frame: Frame, string: bytes) -> Piece | None:
        """The piece of a frame with another string, None if that isn't as plain."""
        steps, same, a, e, tm, scale = frame.shown
        if b"(" in string or b"\r" in string or not steps.keys() >= set(string):
            return None
        drawn, along = _set(string, steps, same, a, e, 0)
        run = run_of(drawn)
        if run is None:
            return None
        p = frame.piece
        return Piece(run, p.kind, [], p.fonts, p.after, multiply((1, 0, 0, 1, along * scale, 0), tm), p.tlm, p.at)

    def _put(self, kind: str, row: dict[str, Any]) -> None:
        rows = getattr(self.rows, kind)
        if len(rows) >= LIMITS[kind]:
            if kind not in self.truncated:
                self.truncated.add(kind)
                self.doc.warn("PAGE_TRUNCATED", f"{self.page.number} {kind}")
            return
        row["page"], row["seq"] = self.page.number, self.seq
        rows.append(row)
        self.seq += 1

    def _one(self, op: str, args: list[Any], resources: dict[str, Any], depth: int, forms: tuple[int, ...]) -> None:
        s = self.state
        # The commonest come first.
        if op == "Tj":
            self._show(args[0])
        elif op == "Tm":
            self.tm = self.tlm = tuple(map(float, args[:6]))
        elif op == "BT":
            self.tm = self.tlm = IDENTITY
        elif op == "ET":
            pass
        elif op == "Tf":
            s.font, s.size = self._font(resources, args[0]), float(args[1])
        elif op == "Tr":
            s.mode = int(args[0])
        elif op == "q":
            if len(self.saved) < 512:
                self.saved.append(copy(s))
        elif op == "Q":
            if self.saved:
                self.state = self.saved.pop()
        elif op == "cm":
            s.ctm = multiply(tuple(map(float, args[:6])), s.ctm)
        elif op == "w":
            s.width = float(args[0])
        elif op == "gs":
            found = self.doc.dict_of(self.doc.dict_of(resources.get("ExtGState")).get(args[0]))
            if isinstance(alpha := self.doc.resolve(found.get("ca")), (int, float)):
                s.alpha = float(alpha)
            if isinstance(width := self.doc.resolve(found.get("LW")), (int, float)):
                s.width = float(width)
        elif op in ("g", "rg", "k", "sc", "scn"):
            s.fill = self._colour(op, args, s.fill)
        elif op in ("G", "RG", "K", "SC", "SCN"):
            s.stroke = self._colour(op.lower(), args, s.stroke)
        elif op in ("m", "l", "c", "v", "y", "h", "re"):
            self._build(op, [float(a) for a in args])
        elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
            self._paint(op)
        elif op in ("W", "W*"):
            self.clipping = True
        elif op in ("Tc", "Tw", "TL", "Ts"):
            setattr(s, {"Tc": "char_space", "Tw": "word_space", "TL": "leading", "Ts": "rise"}[op], float(args[0]))
        elif op == "Tz":
            s.scale = float(args[0]) / 100
        elif op in ("Td", "TD"):
            if op == "TD":
                s.leading = -float(args[1])
            self._move(float(args[0]), float(args[1]))
        elif op == "T*":
            self._move(0.0, -s.leading)
        elif op == "'":
            self._move(0.0, -s.leading)
            self._show(args[0])
        elif op == '"':
            s.word_space, s.char_space = float(args[0]), float(args[1])
            self._move(0.0, -s.leading)
            self._show(args[2])
        elif op == "TJ":
            for x in args[0]:
                if isinstance(x, bytes):
                    self._show(x)
                elif isinstance(x, (int, float)):
                    self.tm = multiply((1, 0, 0, 1, -x / 1000 * s.size * s.scale, 0), self.tm)
        elif op in ("BMC", "BDC"):
            self.marks.append(self._mark(args, resources))
        elif op == "EMC":
            if self.marks:
                self.marks.pop()
        elif op == "Do":
            self._xobject(str(args[0]), resources, depth, forms)
        elif op == "INLINE":
            self._image("inline", args[0], args[1])

    def _colour(self, op: str, args: list[Any], now: tuple[float, float, float]) -> tuple[float, float, float]:
        values = [a for a in args if isinstance(a, (int, float))]
        kind = {"g": "gray", "rg": "rgb", "k": "cmyk"}.get(op) or {1: "gray", 3: "rgb", 4: "cmyk"}.get(len(values))
        return rgb(kind, values) if kind and values else now

    def _font(self, resources: dict[str, Any], name: str) -> Font | None:
        name = str(name)
        known = self.named.get((id(resources), name))
        if known is not None:
            return known[1]
        raw = self.doc.dict_of(self.doc.dict_of(resources.get("Font")).get(name))
        if not raw:
            return None
        if id(raw) not in self.fonts:
            self.fonts[id(raw)] = load_font(self.doc, raw)
        self.named[id(resources), name] = resources, self.fonts[id(raw)]
        return self.fonts[id(raw)]

    def _shared(self, resources: dict[str, Any], name: str) -> Font | None:
        """A font that all files share, None if it is another or none."""
        try:
            font = self._font(resources, name)
        except (TypeError, ValueError, IndexError, ArithmeticError, AttributeError):
            return None
        return font if font is not None and font.shared else None

    def _mark(self, args: list[Any], resources: dict[str, Any]) -> dict[str, Any]:
        props = args[1] if len(args) > 1 else None
        props = self.doc.dict_of(self.doc.dict_of(resources.get("Properties")).get(str(props))) if isinstance(props, Name) else props
        mark: dict[str, Any] = {"tag": str(args[0]) if args else ""}
        if isinstance(props, dict):
            if isinstance(mcid := self.doc.resolve(props.get("MCID")), int):
                mark["mcid"] = mcid
            if isinstance(text := self.doc.resolve(props.get("ActualText")), bytes):
                mark["actual_text"], mark["used"] = text_string(text), False
        return mark

    # Text.

    def _move(self, x: float, y: float) -> None:
        self.tlm = multiply((1, 0, 0, 1, x, y), self.tlm)
        self.tm = self.tlm

    def _show(self, data: bytes) -> None:
        s = self.state
        if s.font is None or not isinstance(data, bytes):
            return
        marks = self.marks
        replaced = next((m for m in reversed(marks) if "actual_text" in m), None)
        drawn: list[dict[str, Any]] = []
        # All glyphs of a string share one matrix; only the way along it grows.
        m = multiply(multiply((s.scale, 0, 0, 1, 0, s.rise), self.tm), s.ctm)
        a, b, c, d, e, f = m
        low, high, straight = -0.22 * s.size, 0.78 * s.size, b == 0 and c == 0
        same = {
            "size": s.size * (c * c + d * d) ** 0.5, "font": s.font.name, "bold": s.font.bold, "italic": s.font.italic, "mono": s.font.mono, "invisible": s.mode in (3, 7) or s.alpha <= 0.001, "rise": s.rise, "color": list(s.fill),
            "upright": abs(b) <= abs(a), "mcid": next((k["mcid"] for k in reversed(marks) if "mcid" in k), None), "tag": marks[-1]["tag"] if marks else None, "artifact": any(k["tag"] == "Artifact" for k in marks),
        }
        if straight and replaced is None and s.clip is None and (steps := self._steps(data)) is not None:
            self._show_plain(data, steps, {**same, "y0": min(d * low + f, d * high + f), "y1": max(d * low + f, d * high + f)}, a, e)
            return
        along = 0.0
        for code, text, width in s.font.decode(data):
            advance = width / 1000 * s.size
            if not text.isprintable():
                clean = "".join(x for x in text if x >= " " and x != "\x7f")
                if clean != text:
                    self.doc.warn("CONTROL_GLYPH")
                text = clean
            if text:
                if straight:
                    left, right, bottom, top = a * along + e, a * (along + advance) + e, d * low + f, d * high + f
                    x0, x1 = (left, right) if left <= right else (right, left)
                    y0, y1 = (bottom, top) if bottom <= top else (top, bottom)
                else:
                    x0, y0, x1, y1 = box_of(m, along, low, along + advance, high)
                if s.clip is None or not self._clipped(x0, y0, x1, y1):
                    drawn.append({"text": text, "x0": x0, "y0": y0, "x1": x1, "y1": y1, **same})
            along += advance + s.char_space + (s.word_space if code == b" " else 0.0)
        self.tm = multiply((1, 0, 0, 1, along * s.scale, 0), self.tm)
        if replaced is not None and drawn:
            if not replaced["used"]:  # the first run carries the replacement, later runs nothing
                replaced["used"] = True
                box = {k: f(g[k] for g in drawn) for k, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max))}
                self._put("glyphs", {**drawn[0], **box, "text": replaced["actual_text"]})
            return
        for g in drawn:
            self._put("glyphs", g)

    def _steps(self, data: bytes) -> dict[int, tuple[str, float, float]] | None:
        """Text, width and way on of each byte of a string, in the font and spacing that hold; None where a code isn't one byte, or has no text that can be shown as it is."""
        s = self.state
        if s.font.composite:
            return None
        spacing = (s.size, s.char_space, s.word_space)
        if (steps := s.font.steps.get(spacing)) is None:
            if len(s.font.steps) >= STEPS:
                s.font.steps.clear()
            steps = s.font.steps[spacing] = {}
        for b in set(data) - steps.keys():
            ((code, text, width),) = s.font.decode(bytes([b]))
            if not text or not text.isprintable():
                return None
            advance = width / 1000 * s.size
            steps[b] = text, advance, advance + s.char_space + (s.word_space if code == b" " else 0.0)
        return steps

    def _show_plain(self, data: bytes, steps: dict[int, tuple[str, float, float]], same: dict[str, Any], a: float, e: float) -> None:
        """The glyphs of a string on an upright line, none of them clipped or replaced."""
        same["page"] = self.page.number
        drawn, along = _set(data, steps, same, a, e, self.seq)
        self.shown = (steps, same, a, e, self.tm, self.state.scale)
        self.tm = multiply((1, 0, 0, 1, along * self.state.scale, 0), self.tm)
        if len(self.rows.glyphs) + len(drawn) > LIMITS["glyphs"]:
            for g in drawn:
                self._put("glyphs", g)
        else:
            self.rows.glyphs.extend(drawn)
            self.seq += len(drawn)

    def _clipped(self, x0: float, y0: float, x1: float, y1: float) -> bool:
        c = self.state.clip
        return c is not None and (x1 < c[0] or x0 > c[2] or y1 < c[1] or y0 > c[3])

    # Paths.

    def _build(self, op: str, a: list[float]) -> None:
        to = lambda x, y: apply(self.state.ctm, x, y)
        if op == "re":
            x, y, w, h = a[:4]
            self.path.append(("rect", [to(x, y), to(x + w, y), to(x + w, y + h), to(x, y + h)]))
            self.at = (x, y)
        elif op == "m":
            self.path.append(("open", [to(*a[:2])]))
            self.at = (a[0], a[1])
        elif self.path:
            kind, points = self.path[-1]
            if op == "l":
                points.append(to(*a[:2]))
                self.at = (a[0], a[1])
            elif op == "h":
                points.append(points[0])
            else:
                ends = {"c": a[:6], "v": [*self.at, *a[:4]], "y": [*a[:4], *a[2:4]]}[op]
                points += [to(ends[k], ends[k + 1]) for k in (0, 2, 4)]
                self.at = (ends[4], ends[5])
                self.path[-1] = ("curve", points)

    def _paint(self, op: str) -> None:
        s = self.state
        if op in ("s", "b", "b*"):
            for _, points in self.path:
                points.append(points[0])
        scale = abs(s.ctm[0] * s.ctm[3] - s.ctm[1] * s.ctm[2]) ** 0.5
        filled, stroked = op in ("f", "F", "f*", "B", "B*", "b", "b*"), op in ("S", "s", "B", "B*", "b", "b*")
        for kind, points in self.path:
            xs, ys = [p[0] for p in points], [p[1] for p in points]
            box = {"x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys)}
            if filled and kind == "rect":
                thin = min(box["x1"] - box["x0"], box["y1"] - box["y0"])
                if thin <= 2.0 and max(box["x1"] - box["x0"], box["y1"] - box["y0"]) > 4 * max(thin, 0.25):
                    mid = {"x0": box["x0"], "x1": box["x1"], "y0": (box["y0"] + box["y1"]) / 2, "y1": (box["y0"] + box["y1"]) / 2} if box["x1"] - box["x0"] >= box["y1"] - box["y0"] else {"x0": (box["x0"] + box["x1"]) / 2, "x1": (box["x0"] + box["x1"]) / 2, "y0": box["y0"], "y1": box["y1"]}
                    self._put("segments", {**mid, "width": thin, "color": list(s.fill)})
                else:
                    self._put("fills", {**box, "color": list(s.fill)})
            if stroked and kind != "curve":
                ring = [*points, points[0]] if kind == "rect" else points
                for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
                    self._put("segments", {"x0": x0, "y0": y0, "x1": x1, "y1": y1, "width": s.width * scale, "color": list(s.stroke)})
            if kind == "curve" or (filled and kind == "open"):
                self._put("paths", {**box, "curves": sum(1 for _ in points) // 3 if kind == "curve" else 0, "commands": len(points), "color": list(s.fill if filled else s.stroke)})
        if self.clipping and self.path:
            xs = [p[0] for _, pts in self.path for p in pts]
            ys = [p[1] for _, pts in self.path for p in pts]
            new = (min(xs), min(ys), max(xs), max(ys))
            c = s.clip
            s.clip = new if c is None else (max(c[0], new[0]), max(c[1], new[1]), min(c[2], new[2]), min(c[3], new[3]))
        self.clipping, self.path = False, []

    # External objects.

    def _xobject(self, name: str, resources: dict[str, Any], depth: int, forms: tuple[int, ...]) -> None:
        x = self.doc.resolve(self.doc.dict_of(resources.get("XObject")).get(name))
        if not isinstance(x, Stream):
            return
        kind = self.doc.resolve(x.attrs.get("Subtype"))
        if kind == "Image":
            self._image(name, x.attrs, None, x)
        elif kind == "Form":
            if depth >= FORM_DEPTH or id(x) in forms:
                self.doc.warn("FORM_NESTING", name)
                return
            kept, saved, marks, tm = copy(self.state), self.saved, list(self.marks), (self.tm, self.tlm)
            self.saved = []
            m = self.doc.numbers(x.attrs.get("Matrix"))
            if len(m) == 6:
                self.state.ctm = multiply(tuple(m), self.state.ctm)
            bbox = self.doc.numbers(x.attrs.get("BBox"))
            if len(bbox) == 4:
                new, c = box_of(self.state.ctm, *bbox), self.state.clip
                self.state.clip = new if c is None else (max(c[0], new[0]), max(c[1], new[1]), min(c[2], new[2]), min(c[3], new[3]))
            own = self.doc.dict_of(x.attrs.get("Resources"))
            self.execute(self.doc.bytes_of(x), {**resources, **own} if own else resources, depth + 1, (*forms, id(x)))
            self.state, self.saved, self.marks, (self.tm, self.tlm) = kept, saved, marks, tm

    def _image(self, name: str, attrs: dict[str, Any], data: bytes | None, stream: Stream | None = None) -> None:
        import hashlib

        x0, y0, x1, y1 = box_of(self.state.ctm, 0, 0, 1, 1)
        raw = data if data is not None else stream.raw
        size = [self.doc.resolve(attrs.get(k)) for k in ("Width", "Height")]
        self._put("images", {"name": name, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "px_width": size[0], "px_height": size[1], "sha256": hashlib.sha256(raw).hexdigest()})


def _set(data: bytes, steps: dict[int, tuple[str, float, float]], same: dict[str, Any], a: float, e: float, seq: int) -> tuple[list[dict[str, Any]], float]:
    """The glyphs of a string one after the other, and how far they reach."""
    drawn: list[dict[str, Any]] = []
    along = 0.0
    for seq, b in enumerate(data, seq):
        text, advance, step = steps[b]
        left, right = a * along + e, a * (along + advance) + e
        if left > right:
            left, right = right, left
        drawn.append({**same, "text": text, "x0": left, "x1": right, "seq": seq})
        along += step
    return drawn, along


_PDFDOC = {0x18: "˘", 0x19: "ˇ", 0x1A: "ˆ", 0x1B: "˙", 0x1C: "˝", 0x1D: "˛", 0x1E: "˚", 0x1F: "˜", 0x80: "•", 0x81: "†", 0x82: "‡", 0x83: "…", 0x84: "—", 0x85: "–", 0x86: "ƒ", 0x87: "⁄", 0x88: "‹", 0x89: "›", 0x8A: "−", 0x8B: "‰", 0x8C: "„", 0x8D: "“", 0x8E: "”", 0x8F: "‘", 0x90: "’", 0x91: "‚", 0x92: "™", 0x93: "ﬁ", 0x94: "ﬂ", 0x95: "Ł", 0x96: "Œ", 0x97: "Š", 0x98: "Ÿ", 0x99: "Ž", 0x9A: "ı", 0x9B: "ł", 0x9C: "œ", 0x9D: "š", 0x9E: "ž", 0xA0: "€"}


def text_string(data: bytes) -> str:
    """A text string: UTF-16 or UTF-8 by its mark, else the document encoding."""
    if data.startswith(b"\xfe\xff"):
        return data[2:].decode("utf-16-be", "replace")
    if data.startswith(b"\xff\xfe"):
        return data[2:].decode("utf-16-le", "replace")
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "replace")
    return "".join(_PDFDOC.get(b, chr(b)) for b in data)
