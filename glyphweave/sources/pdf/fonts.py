"""Codes of a font to text and widths."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from .document import Document
from .objects import Name, Stream

MAPPED = 65_536
#: Advance widths of the standard fixed and proportional faces, in thousandths, where a font gives none.
FIXED_WIDTH, USUAL_WIDTH = 600.0, 500.0
# Helvetica's widths of the codes 32 to 126: fixed values of the standard metrics.
HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
# Glyph names that aren't spelled by a rule: fixed values of the published glyph list.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?",
    "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "bullet": "•", "endash": "–", "emdash": "—", "ellipsis": "…", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl",
    "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "eth": "ð", "thorn": "þ", "dotlessi": "ı", "Euro": "€", "copyright": "©", "registered": "®", "degree": "°", "section": "§", "dagger": "†", "daggerdbl": "‡", "paragraph": "¶", "periodcentered": "·", "minus": "−", "multiply": "×",
}
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌"}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def glyph_text(name: str) -> str | None:
    """What a glyph's name spells, None if it says nothing."""
    import unicodedata

    name = name.split(".", 1)[0]
    if "_" in name:
        parts = [glyph_text(p) for p in name.split("_")]
        return "".join(parts) if all(parts) else None
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", name):
        units = bytes.fromhex(m[1])
        return units.decode("utf-16-be", "replace")
    if (m := re.fullmatch(r"u([0-9A-F]{4,6})", name)) and int(m[1], 16) < 0x110000:
        return chr(int(m[1], 16))
    for accent, mark in ACCENTS.items():
        if name.endswith(accent) and len(name) == len(accent) + 1:
            return unicodedata.normalize("NFC", name[0] + mark)
    return None


@dataclass
class CMap:
    spaces: list[tuple[int, bytes, bytes]] = field(default_factory=list)
    texts: dict[bytes, str] = field(default_factory=dict)

    def split(self, data: bytes, width: int) -> list[bytes]:
        """Codes of a string: the code space that a prefix falls into, else `width` bytes."""
        out, at = [], 0
        while at < len(data):
            size = next((n for n, lo, hi in self.spaces if all(a <= c <= b for a, c, b in zip(lo, data[at : at + n], hi, strict=False)) and at + n <= len(data)), width)
            out.append(data[at : at + size])
            at += size
        return out


def parse_cmap(data: bytes) -> CMap:
    """Code spaces, bfchar and bfrange of a ToUnicode map; parts that are malformed map nothing."""
    out = CMap()
    hexes = rb"<([0-9A-Fa-f\s]*)>"

    def raw(h: bytes) -> bytes:
        h = re.sub(rb"\s", b"", h)
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())

    def text(b: bytes) -> str:
        return b.decode("utf-16-be", "replace") if len(b) > 1 else b.decode("latin-1")

    for block in re.finditer(rb"begincodespacerange(.*?)endcodespacerange", data, re.DOTALL):
        for lo, hi in re.findall(hexes + rb"\s*" + hexes, block[1]):
            a, b = raw(lo), raw(hi)
            if a and len(a) == len(b):
                out.spaces.append((len(a), a, b))
    out.spaces.sort(key=lambda s: s[0])
    for block in re.finditer(rb"beginbfchar(.*?)endbfchar", data, re.DOTALL):
        for code, target in re.findall(hexes + rb"\s*" + hexes, block[1]):
            if len(out.texts) < MAPPED:
                out.texts[raw(code)] = text(raw(target))
    for block in re.finditer(rb"beginbfrange(.*?)endbfrange", data, re.DOTALL):
        for lo, hi, target, array in re.findall(hexes + rb"\s*" + hexes + rb"\s*(?:" + hexes + rb"|\[(.*?)\])", block[1], re.DOTALL):
            a, b = raw(lo), raw(hi)
            if not a or len(a) != len(b):
                continue
            first, last = int.from_bytes(a, "big"), int.from_bytes(b, "big")
            targets = [raw(x) for x in re.findall(hexes, array)] if array else None
            for k in range(max(0, min(last - first + 1, MAPPED - len(out.texts)))):
                code = (first + k).to_bytes(len(a), "big")
                if targets is not None:
                    if k < len(targets):
                        out.texts[code] = text(targets[k])
                elif (base := raw(target)) and int.from_bytes(base, "big") + k < 1 << (8 * len(base)):
                    out.texts[code] = text((int.from_bytes(base, "big") + k).to_bytes(len(base), "big"))
    return out


@dataclass
class Font:
    name: str
    composite: bool
    to_unicode: CMap | None
    differences: dict[int, str]
    encoding: str
    widths: dict[int, float]
    default_width: float
    mono: bool
    bold: bool
    italic: bool
    #: Whether all files of a task that name this font have this one.
    shared: bool = False
    known: dict[int, tuple[bytes, str, float]] = field(default_factory=dict)
    #: By size and spacing: text, width and way on of each byte met.
    steps: dict[tuple[float, float, float], dict[int, tuple[str, float, float]]] = field(default_factory=dict)

    def decode(self, data: bytes) -> list[tuple[bytes, str, float]]:
        """Code, text and width (in thousandths of the size) of each glyph of a string."""
        if self.composite:
            codes = (self.to_unicode or CMap()).split(data, 2)
            return [(c, (self.to_unicode.texts.get(c, "") if self.to_unicode else ""), self.widths.get(int.from_bytes(c, "big"), self.default_width)) for c in codes]
        for b in set(data) - self.known.keys():
            self.known[b] = bytes([b]), self._simple(b), self.widths.get(b, self.default_width)
        return [self.known[b] for b in data]

    def _simple(self, code: int) -> str:
        if self.to_unicode and (t := self.to_unicode.texts.get(bytes([code]))) is not None:
            return t
        if code in self.differences:
            return glyph_text(self.differences[code]) or "�"
        return bytes([code]).decode(self.encoding, "replace")


def traits(name: str) -> tuple[bool, bool, bool]:
    """Bold, italic and fixed pitch, told by a PostScript name."""
    plain = re.sub(r"^[A-Z]{6}\+", "", name)
    bold = bool(re.search(r"bold|black|heavy|demi|semibold|CMBX|(?<![a-z])medi(?!um)", plain, re.IGNORECASE))
    italic = bool(re.search(r"italic|oblique|slanted|(?<![a-z])ital", plain, re.IGNORECASE))
    mono = bool(re.search(r"mono|courier|consol|typewriter|CMTT|fixed|menlo", plain, re.IGNORECASE))
    return bold, italic, mono


#: Keys of a font that is told by its names alone, so that the files of a task can share it.
_STANDARD = frozenset({"Type", "Subtype", "BaseFont", "Encoding"})


@lru_cache(maxsize=256)
def _standard(name: str, encoding: str | None) -> Font:
    bold, italic, mono = traits(name)
    widths = {} if mono else {32 + k: float(w) for k, w in enumerate(HELVETICA)}
    return Font(name, False, None, {}, "mac_roman" if encoding == "MacRomanEncoding" else "cp1252", widths, FIXED_WIDTH if mono else USUAL_WIDTH, mono, bold, italic, shared=True)


def load_font(doc: Document, attrs: dict[str, Any]) -> Font:
    if attrs.keys() <= _STANDARD and attrs.get("Subtype") != "Type0" and all(isinstance(v, Name) for v in attrs.values()):
        return _standard(str(attrs.get("BaseFont") or ""), attrs.get("Encoding"))
    name = str(doc.resolve(attrs.get("BaseFont")) or "")
    bold, italic, mono = traits(name)
    composite = doc.resolve(attrs.get("Subtype")) == "Type0"
    stream = doc.resolve(attrs.get("ToUnicode"))
    cmap = parse_cmap(doc.bytes_of(stream)) if isinstance(stream, Stream) else None
    widths: dict[int, float] = {}
    default = FIXED_WIDTH if mono else USUAL_WIDTH
    differences: dict[int, str] = {}
    encoding = doc.resolve(attrs.get("Encoding"))
    if composite:
        inner = doc.dict_of((doc.list_of(attrs.get("DescendantFonts")) or [None])[0])
        found = doc.resolve(inner.get("DW"))
        default = float(found) if isinstance(found, (int, float)) else 1000.0
        widths = _composite_widths(doc, inner)
    else:
        first = doc.resolve(attrs.get("FirstChar"))
        for k, w in enumerate(doc.numbers(attrs.get("Widths"))):
            widths[(first if isinstance(first, int) else 0) + k] = w
        if not widths and not mono:
            widths = {32 + k: float(w) for k, w in enumerate(HELVETICA)}
        if isinstance(encoding, dict):
            code = 0
            for x in doc.list_of(encoding.get("Differences")):
                if isinstance(x, int):
                    code = x
                elif isinstance(x, Name):
                    differences[code] = str(x)
                    code += 1
            encoding = doc.resolve(encoding.get("BaseEncoding"))
    codec = "mac_roman" if encoding == "MacRomanEncoding" else "cp1252"
    return Font(name, composite, cmap, differences, codec, widths, default, mono, bold, italic)


def _composite_widths(doc: Document, inner: dict[str, Any]) -> dict[int, float]:
    out: dict[int, float] = {}
    items, at = [doc.resolve(x) for x in doc.list_of(inner.get("W"))], 0
    while at + 1 < len(items):
        first, second = items[at], items[at + 1]
        if isinstance(second, list):
            out.update({first + k: w for k, w in enumerate(doc.numbers(second))})
            at += 2
        elif at + 2 < len(items):
            out.update(dict.fromkeys(range(first, min(second, first + MAPPED) + 1), float(items[at + 2])))
            at += 3
        else:
            break
    return out
