"""The objects of a PDF file: cross-references, object streams, recovery, pages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from .filters import decode
from .objects import END, Lexer, Name, Operator, PdfError, Ref, Stream

PAGES = 50_000
PAGE_DEPTH = 256
OBJECTS = 1_000_000
STREAM_OBJECTS = 250_000
TOTAL_BYTES = 1 << 30
SCAN_BYTES = 64 << 20
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate", "UserUnit")

_OBJ = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj\b")
_END_STREAM = re.compile(rb"\r?\n?endstream\b")


#: Entries of a cross-reference table as they are nearly always written, after the blanks before them.
_ENTRIES = re.compile(rb"[\x00\t\n\x0c\r ]*+((?:\d{10} \d{5} [nf](?: \r| \n|\r\n)){1,4096}+)")
#: An object that is a dictionary without strings, comments or streams, and small.
_OBJECT = re.compile(rb"(\d{1,9})[\x00\t\n\x0c\r ]+\d{1,5}[\x00\t\n\x0c\r ]+obj[\x00\t\n\x0c\r ]*+(<<[^()%]{0,1000}?>>)[\x00\t\n\x0c\r ]*+endobj(?=[\x00\t\n\x0c\r ])")


def _entries(lexer: Lexer, first: int, count: int) -> list[tuple[int, tuple]] | None:
    """Entries of a cross-reference table's section if all are written as usual, each on 20 bytes."""
    m = _ENTRIES.match(lexer.data, lexer.at)
    if m is None or count < 1 or len(m[1]) < 20 * count:
        return None
    lexer.at = m.start(1) + 20 * count
    words = m[1][: 20 * count].split()
    return [(num, ("at", int(at), int(gen)) if kind == b"n" else ("free",)) for num, at, gen, kind in zip(range(first, first + count), words[::3], words[1::3], words[2::3], strict=True)]


@lru_cache(maxsize=1024)
def _small(text: bytes) -> dict[str, Any] | None:
    """The dictionary that a text is, for all files that hold it; nobody changes it. None if it is more or less than one."""
    lexer = Lexer(text)
    value = lexer.next()
    return value if isinstance(value, dict) and lexer.at == len(text) else None


_FLAT = re.compile(rb"[\x00\t\n\x0c\r ]*+(<<[^()<>%]{0,1000}+>>)")


def _next(lexer: Lexer) -> Any:
    """The next object; a small dictionary without others within is shared."""
    if (m := _FLAT.match(lexer.data, lexer.at)) and (known := _small(m[1])) is not None:
        lexer.at = m.end()
        return known
    return lexer.next()


@dataclass
class Page:
    number: int
    ref: Ref | None
    attrs: dict[str, Any]


@dataclass
class Document:
    data: bytes
    warnings: list[str] = field(default_factory=list)
    trailer: dict[str, Any] = field(default_factory=dict)
    places: dict[int, tuple] = field(default_factory=dict)
    cache: dict[int, Any] = field(default_factory=dict)
    decoded_bytes: int = 0
    all_pages: list[Page] | None = None

    def __post_init__(self) -> None:
        head = self.data.rfind(b"startxref")
        start = re.match(rb"startxref\s+(\d+)", self.data[head : head + 40]) if head >= 0 else None
        try:
            if start is None:
                raise PdfError("startxref is missing")
            self._revisions(int(start[1]))
            if not isinstance(self.resolve(self.trailer.get("Root")), dict):
                raise PdfError("the trailer has no root")
        except (PdfError, ValueError, IndexError, RecursionError) as e:
            self.warn("XREF_RECOVERED", str(e))
            self._recover()
        if "Encrypt" in self.trailer:
            raise PdfError("encrypted files are not read")

    def warn(self, code: str, detail: str = "") -> None:
        text = f"{code}: {detail}" if detail else code
        if text not in self.warnings:
            self.warnings.append(text)

    # Cross-references. A newer revision decides for an object's number, whether it lives or is free.

    def _revisions(self, start: int) -> None:
        seen: set[int] = set()
        todo = [start]
        while todo:
            at = todo.pop(0)
            if at in seen:
                self.warn("XREF_PREV_CYCLE", str(at))
                break
            seen.add(at)
            entries, trailer = self._section(at)
            if isinstance(hybrid := trailer.get("XRefStm"), int):
                entries = {**entries, **self._section(hybrid)[0]}
            for num, place in entries.items():
                self.places.setdefault(num, place)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            if isinstance(previous := trailer.get("Prev"), int):
                todo.append(previous)

    def _section(self, at: int) -> tuple[dict[int, tuple], dict[str, Any]]:
        lexer = Lexer(self.data, at)
        first = lexer.next()
        if isinstance(first, Operator) and first == "xref":
            return self._table(lexer)
        _, value = self.object_at(at)
        if not isinstance(value, Stream):
            raise PdfError("a cross-reference is neither table nor stream")
        return self._xref_stream(value), value.attrs

    def _table(self, lexer: Lexer) -> tuple[dict[int, tuple], dict[str, Any]]:
        entries: dict[int, tuple] = {}
        while True:
            first = lexer.next()
            if isinstance(first, Operator) and first == "trailer":
                trailer = _next(lexer)
                return entries, trailer if isinstance(trailer, dict) else {}
            count = lexer.next()
            if not isinstance(first, int) or not isinstance(count, int) or count > OBJECTS:
                raise PdfError("a cross-reference table is malformed")
            known = _entries(lexer, first, count)
            for num in () if known else range(first, first + count):
                offset, gen, kind = lexer.next(), lexer.next(), lexer.next()
                if kind == "n":
                    entries.setdefault(num, ("at", offset, gen))
                elif kind == "f":
                    entries.setdefault(num, ("free",))
                else:
                    raise PdfError("a cross-reference entry is malformed")
            for num, place in known or ():
                entries.setdefault(num, place)

    def _xref_stream(self, stream: Stream) -> dict[int, tuple]:
        widths = [int(w) for w in stream.attrs.get("W", [1, 2, 1])]
        index = stream.attrs.get("Index") or [0, stream.attrs.get("Size", 0)]
        body, at, out = self.bytes_of(stream), 0, {}
        for first, count in zip(index[::2], index[1::2], strict=False):
            for num in range(first, first + min(count, OBJECTS)):
                fields = []
                for k, w in enumerate(widths):
                    fields.append(int.from_bytes(body[at : at + w], "big") if w else (1, 0, 0)[k])
                    at += w
                if at > len(body):
                    break
                kind = fields[0]
                out.setdefault(num, ("free",) if kind == 0 else ("at", fields[1], fields[2]) if kind == 1 else ("in", fields[1], fields[2]))
        return out

    def _recover(self) -> None:
        """Objects found by their headers, streams skipped so that none is made up from payload."""
        self.places.clear()
        self.cache.clear()
        at, trailer = 0, {}
        while m := _OBJ.search(self.data, at):
            self.places[int(m[1])] = ("at", m.start(), int(m[2]))
            at = m.end()
            try:
                _, value = self.object_at(m.start())
            except (PdfError, ValueError):
                continue
            if isinstance(value, Stream):
                at = max(at, self.data.find(value.raw, m.end()) + len(value.raw)) if value.raw else at
                if value.attrs.get("Type") == "XRef":
                    trailer.update({k: v for k, v in value.attrs.items() if k in ("Root", "Info", "Encrypt")})
                elif value.attrs.get("Type") == "ObjStm":
                    for index, num in enumerate(self._members(value)):
                        self.places.setdefault(num, ("in", int(m[1]), index))
            elif isinstance(value, dict) and value.get("Type") == "Catalog":
                trailer.setdefault("Root", Ref(int(m[1]), int(m[2])))
        for m in re.finditer(rb"\btrailer\b", self.data):
            value = Lexer(self.data, m.end()).next()
            if isinstance(value, dict):
                trailer.update(value)
        self.trailer = trailer

    # Objects.

    def object_at(self, at: int) -> tuple[int, Any]:
        if (m := _OBJECT.match(self.data, at)) and (known := _small(m[2])) is not None:
            return int(m[1]), known
        lexer = Lexer(self.data, at)
        num, gen, word = lexer.next(), lexer.next(), lexer.next()
        if not (isinstance(num, int) and isinstance(gen, int) and word == "obj"):
            raise PdfError(f"no object starts at {at}")
        value = _next(lexer)
        if isinstance(value, dict):
            after = lexer.at
            if lexer.next() == "stream":
                return num, Stream(value, self._payload(value, lexer.at))
            lexer.at = after
        return num, None if value is END or isinstance(value, Operator) else value

    def _payload(self, attrs: dict[str, Any], at: int) -> bytes:
        data = self.data
        at += 2 if data.startswith(b"\r\n", at) else data[at : at + 1] in (b"\n", b"\r")
        length = self.resolve(attrs.get("Length"))
        if isinstance(length, int) and 0 <= length <= len(data) - at and re.match(rb"\s*endstream\b", data[at + length : at + length + 24]):
            return data[at : at + length]
        self.warn("BAD_STREAM_LENGTH")
        ends = list(_END_STREAM.finditer(data, at, min(len(data), at + SCAN_BYTES)))
        best = next((m for m in ends if re.match(rb"\s*endobj\b", data[m.end() : m.end() + 24])), ends[0] if ends else None)
        if best is None:
            self.warn("MISSING_ENDSTREAM")
            return data[at:]
        return data[at : best.start()]

    def _members(self, stream: Stream) -> list[int]:
        count = min(int(stream.attrs.get("N", 0)), STREAM_OBJECTS)
        lexer = Lexer(self.bytes_of(stream))
        numbers = [lexer.next() for _ in range(2 * count)]
        return [n for n in numbers[::2] if isinstance(n, int)]

    def _member(self, holder: int, index: int, num: int) -> Any:
        stream = self.get(holder)
        if not isinstance(stream, Stream):
            return None
        body = self.bytes_of(stream)
        lexer = Lexer(body)
        pairs = [(lexer.next(), lexer.next()) for _ in range(min(int(stream.attrs.get("N", 0)), STREAM_OBJECTS))]
        if index >= len(pairs) or pairs[index][0] != num:
            index = next((k for k, p in enumerate(pairs) if p[0] == num), -1)
            if index < 0:
                return None
        return Lexer(body, int(stream.attrs.get("First", 0)) + pairs[index][1]).next()

    def get(self, num: int) -> Any:
        if num in self.cache:
            return self.cache[num]
        self.cache[num] = None  # an object that needs itself is null
        place, value = self.places.get(num), None
        if place and place[0] == "at":
            try:
                found, value = self.object_at(place[1])
                if found != num:
                    raise PdfError("another object stands there")
            except (PdfError, ValueError):
                self.warn("BAD_OBJECT", str(num))
                value = self._search(num)
        elif place and place[0] == "in":
            value = self._member(place[1], place[2], num)
        self.cache[num] = value
        return value

    def _search(self, num: int) -> Any:
        found = None
        for m in re.finditer(rb"(?<![0-9])%d[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+obj\b" % num, self.data):
            found = m.start()
        return self.object_at(found)[1] if found is not None else None

    def resolve(self, value: Any) -> Any:
        if not isinstance(value, Ref):
            return value
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.get(value.num)
        return None

    def dict_of(self, value: Any) -> dict[str, Any]:
        value = self.resolve(value)
        return value.attrs if isinstance(value, Stream) else value if isinstance(value, dict) else {}

    def list_of(self, value: Any) -> list:
        value = self.resolve(value)
        return value if isinstance(value, list) else []

    def numbers(self, value: Any) -> list[float]:
        out = [self.resolve(x) for x in self.list_of(value)]
        return [float(x) for x in out if isinstance(x, (int, float)) and not isinstance(x, bool)]

    def bytes_of(self, stream: Stream) -> bytes:
        if stream.decoded is None:
            names = self.resolve(stream.attrs.get("Filter", stream.attrs.get("F")))
            names = [names] if isinstance(names, Name) else [self.resolve(n) for n in names or []]
            parms = self.resolve(stream.attrs.get("DecodeParms", stream.attrs.get("DP")))
            parms = [parms] if isinstance(parms, dict) else [self.dict_of(p) for p in parms or []]
            parms = [{k: self.resolve(v) for k, v in p.items()} for p in parms]
            stream.decoded, warnings = decode(stream.raw, [str(n) for n in names if n], parms)
            self.decoded_bytes += len(stream.decoded)
            for w in warnings:
                self.warn(w)
            if self.decoded_bytes > TOTAL_BYTES:
                raise PdfError("the file decodes to too much")
        return stream.decoded

    # Pages.

    def catalog(self) -> dict[str, Any]:
        return self.dict_of(self.trailer.get("Root"))

    def pages(self, wanted: set[int] | None = None) -> list[Page]:
        """Pages in order, numbered from 1, with inherited attributes; a node met twice is passed over."""
        if wanted is None and self.all_pages is not None:
            return list(self.all_pages)
        out: list[Page] = []
        seen: set[int] = set()
        stack: list[tuple[Any, dict[str, Any], int]] = [(self.catalog().get("Pages"), {}, 0)]
        number = 0
        while stack and number < PAGES:
            ref, inherited, depth = stack.pop()
            if isinstance(ref, Ref):
                if ref.num in seen:
                    self.warn("PAGE_TREE_CYCLE")
                    continue
                seen.add(ref.num)
            node = self.dict_of(ref)
            merged = {**inherited, **{k: node[k] for k in INHERITED if k in node}}
            if "Kids" in node and node.get("Type") != "Page":
                if depth < PAGE_DEPTH:
                    stack += [(kid, merged, depth + 1) for kid in reversed(self.list_of(node["Kids"]))]
            elif node:
                number += 1
                if wanted is None or number in wanted:
                    out.append(Page(number, ref if isinstance(ref, Ref) else None, {**node, **merged}))
        if wanted is None:
            self.all_pages = list(out)
        return out


def parse_pages(text: str | None, last: int = PAGES) -> set[int] | None:
    """Page numbers of a list such as 1,3-5,9-; None selects all."""
    if not text:
        return None
    out: set[int] = set()
    for part in text.split(","):
        low, dash, high = part.strip().partition("-")
        first = int(low)
        out.update(range(first, (int(high) if high else last) + 1) if dash else (first,))
    return out
