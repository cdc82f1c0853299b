"""PDF objects and their lexer."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any


class Name(str):
    """A PDF name, without its slash."""

    __slots__ = ()


class Operator(str):
    """A keyword of a content stream."""

    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    num: int
    gen: int


@dataclass
class Stream:
    attrs: dict[str, Any]
    raw: bytes
    decoded: bytes | None = field(default=None, repr=False)


class PdfError(ValueError):
    pass


END = object()
_SPACE = b"\x00\t\n\x0c\r "
_DELIMITER = b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]*(?:\d+\.?\d*|\.\d+)(?:-\d*)?\Z")
_REF = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
#: What most tokens are, with the blanks before them: plain numbers, keywords, names without escapes, and strings without escapes or brackets.
PLAIN = re.compile(
    rb"""[\x00\t\n\x0c\r ]*+(?:([+-]?(?:\d++(?:\.\d*+)?+|\.\d++))(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)|([A-Za-z'"*][A-Za-z0-9'"*]*+)(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)"""
    rb"""|/([!-"$&'*-.0-;=?-Z\\^-z|~]*+)(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)|\(([^()\\\r]*+)\))"""
)
CONSTANTS = {b"true": True, b"false": False, b"null": None}
_HEX_NAME = re.compile(rb"#([0-9A-Fa-f]{2})")
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
DEPTH = 200


class Lexer:
    """Objects from bytes. `refs` says whether `1 0 R` is a reference (not so in content streams)."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def next(self, depth: int = 0) -> Any:
        """The next object, an Operator for a keyword, or END."""
        m = PLAIN.match(self.data, self.at)
        if m and depth <= DEPTH:
            self.at = m.end()
            kind = m.lastindex
            word = m[kind]
            if kind == 1:
                if b"." in word:
                    return float(word)
                value = int(word)
                if self.refs and value >= 0 and (r := _REF.match(self.data, self.at)):
                    self.at = r.end()
                    return Ref(value, int(r[1]))
                return value
            if kind == 2:
                return CONSTANTS[word] if word in CONSTANTS else _operator(word)
            return name_of(word) if kind == 3 else word
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            return END
        if depth > DEPTH:
            raise PdfError("objects are nested too deeply")
        c = data[at : at + 1]
        if c == b"/":
            m = _REGULAR.match(data, at + 1)
            self.at = m.end() if m else at + 1
            raw = _HEX_NAME.sub(lambda x: bytes([int(x[1], 16)]), m.group()) if m else b""
            return Name(raw.decode("utf-8", "replace") if raw.isascii() else raw.decode("latin-1"))
        if c == b"(":
            return self._literal()
        if data.startswith(b"<<", at):
            self.at += 2
            return self._dict(depth)
        if c == b"<":
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            return self._array(depth)
        if c in b"]>){}":
            self.at += 2 if data.startswith(b">>", at) else 1
            return Operator(data[at : self.at].decode())
        m = _REGULAR.match(data, at)
        word = m.group()
        self.at = m.end()
        if _NUMBER.match(word):
            value = _number(word)
            if self.refs and isinstance(value, int) and value >= 0 and (r := _REF.match(data, self.at)):
                self.at = r.end()
                return Ref(value, int(r[1]))
            return value
        return CONSTANTS[word] if word in CONSTANTS else Operator(word.decode("latin-1"))

    def _array(self, depth: int) -> list:
        out: list = []
        while True:
            x = self.next(depth + 1)
            if x is END or isinstance(x, Operator) and x == "]":
                return out
            if isinstance(x, Operator) and x in ("endobj", "stream", ">>"):
                return out
            out.append(x)

    def _dict(self, depth: int) -> dict:
        out: dict = {}
        while True:
            key = self.next(depth + 1)
            if key is END or isinstance(key, Operator) and key in (">>", "endobj"):
                return out
            if not isinstance(key, Name):
                continue
            value = self.next(depth + 1)
            if value is END or isinstance(value, Operator) and value == ">>":
                return out
            out.setdefault(str(key), value)

    def _literal(self) -> bytes:
        data, at, level = self.data, self.at + 1, 1
        out = bytearray()
        while at < len(data):
            c = data[at]
            at += 1
            if c == 0x5C and at < len(data):
                e = data[at]
                at += 1
                if e in _ESCAPES:
                    out.append(_ESCAPES[e])
                elif 0x30 <= e <= 0x37:
                    digits = re.match(rb"[0-7]{1,3}", data[at - 1 : at + 2]).group()
                    at += len(digits) - 1
                    out.append(int(digits, 8) & 255)
                elif e == 13:
                    at += data[at : at + 1] == b"\n"
                elif e != 10:
                    out.append(e)
                continue
            if c == 13:
                at += data[at : at + 1] == b"\n"
                c = 10
            level += (c == 0x28) - (c == 0x29)
            if not level:
                break
            out.append(c)
        self.at = at
        return bytes(out)


@lru_cache(maxsize=4096)
def _operator(word: bytes) -> Operator:
    return Operator(word.decode())


@lru_cache(maxsize=4096)
def name_of(word: bytes) -> Name:
    return Name(word.decode())


def _number(word: bytes) -> int | float:
    text = word.decode()
    sign = -1 if text.startswith("-") else 1
    text = text.lstrip("+-").split("-")[0]
    return sign * (float(text) if "." in text else int(text))
