"""Small PDFs made from operators, for tests and round trips."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import lru_cache

FACES = {"F1": "Helvetica", "F2": "Helvetica-Bold", "F3": "Helvetica-Oblique", "F4": "Courier"}


@lru_cache(maxsize=4096)
def text_op(x: float, y: float, text: str, font: str = "F1", size: float = 10, mode: int = 0) -> bytes:
    raw = text.encode("cp1252", "replace")
    for a in (b"\\", b"(", b")"):
        raw = raw.replace(a, b"\\" + a)
    raw = raw.replace(b"\r", b"\\r").replace(b"\n", b"\\n")
    return b"BT /%s %g Tf %d Tr 1 0 0 1 %g %g Tm (%s) Tj ET" % (font.encode(), size, mode, x, y, raw)


@lru_cache(maxsize=4096)
def rule_op(x0: float, y0: float, x1: float, y1: float, width: float = 1) -> bytes:
    return b"%g w %g %g m %g %g l S" % (width, x0, y0, x1, y1)


def fill_op(x: float, y: float, w: float, h: float, gray: float = 0.9) -> bytes:
    return b"q %g g %g %g %g %g re f Q" % (gray, x, y, w, h)


def make_pdf(pages: Sequence[bytes], size: tuple[float, float] = (612, 792), compress: bool = False, fonts: dict[str, bytes] | None = None, extra: Sequence[bytes] = (), root: bytes = b"", page_attrs: bytes = b"") -> bytes:
    """A PDF of content streams. Extra objects follow the pages', numbered from 3 + faces + 2 per page; fonts adds font entries."""
    objects: list[bytes] = [b"", b""]
    faces = b""
    for key, name in FACES.items():
        objects.append(b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % name.encode())
        faces += b"/%s %d 0 R " % (key.encode(), len(objects))
    for key, body in (fonts or {}).items():
        faces += b"/%s %s " % (key.encode(), body)
    kids = []
    for content in pages:
        packed = zlib.compress(content) if compress else content
        how = b" /Filter /FlateDecode" if compress else b""
        objects.append(b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(packed), how, packed))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %g %g] /Resources << /Font << %s>> >> /Contents %d 0 R %s>>" % (*size, faces, len(objects), page_attrs))
        kids.append(b"%d 0 R" % len(objects))
    objects += extra
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R %s>>" % root
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    return assemble(objects)


def assemble(objects: Sequence[bytes], root: int = 1) -> bytes:
    """A file of object bodies with an exact cross-reference table."""
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1)
    for at in places:
        out += b"%010d 00000 n \n" % at
    out += b"trailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, root, start)
    return bytes(out)


def text_pdf(text: str, per_page: int = 45, width: int = 90, compress: bool = True) -> bytes:
    """A PDF that sets a text, line by line; long lines are broken between words."""
    rows: list[str] = []
    for line in text.split("\n"):
        row = ""
        for word in line.split():
            if row and len(row) + 1 + len(word) > width:
                rows.append(row)
                row = word
            else:
                row = f"{row} {word}" if row else word
        if row:
            rows.append(row)
    pages = [rows[k : k + per_page] for k in range(0, len(rows), per_page)] or [[]]
    return make_pdf([b"\n".join(text_op(60, 740 - 15 * k, row, "F1", 8) for k, row in enumerate(page)) for page in pages], compress=compress)
