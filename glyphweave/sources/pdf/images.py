"""Samples of raster images, and images as PNG: rows of whole bytes, 1 or 8 bits a component, gray, RGB or CMYK."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

COMPONENTS = {"G": 1, "DeviceGray": 1, "RGB": 3, "DeviceRGB": 3, "CMYK": 4, "DeviceCMYK": 4}
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def samples(data: bytes, width: int, height: int, bits: int, components: int, decode: Sequence[float] | None = None) -> bytes:
    """One byte a component, rows without padding. A decode array that runs down inverts; short data end in zeros."""
    if bits not in (1, 8) or width < 1 or height < 1:
        raise ValueError(f"{bits} bits a component are not read")
    stride = (width * components * bits + 7) // 8
    data = data[: stride * height].ljust(stride * height, b"\0")
    if bits == 8:
        out = data
    else:
        n = width * components
        out = b"".join(bytes(255 * (row >> (8 * stride - 1 - k) & 1) for k in range(n)) for row in (int.from_bytes(data[i * stride : (i + 1) * stride], "big") for i in range(height)))
    if decode and len(decode) == 2 * components and all(a > b for a, b in zip(decode[::2], decode[1::2], strict=True)):
        out = bytes(255 - v for v in out)
    return out


def to_rgb(data: bytes, components: int) -> bytes:
    """CMYK samples as RGB; others as they are."""
    if components != 4:
        return data
    out = bytearray()
    for c, m, y, k in zip(*(data[i::4] for i in range(4)), strict=True):
        out += bytes(255 - min(255, v + k) for v in (c, m, y))
    return bytes(out)


def png(data: bytes, width: int, height: int, components: int) -> bytes:
    """Samples of one byte as a PNG: gray or RGB, rows unfiltered; the same bytes for the same samples."""
    data, components = to_rgb(data, components), min(components, 3)
    stride = width * components
    rows = b"".join(b"\0" + data[i * stride : (i + 1) * stride] for i in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[components], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[int, int, int, bytes]:
    """Width, height, components and samples of a PNG made here."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG")
    at, packed, head = 8, b"", b""
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        head, packed = (body, packed) if kind == b"IHDR" else (head, packed + body) if kind == b"IDAT" else (head, packed)
        at += 12 + size
    width, height, _, colour = struct.unpack(">IIBB", head[:10])
    n = {0: 1, 2: 3}[colour]
    rows = zlib.decompress(packed)
    return width, height, n, b"".join(rows[i * (width * n + 1) + 1 : (i + 1) * (width * n + 1)] for i in range(height))


def extract(doc) -> list[dict]:
    """Image streams of a file, each once: width, height, ending, data and digest. JPEGs as they are, others as PNG; what can't be read has an error instead."""
    import hashlib

    from .structure import embedded_images

    out = []
    for x in embedded_images(doc):
        get = lambda *keys, a=x.attrs: next((v for k in keys if (v := doc.resolve(a.get(k))) is not None), None)
        width, height = int(get("Width", "W") or 0), int(get("Height", "H") or 0)
        filters = get("Filter", "F")
        names = [str(f) for f in (filters if isinstance(filters, list) else [filters] if filters is not None else [])]
        row = {"width": width, "height": height, "ending": "png", "data": None, "error": None}
        try:
            if names and names[-1] in ("DCTDecode", "DCT"):
                row.update(ending="jpg", data=bytes(x.raw))
            else:
                n = 1 if get("ImageMask", "IM") else COMPONENTS[str(get("ColorSpace", "CS"))]
                bits = 1 if get("ImageMask", "IM") else int(get("BitsPerComponent", "BPC") or 8)
                row["data"] = png(samples(doc.bytes_of(x), width, height, bits, n, get("Decode", "D")), width, height, n)
            row["sha256"] = hashlib.sha256(row["data"]).hexdigest()
        except (KeyError, ValueError, TypeError) as e:
            row["error"] = f"{type(e).__name__}: {e}"
        out.append(row)
    return out
