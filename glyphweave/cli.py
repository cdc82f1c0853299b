"""python -m glyphweave.cli convert|inspect|explain|trace|overlay|diff ...: one file, without Spark."""

from __future__ import annotations

import argparse
import difflib
import json
import time
from html import escape
from pathlib import Path

from .convert import Options, convert_bytes
from .render.overlay import BOX, COLOURS, END, HEAD, OTHER
from .sources.pdf.reader import parse

def overlay(data: bytes, page: int) -> str:
    """A page's lines and images as boxes."""
    rows = parse(data, str(page))
    size = next((r for r in rows if r["kind"] == "page"), {"x1": 612.0, "y1": 792.0})
    drawn = [r for r in rows if r["kind"] in ("line", "image")]
    boxes = [BOX % (r["x0"], r["y0"], r["x1"] - r["x0"], r["y1"] - r["y0"], COLOURS.get(r["kind"], OTHER), escape(r["text"] or r["kind"])) for r in drawn]
    return "\n".join([HEAD % (size["x1"], size["y1"]), *boxes, END])


def trace(data: bytes, page: int) -> list[str]:
    """A page's lines: number, place and text."""
    return [f'{r["seq"]:4d} {r["x0"]:7.1f} {r["y0"]:7.1f} {r["text"]}' for r in parse(data, str(page)) if r["kind"] == "line"]


def explain(nodes: list[dict], min_confidence: float = 0.0) -> list[str]:
    """Nodes with what speaks for them, from some confidence on."""
    return [f'{n["node"]} page={n["page"]} kind={n["kind"]} confidence={n["confidence"]:.2f} evidence={",".join(n["evidence"])}' for n in nodes if n["confidence"] >= min_confidence]


def changes(one: str, other: str, names: tuple[str, str] = ("a", "b")) -> list[str]:
    """A unified diff, line ends aside; nothing for equal texts."""
    lines = [t.replace("\r\n", "\n").splitlines() for t in (one, other)]
    return list(difflib.unified_diff(*lines, *names, lineterm=""))


def timed(data: bytes, options: Options) -> dict[str, float]:
    """Seconds a file and a page."""
    start = time.perf_counter()
    pages = convert_bytes(data, options)["report"]["pages"]
    total = time.perf_counter() - start
    return {"seconds": total, "pages": pages, "seconds_per_page": total / max(pages, 1)}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("what", choices=["convert", "inspect", "explain", "trace", "overlay", "diff", "time"])
    p.add_argument("files", nargs="+")
    p.add_argument("--pages")
    p.add_argument("--page", type=int, default=1)
    p.add_argument("--format", choices=["md", "html", "json"], default="md")
    p.add_argument("--min-confidence", type=float, default=0.0)
    a = p.parse_args(argv)
    data = [Path(f).read_bytes() for f in a.files]
    options = Options(pages=a.pages)
    if a.what == "diff":
        lines = changes(data[0].decode(), data[1].decode(), (a.files[0], a.files[1]))
        print("\n".join(lines))
        return int(bool(lines))
    for d in data:
        if a.what == "overlay":
            print(overlay(d, a.page))
        elif a.what == "trace":
            print("\n".join(trace(d, a.page)))
        elif a.what == "time":
            print(json.dumps(timed(d, options)))
        else:
            r = convert_bytes(d, options)
            if a.what == "inspect":
                print(json.dumps(r["report"], indent=2, sort_keys=True))
            elif a.what == "explain":
                print("\n".join(explain(r["nodes"], a.min_confidence)))
            else:
                print({"md": r["markdown"], "html": r["html"], "json": json.dumps(r["nodes"], sort_keys=True)}[a.format], end="")
            if r["error"]:
                return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
