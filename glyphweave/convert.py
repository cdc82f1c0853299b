"""The public way in: PDF files to Markdown, HTML, nodes and a report."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from operator import itemgetter
from statistics import median
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import blocks, notes
from .render import html, markdown
from .ship import ship
from .sources.pdf.reader import RUN, read

RESULT = "path string, markdown string, html string, nodes string, report string, error string"
NODE = "path string, node int, parent int, ordinal int, depth int, kind string, text string, page int, confidence double, attrs string, evidence array<string>, lines array<string>"
KINDS = frozenset("section heading paragraph list item quote code_block table table_row table_cell image caption thematic_break note reference toc toc_item form field artifact outline".split())
USED = frozenset({"page", "line", "glyph", RUN, "segment", "image", "outline", "metadata", "tag", "warning", "error"})
CONTAINERS = frozenset({"section", "list", "toc", "table", "table_row", "table_cell", "image", "thematic_break", "outline"})


@dataclass(frozen=True)
class Options:
    """pages: numbers and ranges such as 1,3-5,9-. heading_levels: ladder, or flat for level 1 alone."""

    pages: str | None = None
    heading_levels: str = "ladder"
    page_breaks: bool = False

    def __post_init__(self) -> None:
        if self.heading_levels not in ("ladder", "flat"):
            raise ValueError("heading_levels is ladder or flat")


def validate(nodes: list[dict[str, Any]]) -> list[str]:
    """What is wrong with a document's node rows: repeated numbers, unknown kinds, confidences out of range, no lines."""
    out, seen = [], set()
    for n in nodes:
        if n["node"] in seen:
            out.append(f"node {n['node']} is there twice")
        seen.add(n["node"])
        if n["kind"] not in KINDS:
            out.append(f"node {n['node']} is of an unknown kind {n['kind']}")
        if not 0 <= n["confidence"] <= 1:
            out.append(f"node {n['node']} has a confidence of {n['confidence']}")
        if not n["lines"] and n["kind"] not in CONTAINERS and n["kind"] != "item":
            out.append(f"node {n['node']} comes from no line")
        if n["parent"] is not None and n["parent"] >= n["node"]:
            out.append(f"node {n['node']} stands before its parent")
    return out


#: What a conversion can put out; what isn't asked for isn't made.
OUTPUTS = frozenset({"markdown", "html", "nodes", "report"})


def convert_bytes(data: bytes, options: Options = Options(), outputs: frozenset[str] = OUTPUTS, every: bool = True) -> dict[str, Any]:  # noqa: B008
    """One file: markdown, html, nodes (adjacency rows), report, error. Nodes and report are made though they aren't among the outputs, unless `every` is false."""
    rows = read(data, options.pages, USED)
    error = next((r["text"] for r in rows if r["kind"] == "error"), None)
    nodes = blocks.build(rows)
    if options.heading_levels == "flat":
        for n in nodes:
            if n.kind == "heading":
                n.attrs["level"] = 1
    blocks.anchors(nodes)
    notes.enrich(nodes, rows, median([r["size"] for r in rows if r["kind"] == "line"] or [10.0]))
    told = every or "nodes" in outputs or "report" in outputs
    outline = told and notes.outline_targets([{"title": r["title"], "level": r["level"], "page": r["page"], "y": r["y"]} for r in rows if r["kind"] == "outline"], nodes)
    flat = blocks.adjacency(nodes) if told else None
    tree = [n.as_dict() for n in nodes] if {"markdown", "html"} & outputs else []
    if options.page_breaks:
        tree = [x for k, n in enumerate(tree) for x in ([{"kind": "thematic_break", "text": "", "attrs": {}, "children": []}] if k and n["page"] != tree[k - 1]["page"] else []) + [n]]
    meta = next((r for r in rows if r["kind"] == "metadata"), {})
    report = None
    if told:
        count = Counter(map(itemgetter("kind"), rows))
        glyphs = count["glyph"] + sum(r["run"].n for r in rows if r["kind"] == RUN)
        errors = validate(flat)
        report = {
            "pages": count["page"], "lines": count["line"], "glyphs": glyphs, "images": count["image"],
            "nodes": len(flat), "kinds": sorted({n["kind"] for n in flat}), "warnings": [r["text"] for r in rows if r["kind"] == "warning"], "outline": outline, "valid": not errors, "errors": errors, "options": asdict(options),
        }
    page = None
    if "html" in outputs:
        try:
            page = html.render(tree, meta.get("title") or "", meta.get("lang") or "")
        except (KeyError, TypeError):
            page = html.minimal(tree)
    return {"markdown": markdown.render(tree) if "markdown" in outputs else None, "html": page, "nodes": flat, "report": report, "error": error}


#: Converted files that go back to Spark together: so many, or so many characters.
OUTPUT_ROWS, OUTPUT_CHARS = 256, 4 << 20


def convert(files: DataFrame, path_col: str = "path", content_col: str = "content", options: Options = Options(), outputs: frozenset[str] = OUTPUTS) -> DataFrame:  # noqa: B008
    """A row for each file of a table with a path and a binary column; a file that fails gives its error and what was read. Of the outputs, those not asked for are null and aren't made."""
    ship(files.sparkSession)
    told = lambda name, r: json.dumps(r[name], sort_keys=True) if name in outputs else None

    def table_of(done: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], [c.split()[0] for c in RESULT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        size = 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = convert_bytes(content or b"", options, outputs, every=False)
                done.append([path, r["markdown"], r["html"], told("nodes", r), told("report", r), r["error"]])
                size += sum(len(v or "") for v in done[-1])
                if size >= OUTPUT_CHARS or len(done) >= OUTPUT_ROWS:
                    yield table_of(done)
                    done, size = [], 0
        if done:
            yield table_of(done)

    return files.select(F.col(path_col).cast("string"), F.col(content_col)).mapInArrow(run, RESULT)


def convert_files(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:  # noqa: B008
    return convert(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path), options=options)


def node_table(converted: DataFrame) -> DataFrame:
    """Nodes of converted files as rows."""
    schema = "array<struct<node: int, parent: int, ordinal: int, depth: int, kind: string, text: string, page: int, confidence: double, attrs: string, evidence: array<string>, lines: array<string>>>"
    return converted.select("path", F.inline(F.from_json("nodes", schema)))


def write(converted: DataFrame, folder: str, form: str = "both") -> None:
    """Text sinks: md, html and json (or both for the first two) under a folder, as Parquet of path and value, so that a million documents aren't a million files."""
    kinds = {"md": ("markdown",), "html": ("html",), "json": ("nodes", "report"), "both": ("markdown", "html", "nodes", "report")}[form]
    for kind in kinds:
        converted.select("path", F.col(kind).alias("value")).write.mode("overwrite").parquet(f"{folder}/{kind}")
