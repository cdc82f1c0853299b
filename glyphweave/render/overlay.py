"""Boxes of a page as SVG: what was found, where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.runs import joined_text

COLOURS = {"heading": "#1f77b4", "paragraph": "#7f7f7f", "list": "#2ca02c", "table": "#d62728", "image": "#9467bd"}
OTHER = "#1f77b4"
#: Formats of a page's head, of a box and of its end, for text and for columns alike.
HEAD = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 %.1f %.1f">'
BOX = '<rect x="%.1f" y="%.1f" width="%.1f" height="%.1f" fill="none" stroke="%s"><title>%s</title></rect>'
END = "</svg>"


def box(kind: Column, label: Column) -> Column:
    colours = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    return F.format_string(BOX, "x0", "y0", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.coalesce(colours[kind], F.lit(OTHER)), T.html_escaped(label))


def page_overlays(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """An SVG for each page, its boxes by seq. boxes: doc_id, page, seq, kind, label, x0, y0, x1, y1."""
    drawn = boxes.select("doc_id", "page", "seq", box(F.col("kind"), F.col("label")).alias("box"))
    body = drawn.groupBy("doc_id", "page").agg(joined_text(["seq"], "box", "\n").alias("body"))
    return body.select("doc_id", "page", F.concat_ws("\n", F.lit(HEAD % (width, height)), "body", F.lit(END)).alias("svg"))
