"""Rows in order: runs, islands, continuation, look-ahead, nesting. Every window is over a document, a page or a table, never over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T

Keys = list[str]


def ordered(keys: Keys, *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def number_runs(rows: DataFrame, keys: Keys, order: Keys, begins: Column, name: str = "run") -> DataFrame:
    """Number the runs of rows: a row for which `begins` holds (which may look at its neighbours) opens one; null counts as yes."""
    marked = rows.withColumn("_begins", F.when(begins == F.lit(False), 0).otherwise(1))
    so_far = ordered(keys, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn(name, F.sum("_begins").over(so_far).cast("long")).drop("_begins")


def gap_clusters(values: DataFrame, keys: Keys, value: str, tie: str, gap: float) -> DataFrame:
    """Values on a line, cut where two neighbours lie more than `gap` apart: keys, cluster, centre, low, high, n."""
    step = F.col(value) - F.lag(value).over(ordered(keys, value, tie))
    runs = number_runs(values, keys, [value, tie], ~(step <= gap), "cluster")
    return runs.groupBy(*keys, "cluster").agg(F.avg(value).alias("centre"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"))


def widest_gap(starts: DataFrame, keys: Keys, x: str) -> DataFrame:
    """The two neighbouring starts of each group that lie furthest apart, the leftmost of equals: keys, left_start, right_start, gap, separator."""
    following = starts.select(*keys, x).distinct().withColumn("_next", F.lead(x).over(ordered(keys, x))).filter("_next IS NOT NULL")
    best = F.max_by(F.struct(F.col(x).alias("left_start"), F.col("_next").alias("right_start")), F.struct(F.col("_next") - F.col(x), -F.col(x))).alias("b")
    found = following.groupBy(*keys).agg(best).select(*keys, "b.*")
    return found.withColumn("gap", F.col("right_start") - F.col("left_start")).withColumn("separator", (F.col("left_start") + F.col("right_start")) / 2)


def joined_text(order: Keys, text: str, between: str = "") -> Column:
    """Aggregate: texts in the order of other columns, put together."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text")))), lambda x: x["_text"]), between)


def merge_same(pieces: DataFrame, keys: Keys, order: Keys, style: str, text: str) -> DataFrame:
    """Neighbouring pieces of one style as one: keys, run, style, parts, text."""
    runs = number_runs(pieces, keys, order, F.col(style) != F.lag(style).over(ordered(keys, *order)))
    return runs.groupBy(*keys, "run").agg(F.max(style).alias("style"), F.count(F.lit(1)).alias("parts"), joined_text(order, text).alias("text"))


def islands(events: DataFrame, keys: Keys, order: str, kind: str, wanted: str) -> DataFrame:
    """Unbroken runs of one kind of event: keys, first and last place, number of events."""
    runs = number_runs(events, keys, [order], F.col(kind) != F.lag(kind).over(ordered(keys, order))).filter(F.col(kind) == wanted)
    return runs.groupBy(*keys, "run").agg(F.min(order).alias(f"first_{order}"), F.max(order).alias(f"last_{order}"), F.count(F.lit(1)).alias("events")).drop("run")


def counting_runs(labels: DataFrame, keys: Keys, order: str, label: str, least: int = 2) -> DataFrame:
    """Runs of labels that count up by one, of `least` or more: keys, first place, first and last label, n."""
    runs = number_runs(labels, keys, [order], F.col(label) - F.lag(label).over(ordered(keys, order)) != 1)
    out = runs.groupBy(*keys, "run").agg(F.min(order).alias(f"first_{order}"), F.min(label).alias("first_label"), F.max(label).alias("last_label"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") >= least).drop("run")


def continued_text(lines: DataFrame, closing: str = ".?!:") -> DataFrame:
    """Text over each page border: a last line that doesn't close goes on in the next page's first line. doc_id, from_page, continues, text, confidence."""
    edges = lines.groupBy("doc_id", "page").agg(F.max_by("text", "seq").alias("last"), F.min_by("text", "seq").alias("first"))
    after = ordered(["doc_id"], "page")
    met = edges.withColumn("_next", F.lead("first").over(after)).withColumn("_page", F.lead("page").over(after)).filter("_page = page + 1")
    open_ended = ~F.substring("last", -1, 1).isin(*closing)
    return met.select("doc_id", F.col("page").alias("from_page"), open_ended.alias("continues"), F.when(open_ended, F.concat_ws(" ", "last", "_next")).otherwise(F.col("last")).alias("text"), F.lit(0.9).alias("confidence"))


def continued_tables(tables: DataFrame, height: float, width_slack: float = 5, width_share: float = 0.04, low: float = 0.55, high: float = 0.45) -> DataFrame:
    """Tables that go on over pages: as many columns, as wide, low on one page and high on the next, with one header. tables: doc, tbl, page, cols, width, bottom, top, header."""
    w = ordered(["doc"], "page")
    was = lambda c: F.lag(c).over(w)
    goes_on = (was("cols") == F.col("cols")) & (F.abs(was("width") - F.col("width")) <= F.greatest(F.lit(width_slack), was("width") * width_share)) & (was("bottom") >= height * low) & (F.col("top") <= height * high) & (was("header") == F.col("header"))
    runs = number_runs(tables, ["doc"], ["page"], ~F.coalesce(goes_on, F.lit(False)), "grp")
    out = runs.groupBy("doc", "grp").agg(F.min("tbl").alias("first_table"), F.count(F.lit(1)).alias("fragments"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    return out.withColumn("confidence", F.when(F.col("fragments") > 1, F.lit(0.95)).otherwise(F.lit(1.0))).drop("grp")


def hits_ahead(rows: DataFrame, keys: Keys, order: str, hit: Column, reach: int) -> DataFrame:
    """How many of the next `reach` rows are hits: a column `entries`."""
    return rows.withColumn("entries", F.sum(F.when(hit, 1).otherwise(0)).over(ordered(keys, order).rowsBetween(1, reach)))


def sections(blocks: DataFrame, keys: Keys, order: str, heading: Column) -> DataFrame:
    """The place of the heading that each block stands under, null before the first: a column `heading`."""
    so_far = ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("heading", F.last(F.when(heading, F.col(order)), ignorenulls=True).over(so_far))


def anchors(headings: DataFrame, keys: Keys, order: str, text: str) -> DataFrame:
    """An anchor for each heading that no other of its document has: its slug, with a number from the second on."""
    named = headings.withColumn("_slug", T.slug(F.col(text), F.concat(F.lit("node-"), F.col(order).cast("string"))))
    k = F.row_number().over(ordered([*keys, "_slug"], order))
    return named.withColumn("anchor", F.when(k == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", k.cast("string")))).drop("_slug")


def tag_inversions(nodes: DataFrame, gap: float = 4) -> DataFrame:
    """Pairs of nodes whose tags stand the other way round, and whether all of them lie in columns apart. nodes: doc, idx, tag_order, x0, x1."""
    a, b = nodes.alias("a"), nodes.alias("b")
    pairs = a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.idx") < F.col("b.idx")) & (F.col("a.tag_order") > F.col("b.tag_order")))
    apart = (F.col("b.x0") - F.col("a.x1") >= gap) | (F.col("a.x0") - F.col("b.x1") >= gap)
    out = pairs.groupBy(F.col("a.doc").alias("doc")).agg(F.count(F.lit(1)).alias("inversions"), F.sum(F.when(apart, 1).otherwise(0)).alias("independent"))
    return out.withColumn("accepted", F.col("inversions") == F.col("independent"))


def place_spans(cells: DataFrame, row: Keys, col: str, span: str) -> DataFrame:
    """The grid column at which each cell of a row begins, after the spans before it: a column `grid_col`."""
    so_far = ordered(row, col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn("grid_col", (F.sum(span).over(so_far) - F.col(span)).cast("long"))


def first_of(rows: DataFrame, keys: Keys, *order: str | Column, n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_place", F.row_number().over(ordered(keys, *order))).filter(F.col("_place") <= n).drop("_place")


def sort_labels(labels: DataFrame, label: str) -> DataFrame:
    """Labels of one document in order, numbers first and by value: a column `place`. All of them are one sequence."""
    number = F.col(label).try_cast("long")
    return labels.withColumn("place", F.row_number().over(Window.orderBy(number.isNull(), number.asc_nulls_last(), label)))


def panel_order(panels: DataFrame, near: float = 100) -> DataFrame:
    """Place of each panel in its document and whether the next one of its page lies beside it."""
    place = F.row_number().over(ordered(["doc_id"], "page", "y0", "x0", "seq"))
    next_y0 = F.lead("y0").over(ordered(["doc_id", "page"], "y0", "x0", "seq"))
    return panels.withColumn("place", place).withColumn("beside", F.coalesce(F.abs(next_y0 - F.col("y0")) <= near, F.lit(False)))


def longest_segment(segments: DataFrame) -> DataFrame:
    """The tallest rule of each page, the first of equals, and where the highest flat one lies."""
    extent = F.abs(F.col("y1") - F.col("y0"))
    return segments.groupBy("doc_id", "page").agg(F.max_by("seq", F.struct(extent, -F.col("seq"))).alias("seq"), F.max(extent).alias("extent"), F.min(F.when(F.col("y0") == F.col("y1"), F.col("y0"))).alias("first_flat"))


def indent_parents(lines: DataFrame, reach: int = 12, least: float = 4, share: float = 0.45) -> DataFrame:
    """The nearest line before each, within `reach`, that begins clearly further left: a column `parent`, null for none. No join."""
    before = ordered(["doc_id", "page"], "seq").rangeBetween(-reach, -1)
    near = lines.withColumn("_before", F.collect_list(F.struct("seq", "x0")).over(before))
    left = F.filter("_before", lambda b: b["x0"] < F.col("x0") - F.greatest(F.lit(least), F.col("size") * share))
    return near.withColumn("parent", F.array_max(F.transform(left, lambda b: b["seq"]))).drop("_before")


def hanging_markers(lines: DataFrame, from_: float = 8, to: float = 60, drop: float = 12) -> DataFrame:
    """Lines that begin a hanging paragraph: the next is indented and close, and the one before begins elsewhere."""
    w = ordered(["doc_id", "page"], "seq")
    step, rise = F.lead("x0").over(w) - F.col("x0"), F.lead("y0").over(w) - F.col("y1")
    alone = F.coalesce(F.lag("x0").over(w) != F.col("x0"), F.lit(True))
    return lines.withColumn("_marker", (step > from_) & (step <= to) & (rise <= drop) & alone).filter("_marker").drop("_marker")
