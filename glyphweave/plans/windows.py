"""Runs, islands, continuation, nesting and order over the document fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import runs
from .against import against

PAGE = ["doc_id", "page"]


def kind_of_line() -> Column:
    """Kinds of the fixture's lines, by their places."""
    k = (F.col("doc_id") + F.col("seq")) % 11
    return F.when(k == 0, "heading").when(k.isin(2, 3, 4), "list").when(k == 7, "table").otherwise("paragraph")


def place() -> Column:
    return F.col("page") * 40 + F.col("seq")


@against
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_quantity").cast("double").alias("v"), F.col("l_partkey").alias("tie"))
    return runs.gap_clusters(values, ["grp"], "v", "tie", 2)


@against
def start_gap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.widest_gap(fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.round("l_quantity", 1).alias("x")), ["grp"], "x")


@against
def coalesce_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    styled = fx.table(spark, sf_dir, "conversations").filter("text IS NOT NULL").withColumn("style", F.substring("text", 1, 1).isin(*"ABCDEFGHIJK"))
    return runs.merge_same(styled, ["conv_id"], ["turn", "text"], "style", "text")


@against
def list_event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.islands(fx.doc_lines(spark, sf_dir).withColumn("kind", kind_of_line()), PAGE, "seq", "kind", "list")


@against
def reference_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("seq") + 2 * F.floor((F.col("seq") + F.col("doc_id")) / 6).cast("long")
    return runs.counting_runs(fx.doc_lines(spark, sf_dir).withColumn("label", label), PAGE, "seq", "label")


@against
def continuation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.continued_text(fx.doc_lines(spark, sf_dir))


@against
def continued_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc"), k.alias("tbl"), F.row_number().over(runs.ordered(["o_custkey"], "o_orderkey")).alias("page"), (2 + k % 2).alias("cols"),
        (400 + k % 3 * 9).cast("double").alias("width"), (300 + k % 5 * 100).cast("double").alias("bottom"), (60 + k % 7 * 60).cast("double").alias("top"), F.col("o_orderstatus").alias("header"),
    )
    return runs.continued_tables(orders, fx.PAGE_HEIGHT)


@against
def toc_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.doc_lines(spark, sf_dir).select("doc_id", place().alias("pos"), (kind_of_line() == "heading").alias("heading"), ((F.col("seq") + F.col("doc_id")) % 3 == 0).alias("entry"))
    return runs.hits_ahead(rows, ["doc_id"], "pos", F.col("entry"), 80).filter("heading AND entries >= 2").select("doc_id", "pos", "entries")


@against
def sections_by_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = fx.doc_lines(spark, sf_dir).select("doc_id", place().alias("pos"), kind_of_line().alias("kind"))
    under = runs.sections(blocks, ["doc_id"], "pos", F.col("kind") == "heading")
    return under.groupBy("doc_id", "heading").agg(F.count(F.lit(1)).alias("blocks"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum(F.when(F.col("kind") == "table", 1).otherwise(0)).alias("tables"))


@against
def heading_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.anchors(fx.doc_lines(spark, sf_dir).filter("bold").select("doc_id", place().alias("pos"), "text"), ["doc_id"], "pos", "text").drop("text")


@against
def tag_order_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("tag_order"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 5).alias("x1"))
    return runs.tag_inversions(nodes)


@against
def row_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.when((F.col("table_id") + F.col("row_idx") + F.col("col")) % 5 == 0, 2).otherwise(1)
    return runs.place_spans(fx.table_cells(spark, sf_dir).select("table_id", "row_idx", "col", span.alias("colspan")), ["table_id", "row_idx"], "col", "colspan")


@against
def dedupe_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = lambda k, name: (F.round(F.col("embedding")[k].cast("double"), 1) + 0.0).alias(name)
    return runs.first_of(fx.table(spark, sf_dir, "embeddings").select("label", "vec_id", near(0, "x"), near(1, "y")), ["label", "x", "y"], "vec_id")


@against
def topk_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "documents").select("source", "doc_id", ((F.col("n_chars") % 1000).cast("double") / 1000).alias("confidence"))
    return runs.first_of(rows, ["source"], "confidence", "doc_id", n=8).filter("confidence < 0.8")


@against
def label_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    label = F.when(k % 3 == 0, F.substring("n_name", 1, 3)).otherwise((k * 7).cast("string"))
    return runs.sort_labels(fx.table(spark, sf_dir, "nation").select(label.alias("label")).distinct(), "label")


@against
def adjacent_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.doc_lines(spark, sf_dir)
    box = ["x0", "y0", "x1", "y1"]
    panels = fx.doc_fills(lines).select(*PAGE, "seq", *box).unionByName(fx.doc_images(lines).select(*PAGE, (F.col("seq") + 50).alias("seq"), *box))
    return runs.panel_order(panels).select(*PAGE, "seq", "place", "beside")


@against
def longest_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.longest_segment(fx.doc_segments(fx.doc_lines(spark, sf_dir)))


@against
def indent_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.indent_parents(fx.doc_lines(spark, sf_dir)).select(*PAGE, "seq", "parent")


@against
def hanging_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.hanging_markers(fx.doc_lines(spark, sf_dir)).select(*PAGE, "seq")
