"""Semantic trees and graphs over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import runs, trees
from .against import against


@against
def node_tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.walk(fx.node_tree(spark, sf_dir)).drop("text")


@against
def node_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = trees.walk(fx.node_tree(spark, sf_dir)).withColumn("root", F.element_at(F.split("path", "/"), 1))
    return walked.groupBy("root").agg(runs.joined_text(["path"], "text", " ").alias("text"), F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"))


@against
def graph_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, line = F.col("l_returnflag"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")
    nodes = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.when(F.col("l_partkey") % 97 == 0, "dup").otherwise(line).alias("node_id"), F.when(flag == "A", "paragraph").when(flag == "N", "heading").otherwise("blink").alias("kind"),
        (F.col("l_discount") * 11).alias("confidence"), (F.col("l_suppkey") % 5).alias("sources"),
    )
    return trees.faults(nodes, ["paragraph", "heading", "list", "table"])


@against
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.find_cycles(fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 30).alias("b")))


@against
def artifact_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.without_subtrees(trees.walk(fx.node_tree(spark, sf_dir)), (F.col("kind") == "heading") & (F.length("text") % 3 == 0)).select("node_id", "kind", "depth")


@against
def walk_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.walk(fx.node_tree(spark, sf_dir), "NOT (w.kind = 'heading' AND length(w.text) % 2 = 0)").select("node_id", "kind", "depth")


@against
def acroform_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    top = fx.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.lower("r_name").alias("part"), F.lit(None).cast("long").alias("ft"))
    below = fx.table(spark, sf_dir, "nation").select((100 + k).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent"), F.lower("n_name").alias("part"), F.when(k % 3 == 0, k % 4).cast("long").alias("ft"))
    return trees.dotted_names(top.unionByName(below))


@against
def page_tree_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    top = fx.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), (F.col("r_regionkey") * 90).cast("long").alias("rotate"), F.lit(None).cast("double").alias("height"))
    below = fx.table(spark, sf_dir, "nation").select(
        (100 + k).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent"), F.when(k % 2 == 0, k * 90).cast("long").alias("rotate"), F.when(k % 5 == 0, 700 + k).cast("double").alias("height")
    )
    pages = trees.inherit(top.unionByName(below), rotate="0", height="792D").filter("depth = 1")
    return runs.sort_labels(pages.select("id", (F.col("rotate") % 360).alias("rotate"), "height"), "id").withColumnRenamed("place", "page")


@against
def role_map_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    custom = lambda n: F.concat(F.lit("custom"), n.cast("string"))
    roles = fx.table(spark, sf_dir, "nation").select(custom(k).alias("src"), F.when(k % 4 == 0, "P").when(k % 7 == 1, "H1").otherwise(custom(k - 1)).alias("dst"))
    return trees.resolve_roles(roles, ["P", "H1"]).withColumn("kind", F.when(F.col("resolved") == "P", "paragraph").otherwise("heading"))


@against
def xref_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "lineitem")
    return trees.newest_entries(rows.select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 30).alias("obj"), F.col("l_linenumber").alias("revision"), F.col("l_suppkey").alias("place"), (F.col("l_returnflag") == "R").alias("free")))


@against
def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.selected_pages(fx.doc_pages(fx.doc_lines(spark, sf_dir)), "1,3-5,9-")
