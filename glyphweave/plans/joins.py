"""Containment, overlap, best match and ownership over the document fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import matches
from .against import against

PAGE = ["doc_id", "page"]
BOX = ["x0", "y0", "x1", "y1"]


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "lineitem")


@against
def range_join_glyph_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.table_cells(spark, sf_dir)
    letters = cells.filter(F.length("txt") > 0).select("*", F.posexplode(F.split("txt", "")).alias("k", "ch")).filter("ch <> ''")
    shift = F.when((F.col("table_id") + F.col("k")) % 7 == 0, 5).otherwise(0)
    glyphs = letters.select("table_id", F.col("col").alias("src_col"), F.col("k").cast("long").alias("k"), "ch", (F.col("x0") + 4 + 8 * F.col("k") - shift).alias("cx"), (F.col("y0") + 10).alias("cy"))
    return matches.glyphs_in_cells(glyphs, cells)


@against
def segment_table_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.doc_lines(spark, sf_dir)
    return matches.touching(fx.doc_fills(lines), fx.doc_segments(lines))


@against
def not_exists_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.doc_lines(spark, sf_dir)
    return matches.without_overlap(fx.doc_fills(lines), fx.doc_images(lines)).select(*PAGE, "seq", *BOX)


@against
def overlap_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.doc_lines(spark, sf_dir)
    f, i = matches.of("f"), matches.of("i")
    pairs = fx.doc_fills(lines).alias("f").join(fx.doc_images(lines).alias("i"), matches.same(f, i, PAGE))
    return pairs.select("f.doc_id", "f.page", matches.overlap(f, i).alias("overlap"), matches.distance(f, i).alias("distance"))


@against
def tagged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lineitem(spark, sf_dir).withColumn("doc", F.col("l_orderkey")).withColumn("mcid", F.col("l_partkey") % 50).withColumn("page", 1 + F.col("l_linenumber") % 2)
    tagged = rows.groupBy("doc", "mcid", "page").agg(F.min("l_linenumber").alias("node"))
    glyphs = rows.filter("l_tax > 0.01").groupBy("doc", "mcid", "page", F.col("l_linenumber").alias("seq")).agg(F.min("l_quantity").cast("long").alias("y0"), F.min(F.substring("l_linestatus", 1, 1)).alias("ch"))
    return matches.bind_text(tagged, glyphs)


@against
def tag_bind_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lineitem(spark, sf_dir)
    key = (F.col("l_partkey") % 40).alias("k")
    tags = rows.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("tag"), key, F.col("l_returnflag").alias("role")).distinct()
    shapes = rows.select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 4).alias("geo"), key, F.col("l_linestatus").alias("kind")).distinct()
    bonus = F.when((F.col("role") == "R") & (F.col("kind") == "F"), 14).when(F.col("role") == "A", 8).otherwise(-18)
    return matches.best_binding(tags, shapes, bonus)


@against
def outline_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.doc_lines(spark, sf_dir).select(*PAGE, "seq", "bold", matches.title_words(F.col("text")).alias("words"))
    titles = lines.filter("bold").select(*PAGE, F.col("seq").alias("title_seq"), F.col("words").alias("title"))
    return matches.best_titles(titles, lines.select(*PAGE, "seq", "words"))


@against
def nearest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.doc_lines(spark, sf_dir)
    places = fx.doc_pages(lines).withColumn("y", (60 + 37 * (F.col("doc_id") % 17)).cast("double"))
    return matches.nearest_line(places, lines)


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    body = F.format_string("See Figure %d and Table %d; cf. Eq. %d [%d, %d] in Section %d.", d % 5 + 1, d % 3, d % 4, d % 9 + 1, d % 7 + 2, d % 6)
    return fx.table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))


@against
def crossrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    made = F.array(
        F.when(k.between(1, 4), F.struct(F.lit("figure").alias("category"), F.concat(F.lit("fig-"), k.cast("string")).alias("id"))),
        F.when(k < 3, F.struct(F.lit("table").alias("category"), F.concat(F.lit("tab-"), k.cast("string")).alias("id"))),
        F.when(k.isin(0, 2), F.struct(F.lit("equation").alias("category"), F.concat(F.lit("eq-"), k.cast("string")).alias("id"))),
    )
    targets = fx.table(spark, sf_dir, "nation").select(k.cast("string").alias("label"), F.explode(made).alias("t")).filter("t IS NOT NULL").select("t.category", "label", "t.id")
    return matches.cross_references(_marked(spark, sf_dir), targets)


@against
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = fx.table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("label"), F.col("r_name").alias("definition"))
    return matches.resolve_citations(_marked(spark, sf_dir), notes).select("doc_id", "label", "definition", "resolved")


@against
def ownership_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lineitem(spark, sf_dir).withColumn("doc", F.col("l_orderkey"))
    sets = lambda c: matches.key_sets(rows.withColumn("node", F.col(c)), ["doc", "node"], F.col("l_partkey") % 12)
    return matches.compare_ownership(sets("l_returnflag"), sets("l_linestatus"))


@against
def covered_top_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lineitem(spark, sf_dir).withColumn("doc", F.col("l_orderkey")).withColumn("idx", F.col("l_linenumber"))
    key = F.col("l_partkey") % 20
    claims = matches.key_sets(rows.filter(F.col("idx").between(2, 4)), ["doc"], key).withColumnRenamed("keys", "claimed")
    return matches.covered_nodes(matches.key_sets(rows, ["doc", "idx"], key), claims)


@against
def closed_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = fx.doc_fills(fx.doc_lines(spark, sf_dir))
    seq = F.col("seq") + 100
    flat = fills.select(*PAGE, "seq", "x0", "x1", F.col("y0").alias("y"), F.lit(0).alias("top")).union(fills.select(*PAGE, seq, F.col("x0") + F.col("page") % 3, "x1", "y1", F.lit(1)))
    upright = fills.select(*PAGE, F.col("x0").alias("x"), "y0", "y1").union(fills.select(*PAGE, "x1", "y0", "y1"))
    return matches.closed_outlines(flat, upright)


@against
def segment_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.near_segments(fx.doc_segments(fx.doc_lines(spark, sf_dir)))


@against
def visible_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.doc_lines(spark, sf_dir)
    k = F.col("doc_id") + F.col("seq")
    glyphs = lines.select(
        *PAGE, "seq", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), (F.col("seq") * 2 + 1).alias("paint_order"), F.when(k % 5 == 0, 0.98).otherwise(0.1).alias("tone"), (k % 17 == 0).alias("hidden")
    )
    return matches.visible(glyphs, fx.doc_fills(lines)).select(*PAGE, "seq")


@against
def thematic_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.doc_lines(spark, sf_dir)
    return matches.outside_text(fx.doc_segments(lines), lines).select(*PAGE, "seq")
