"""Provenance, scores, signatures, votes and gates over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import admission, measures, runs
from .against import against

PAGE = ["doc_id", "page"]


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "lineitem")


@against
def provenance_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    sources = _lineitem(spark, sf_dir).select(
        F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("glyph"), F.col("l_returnflag").alias("region"), (F.col("l_suppkey") % 7).alias("mcid"),
        x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"), (1 - F.col("l_discount")).alias("confidence"),
    )
    return measures.merged_provenance(sources, ["node", "page"])


@against
def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fx.table(spark, sf_dir, "embeddings").select("label", *[F.col("embedding")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])
    return boxes.groupBy("label").agg(*measures.box(), F.count(F.lit(1)).alias("n"))


@against
def dominant_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.dominant(_lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("doc"), F.concat("l_returnflag", "l_linestatus").alias("mode")), ["doc"], "mode")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of which some rows have a cell over two columns."""
    wide = (F.col("table_id") + F.col("row_idx")) % 11 == 0
    return fx.table_cells(spark, sf_dir).filter(~(wide & (F.col("col") == 2))).withColumn("colspan", F.when(wide & (F.col("col") == 1), 2).otherwise(1))


@against
def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.column_counts(_grid(spark, sf_dir))


@against
def grid_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.grid_signature(_grid(spark, sf_dir), 100)


@against
def html_vs_gfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.needs_html(_grid(spark, sf_dir), F.col("table_id") % 13 == 0, F.col("table_id") % 17 == 0)


@against
def borderless_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.borderless_confidence(measures.rows_of_words(fx.doc_lines(spark, sf_dir)), PAGE)


@against
def table_reject_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = 2 + (F.col("doc_id") + F.col("page")) % 2 * (F.col("seq") % 2)
    return measures.reject_reason(measures.rows_of_words(fx.doc_lines(spark, sf_dir)), PAGE, width)


@against
def panel_text_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.doc_lines(spark, sf_dir)
    return measures.panel_text_ratio(lines, fx.doc_fills(lines))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of documents; some have nothing to be scored on."""
    d = F.col("doc_id")
    rows = fx.table(spark, sf_dir, "documents").join(fx.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select(
        "doc_id", ((F.col("n_chars") % 97).cast("double") / 97).alias("nid"), F.when(F.col("quality").isNotNull(), (F.col("quality") + d % 3).cast("double") / 4).alias("teds"), F.when(d % 2 == 0, (d % 11).cast("double") / 11).alias("mhs")
    )


@against
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).withColumn("overall", measures.overall())


@against
def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.macro_scores(_scores(spark, sf_dir))


@against
def score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = spark.createDataFrame([("nid", 0.4, 0.45), ("teds", 0.8, 0.3), ("mhs", 0.3, 0.9), ("overall", 0.1, 0.1)], "metric string, floor double, base double")
    return measures.gate(_scores(spark, sf_dir), policy)


@against
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.summary(_scores(spark, sf_dir))


@against
def inventory_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fx.table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    named = files.select(F.col("source").alias("folder"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.length("text").alias("size"), F.sha2("text", 256).alias("digest"))
    return measures.inventory(named, ["folder"])


@against
def asset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", measures.asset_name(F.col("html")).alias("asset"), F.length("html").alias("size"))


@against
def uniform_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.uniform(fx.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "field"), ["field"], "o_orderstatus", "appearance", "widgets")


@against
def claim_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("node"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("claim"), (F.col("l_linenumber") % 2).alias("page"), (~(F.col("l_discount") > 0.09)).alias("checked"))
    return measures.validate_claims(claims)


@against
def line_owner_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.vote(_lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("line"), F.col("l_returnflag").alias("owner")), "line", "owner")


@against
def cell_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("table_id")
    cells = fx.table_cells(spark, sf_dir)
    read = lambda span, text: cells.select("table_id", "row_idx", "col", F.lit(1).alias("rowspan"), span.alias("colspan"), F.when(F.col("row_idx") == 0, "th").otherwise("td").alias("role"), text.alias("txt"))
    expected = read(F.lit(1), F.lower("txt"))
    actual = read(F.when((k % 10 == 0) & (F.col("col") == 2), 2).otherwise(1), F.when((k % 6 == 0) & (F.col("row_idx") == 1), "x").otherwise(F.lower("txt")))
    return measures.compare_cells(expected, actual)


@against
def directory_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.table(spark, sf_dir, "pages")
    changed = F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html"))
    listed = lambda without, content: pages.filter(~F.contains("url", F.lit(without))).select(F.col("page_id").alias("path"), F.length("html").alias("size"), F.sha2(content, 256).alias("sha"))
    return measures.directory_difference(listed("#", F.col("html")), listed("?", changed))


@against
def multiset_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.doc_lines(spark, sf_dir)
    return measures.multiset_difference(lines, lines.filter(~((F.col("doc_id") % 9 == 0) & (F.col("seq") == 3))), ["doc_id"], "text")


@against
def event_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") + F.col("seq")
    kinds = F.array(*[F.when(k % (rank + 2) == 0, F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))) for rank, kind in enumerate(admission.EVENT_CONFIDENCE, 1)])
    events = fx.doc_lines(spark, sf_dir).select(*PAGE, "seq", F.explode(F.filter(kinds, lambda e: e.isNotNull())).alias("e")).select(*PAGE, "seq", "e.*")
    return admission.claimed_regions(events)


@against
def prune_edge_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("col"), F.col("table_id")
    left, right = (c == 0) & (k % 3 == 0), (c == 2) & (k % 5 == 0)
    return admission.kept_columns(fx.table_cells(spark, sf_dir).select("table_id", "col", F.when(left | right, "").otherwise(F.col("txt")).alias("txt"), F.when(left, 8).when(right, 10).otherwise(200).alias("width")))


@against
def column_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.length("txt") * 8
    side = (F.col("table_id") + F.col("col")) % 3
    shift = F.when(side == 0, F.lit(4.0)).when(side == 1, 100 - w - 4).otherwise((100 - w) / 2.0)
    return admission.alignments(fx.table_cells(spark, sf_dir).filter(F.length("txt") > 0).select("table_id", "col", (F.col("x0") + shift).alias("x"), w.alias("w"), "x0", "x1"))


@against
def artifact_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.recovered(fx.doc_lines(spark, sf_dir), fx.PAGE_HEIGHT)


@against
def tagged_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    nodes = _lineitem(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("node"), F.col("l_partkey").alias("k"), F.when(flag == "A", "paragraph").when(flag == "N", "heading").otherwise("list").alias("old"),
        F.when(F.col("l_linestatus") == "F", "heading").otherwise("paragraph").alias("new"), (F.col("l_discount") * 10).alias("score"),
    )
    return admission.apply_tags(nodes).select("doc", "node", "k", "kind")


@against
def formula_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq") % 7
    line = F.when(s == 0, "so it follows:").when(s == 1, "x = a + b").otherwise(F.col("text"))
    return admission.formula_lead(fx.doc_lines(spark, sf_dir).select(*PAGE, "seq", line.alias("line"), "mono"))


@against
def strip_layout_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = F.create_map(F.lit("level"), F.col("p_size").cast("string"), F.lit("_layout_html"), F.col("p_name"), F.lit("lang"), F.col("p_brand"), F.lit("_merged"), F.lit("x"))
    return fx.table(spark, sf_dir, "part").select("p_partkey", admission.public_attributes(attrs).alias("attrs"))


@against
def node_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.doc_lines(spark, sf_dir).select(*PAGE, "seq", admission.source_json((F.col("doc_id") % 97).cast("double") / 97, F.col("page"), ["x0", "y0", "x1", "y1"]).alias("json"))


@against
def safe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("sec:"), k.cast("string"))).when(k % 4 == 1, F.col("p_name")).when(k % 4 == 2, F.concat(F.lit("gw-"), k.cast("string"))).otherwise(F.concat(F.lit("-x"), F.col("p_brand")))
    return fx.table(spark, sf_dir, "part").select("p_partkey", admission.safe_id(raw).alias("id"))


@against
def font_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("Helvetica-Bold", "CMBX10", "Times-Italic", "CourierNew", "Foo-Medium", "Source-Semibold", "DejaVuSansMono-Oblique", "Regular")
    name = F.concat(F.lit("ABCDEF+"), F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 8 + 1).cast("int")))
    return fx.table(spark, sf_dir, "part").select("p_partkey", *[c.alias(k) for k, c in admission.font_traits(name).items()])


@against
def image_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = fx.doc_images(fx.doc_lines(spark, sf_dir))
    markup = admission.image_markup(F.col("name"), (F.col("doc_id") + F.col("page")) % 3, F.col("x1") - F.col("x0"), (F.col("x0") + F.col("x1")) / 2, fx.PAGE_WIDTH / 2)
    return images.select(*PAGE, "seq", markup.alias("markup"))


@against
def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.timing(fx.table(spark, sf_dir, "events"), ["event_type"], "value")
