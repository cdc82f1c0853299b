"""What nodes may become: claims of detectors, columns of tables, recovered artifacts, roles from tags; and what is put out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import ordered

PAGE = ["doc_id", "page"]
#: How sure a region of each sort is when its lines are claimed by an event.
EVENT_CONFIDENCE = {"table": 0.94, "callout": 0.9, "equation": 0.86}


def claimed_regions(events: DataFrame) -> DataFrame:
    """Lines go to the first of the events that claim them; how many each sort of event has on a page. events: doc_id, page, seq, rank, kind."""
    sure = F.create_map(*[F.lit(x) for pair in EVENT_CONFIDENCE.items() for x in pair])
    owned = events.groupBy(*PAGE, "seq").agg(F.min_by("kind", "rank").alias("kind"))
    return owned.groupBy(*PAGE, "kind").agg(F.count(F.lit(1)).alias("n_lines")).withColumn("confidence", sure[F.col("kind")])


def kept_columns(cells: DataFrame, narrow: float = 12, share: float = 0.03) -> DataFrame:
    """Columns of tables without empty, narrow ones at an edge. cells: table_id, col, txt, width."""
    columns = cells.groupBy("table_id", "col").agg(F.max("width").alias("width"), F.max(F.length("txt")).alias("longest"))
    of_table = Window.partitionBy("table_id")
    seen = columns.withColumn("_all", F.sum("width").over(of_table)).withColumn("_n", F.count(F.lit(1)).over(of_table)).withColumn("_low", F.min("col").over(of_table)).withColumn("_high", F.max("col").over(of_table))
    vacant = (F.col("_n") > 2) & (F.col("longest") == 0) & (F.col("width") <= narrow) & (F.col("width") <= F.col("_all") * share) & ((F.col("col") == F.col("_low")) | (F.col("col") == F.col("_high")))
    return seen.filter(~vacant).select("table_id", "col")


def alignments(texts: DataFrame) -> DataFrame:
    """The side on which a column's texts stand most evenly, left of equals. texts: table_id, col, x (of the text), w, x0, x1 (of the cell)."""
    even = lambda c: F.round(F.var_pop(c), 6)
    seen = texts.groupBy("table_id", "col").agg(
        even(F.col("x") - F.col("x0")).alias("left"), even(F.col("x1") - F.col("x") - F.col("w")).alias("right"), even(F.col("x") + F.col("w") / 2 - (F.col("x0") + F.col("x1")) / 2).alias("center"), F.count(F.lit(1)).alias("n")
    )
    least = F.least("left", "right", "center")
    side = F.when((F.col("n") < 2) | (F.col("left") == least), "left").when(F.col("right") <= F.col("center"), "right").otherwise("center")
    return seen.select("table_id", "col", side.alias("alignment"))


def recovered(lines: DataFrame, height: float, size: float = 11, short: int = 60, top: float = 0.15, bottom: float = 0.85) -> DataFrame:
    """Bold lines within the margins that were taken for artifacts: short large ones are headings, the others callouts."""
    heading = (F.col("size") >= size) & (F.length("text") <= short)
    inside = lines.filter(F.col("bold") & (F.col("y0") > height * top) & (F.col("y1") < height * bottom))
    return inside.select(*PAGE, "seq", F.when(heading, "heading").otherwise("callout").alias("kind"), F.when(heading, 0.86).otherwise(0.88).alias("confidence"), F.lit("artifact_recovered").alias("evidence"))


#: Role changes that a tag may ask for.
CHANGES = (("paragraph", "heading"), ("heading", "paragraph"), ("paragraph", "quote"))


def apply_tags(nodes: DataFrame, enough: float = 0.55) -> DataFrame:
    """The kind of each node after its tag: a change that is allowed, and sure enough, and doesn't take the first heading. nodes: node, old, new, score."""
    allowed = F.lit(False)
    for old, new in CHANGES:
        allowed = allowed | ((F.col("old") == old) & (F.col("new") == new))
    first = (F.col("node") == 1) & (F.col("old") == "heading")
    return nodes.withColumn("kind", F.when(allowed & (F.col("score") >= enough) & ~first, F.col("new")).otherwise(F.col("old")))


def formula_lead(lines: DataFrame) -> DataFrame:
    """Lines ending in a colon that a formula or code follows on the page. lines: doc_id, page, seq, line, mono."""
    w = ordered(PAGE, "seq")
    following, code = F.lead("line").over(w), F.lead("mono").over(w)
    leads = F.endswith("line", F.lit(":")) & (following.rlike(r"^[A-Za-z0-9_ ]{1,12}\s*[=<>+*/-]") | code)
    return lines.withColumn("_leads", leads).filter("_leads").select(*PAGE, "seq")


def public_attributes(attrs: Column) -> Column:
    """Attributes as name=value in order of names, without those of the layout, whose names begin with an underscore."""
    shown = F.map_filter(attrs, lambda k, _: ~F.startswith(k, F.lit("_")))
    return F.array_sort(F.transform(F.map_entries(shown), lambda e: F.concat_ws("=", e["key"], e["value"])))


def source_json(confidence: Column, page: Column, box: list[str]) -> Column:
    """A source of a node as JSON, numbers with fixed places so that equal nodes have equal texts."""
    return F.format_string('{"confidence":%.4f,"bbox":[%.3f,%.3f,%.3f,%.3f],"page":%d}', F.bround(confidence, 4), *box, page)


def safe_id(raw: Column, prefix: str = "gw-") -> Column:
    """An id as it is if it can stand in a page and isn't like those made here, else one made of its bytes."""
    plain = raw.rlike("^[A-Za-z0-9][A-Za-z0-9_.:-]*$") & ~F.startswith(raw, F.lit(prefix))
    made = F.rtrim(F.translate(F.base64(F.encode(raw, "UTF-8")), "+/=", "-_ "))
    return F.when(plain, raw).otherwise(F.concat(F.lit(prefix), made))


#: Parts of font names that tell how a font looks.
TRAITS = {"bold": ("bold", "black", "heavy", "demi", "cmbx"), "italic": ("italic", "oblique", "slanted"), "mono": ("mono", "courier", "consol", "typewriter", "cmtt")}


def font_traits(name: Column) -> dict[str, Column]:
    low = F.lower(name)
    has = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(low, p))
    return {trait: has(parts) for trait, parts in TRAITS.items()}


def image_markup(name: Column, mode: Column, width: Column, middle: Column, page_middle: float, slack: float = 12) -> Column:
    """An image in Markdown (mode 0), as an element with its width (1), or centred where it stands in the middle (2)."""
    source = F.concat(F.lit("assets/"), name, F.lit(".png"))
    plain = F.concat(F.lit("!["), name, F.lit("]("), source, F.lit(")"))
    element = lambda more: F.concat(F.lit('<img src="'), source, F.lit('" alt="'), name, more, F.lit('">'))
    sized = element(F.concat(F.lit('" width="'), width.cast("long").cast("string")))
    centred = F.concat(F.lit('<p align="center">'), element(F.lit("")), F.lit("</p>"))
    return F.when(mode == 0, plain).when(mode == 1, sized).otherwise(F.when(F.abs(middle - page_middle) <= slack, centred).otherwise(plain))
