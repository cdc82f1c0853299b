"""Page layout as relations: furniture, columns, callouts, figures, footnotes, reading order.

Lines have doc_id, page, seq, text, x0, y0, x1, y1, size, bold, mono. Segments, fills and images have
doc_id, page, seq and a box. Everything is keyed by (doc_id, page), so the stages share one partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PAGE = ["doc_id", "page"]


@dataclass(frozen=True)
class Limits:
    """Thresholds of the detectors (fixed values, in points and shares of the page)."""

    header_share: float = 0.15
    footer_share: float = 0.85
    furniture_share: float = 0.50
    parity_share: float = 0.75
    gutter_from: float = 0.30
    gutter_to: float = 0.70
    gutter_height: float = 80.0
    gutter_slack: float = 8.0
    outer_rule_width: float = 1.5
    outer_rule_height: float = 40.0
    start_gap: float = 72.0
    start_gap_bodies: float = 7.0
    column_overlap: float = 0.40
    callout_width: tuple[float, float] = (80.0, 650.0)
    callout_height: tuple[float, float] = (18.0, 260.0)
    callout_spread: float = 0.18
    box_slack: float = 3.0
    code_share: float = 0.70
    footnote_from: float = 0.65
    footnote_width: tuple[float, float] = (40.0, 0.55)
    footnote_size: float = 0.95


LIMITS = Limits()
CONFIDENCE = {"header": 0.94, "callout": 0.78, "figure": 0.88, "footnote": 0.74, "column": 0.92, "body": 0.86, "footer": 0.94}


def line_id(page: str = "page", seq: str = "seq") -> Column:
    return F.format_string("line-%d-%d", F.col(page), F.col(seq))


def positive_median(column: str) -> Column:
    """The median of the values above zero, 0 if there are none."""
    return F.coalesce(F.median(F.when(F.col(column) > 0, F.col(column))), F.lit(0.0))


def furniture_signature(text: Column) -> Column:
    """Text with what changes from page to page (numbers, a closing roman numeral) taken out."""
    t = F.lower(text)
    t = F.regexp_replace(t, T.PAGE_ROMAN, "#")
    t = F.regexp_replace(t, r"[0-9]+", "#")
    t = F.regexp_replace(t, r"\s+", " ")
    return F.btrim(t, F.lit(T.AROUND_HEADS))


def repeated_furniture(lines: DataFrame, height: float, limits: Limits = LIMITS) -> DataFrame:
    """Lines in the top or bottom margin whose signature repeats on enough pages: doc_id, page, seq, zone."""
    zone = F.when(F.col("y1") <= height * limits.header_share, "header").when(F.col("y0") >= height * limits.footer_share, "footer")
    marked = lines.select(*PAGE, "seq", zone.alias("zone"), furniture_signature(F.col("text")).alias("signature")).filter("zone IS NOT NULL AND signature <> ''")
    odd = lambda p: F.when(F.col("page") % 2 == p, F.col("page"))
    pages = lines.select(*PAGE).distinct().groupBy("doc_id").agg(F.count("page").alias("pages"), F.count(odd(0)).alias("even_pages"), F.count(odd(1)).alias("odd_pages"))
    seen = marked.groupBy("doc_id", "zone", "signature").agg(F.countDistinct("page").alias("n"), F.countDistinct(odd(0)).alias("even"), F.countDistinct(odd(1)).alias("odd"))
    enough = lambda n, of, share: (F.col(n) >= 2) & (F.col(n) >= F.ceil(F.col(of) * share))
    kept = seen.join(pages, "doc_id").filter(
        (F.col("pages") >= 2)
        & (
            enough("n", "pages", limits.furniture_share)
            | ((F.col("even_pages") >= 2) & enough("even", "even_pages", limits.parity_share))
            | ((F.col("odd_pages") >= 2) & enough("odd", "odd_pages", limits.parity_share))
        )
    )
    return marked.join(kept.select("doc_id", "zone", "signature"), ["doc_id", "zone", "signature"]).select(*PAGE, "seq", "zone")


def gutters(segments: DataFrame, width: float, limits: Limits = LIMITS) -> DataFrame:
    """The longest upright rule in the middle of each page: doc_id, page, sep_x, top, bottom."""
    x = (F.col("x0") + F.col("x1")) / 2
    top, bottom = F.least("y0", "y1"), F.greatest("y0", "y1")
    tall = segments.filter(F.col("x0") == F.col("x1")).select(*PAGE, "seq", x.alias("sep_x"), top.alias("top"), bottom.alias("bottom"))
    tall = tall.filter(F.col("sep_x").between(width * limits.gutter_from, width * limits.gutter_to) & (F.col("bottom") - F.col("top") >= limits.gutter_height))
    best = F.max_by(F.struct("sep_x", "top", "bottom"), F.struct(F.col("bottom") - F.col("top"), -F.col("seq"))).alias("g")
    return tall.groupBy(*PAGE).agg(best).select(*PAGE, "g.*")


def column_lines(lines: DataFrame, segments: DataFrame, width: float, limits: Limits = LIMITS) -> DataFrame:
    """Lines beside a gutter, where either side has two or more: doc_id, page, seq, side."""
    banded = lines.join(gutters(segments, width, limits), PAGE).filter(F.col("y0").between(F.col("top") - limits.gutter_slack, F.col("bottom") + limits.gutter_slack))
    sided = banded.withColumn("side", F.when((F.col("x0") + F.col("x1")) / 2 < F.col("sep_x"), "left").otherwise("right"))
    page = Window.partitionBy(*PAGE)
    counted = sided.withColumn("left_n", F.count_if(F.col("side") == "left").over(page)).withColumn("right_n", F.count_if(F.col("side") == "right").over(page))
    return counted.filter("left_n >= 2 AND right_n >= 2").select(*PAGE, "seq", "side")


def outer_rule_columns(lines: DataFrame, segments: DataFrame, width: float, limits: Limits = LIMITS) -> DataFrame:
    """Two columns told by a rule at the left and the widest gap between line starts: doc_id, page, rule_seq, seq, side, score.

    Each page keeps the rule that scores best by height and gap.
    """
    rules = segments.filter((F.col("x0") == F.col("x1")) & (F.col("width") >= limits.outer_rule_width) & (F.col("x0") <= width * limits.gutter_from)).select(
        *PAGE, F.col("seq").alias("rule_seq"), F.col("x0").alias("rule_x"), F.least("y0", "y1").alias("top"), F.greatest("y0", "y1").alias("bottom")
    )
    rules = rules.filter(F.col("bottom") - F.col("top") >= limits.outer_rule_height)
    middle = (F.col("y0") + F.col("y1")) / 2
    band = lines.join(rules, PAGE).filter(middle.between(F.col("top") - limits.gutter_slack, F.col("bottom") + limits.gutter_slack) & (F.col("x0") >= F.col("rule_x") - limits.box_slack))
    key = [*PAGE, "rule_seq"]
    starts = band.groupBy(*key, F.round("x0", 1).alias("start")).agg(F.lit(1))
    gaps = starts.withColumn("next", F.lead("start").over(Window.partitionBy(*key).orderBy("start")))
    widest = gaps.filter("next IS NOT NULL").groupBy(*key).agg(F.max_by(F.struct("start", "next"), F.struct(F.col("next") - F.col("start"), -F.col("start"))).alias("w"))
    body = band.groupBy(*key).agg(positive_median("size").alias("body"), F.count(F.lit(1)).alias("n"))
    split = widest.join(body, key).filter((F.col("n") >= 4) & (F.col("w.next") - F.col("w.start") >= F.greatest(F.lit(limits.start_gap), F.col("body") * limits.start_gap_bodies)))
    sided = band.join(split.select(*key, "body", (F.col("w.next") - F.col("w.start")).alias("gap"), ((F.col("w.start") + F.col("w.next")) / 2).alias("sep")), key)
    sided = sided.withColumn("side", F.when(F.col("x0") < F.col("sep"), "left").otherwise("right"))
    at = lambda f, c, side: f(F.when(F.col("side") == side, F.col(c)))
    boxes = sided.groupBy(*key, "rule_x", "body", "gap").agg(
        F.count_if(F.col("side") == "left").alias("ln"), F.count_if(F.col("side") == "right").alias("rn"), at(F.min, "x0", "left").alias("lx"),
        at(F.min, "y0", "left").alias("l0"), at(F.max, "y1", "left").alias("l1"), at(F.min, "y0", "right").alias("r0"), at(F.max, "y1", "right").alias("r1"),
    )
    shared, least = F.least("l1", "r1") - F.greatest("l0", "r0"), F.least(F.col("l1") - F.col("l0"), F.col("r1") - F.col("r0"))
    good = boxes.filter((F.col("ln") >= 2) & (F.col("rn") >= 2) & (least > 0) & (shared >= least * limits.column_overlap) & (F.col("rule_x") + F.greatest(F.lit(4.0), F.col("body") * 0.4) < F.col("lx")))
    scored = good.withColumn("score", F.greatest("l1", "r1") - F.least("l0", "r0") + F.col("gap") * 0.25)
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.col("score").desc(), "rule_seq"))).filter("n = 1").select(*key, "score")
    return sided.join(best, key).select(*PAGE, "rule_seq", "seq", "side", "score")


def callout_lines(lines: DataFrame, fills: DataFrame, images: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Lines inside a pale box that isn't a picture's or code's: doc_id, page, fill_seq, seq."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    spread = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    boxes = fills.filter(w.between(*limits.callout_width) & h.between(*limits.callout_height) & (F.round(spread, 6) <= limits.callout_spread)).select(
        *PAGE, F.col("seq").alias("fill_seq"), *[F.col(c).alias(f"f_{c}") for c in ("x0", "y0", "x1", "y1")]
    )
    cx, cy, s = (F.col("f_x0") + F.col("f_x1")) / 2, (F.col("f_y0") + F.col("f_y1")) / 2, limits.box_slack
    on = (boxes["doc_id"] == images["doc_id"]) & (boxes["page"] == images["page"]) & cx.between(images["x0"] - s, images["x1"] + s) & cy.between(images["y0"] - s, images["y1"] + s)
    boxes = boxes.join(images, on, "left_anti")
    inside = lines.join(boxes, PAGE).filter((F.col("x0") >= F.col("f_x0") - s) & (F.col("x1") <= F.col("f_x1") + s) & (F.col("y0") >= F.col("f_y0") - s) & (F.col("y1") <= F.col("f_y1") + s))
    code = F.bool_and((F.col("mono")).cast("double") >= limits.code_share).over(Window.partitionBy(*PAGE, "fill_seq"))
    return inside.withColumn("code", code).filter("NOT code").select(*PAGE, "fill_seq", "seq")


def footnote_lines(lines: DataFrame, segments: DataFrame, width: float, height: float, limits: Limits = LIMITS) -> DataFrame:
    """Small lines below the first short rule of the lower page: doc_id, page, seq."""
    low, share = limits.footnote_width
    flat = segments.filter((F.col("y0") == F.col("y1")) & (F.col("y0") > height * limits.footnote_from) & F.abs(F.col("x1") - F.col("x0")).between(low, width * share))
    first = flat.groupBy(*PAGE).agg(F.min("y0").alias("sep_y"))
    body = lines.groupBy(*PAGE).agg(positive_median("size").alias("body"))
    return lines.join(first, PAGE).join(body, PAGE).filter((F.col("y0") > F.col("sep_y")) & (F.col("size") <= F.col("body") * limits.footnote_size)).select(*PAGE, "seq")


def claim(lines: DataFrame, taken: DataFrame) -> DataFrame:
    """Lines that no earlier detector has taken."""
    return lines.join(taken, [*PAGE, "seq"], "left_anti")


def region_members(lines: DataFrame, segments: DataFrame, fills: DataFrame, images: DataFrame, width: float, height: float, limits: Limits = LIMITS) -> DataFrame:
    """The region that takes each line: lines with kind, part and phase.

    Detectors claim lines in turn: margins, callouts, footnotes, columns, body. Beyond the joins that find
    margins, boxes and rules, all of it is windows over one page, which share a partitioning.
    """
    key = [*PAGE, "seq"]
    marked = lines.join(repeated_furniture(lines, height, limits), key, "left")
    boxed = callout_lines(marked.filter("zone IS NULL"), fills, images, limits).groupBy(*key).agg(F.min("fill_seq").alias("box"))
    low, share = limits.footnote_width
    flat = segments.filter((F.col("y0") == F.col("y1")) & (F.col("y0") > height * limits.footnote_from) & F.abs(F.col("x1") - F.col("x0")).between(low, width * share))
    rules = flat.groupBy(*PAGE).agg(F.min("y0").alias("sep_y")).join(gutters(segments, width, limits), PAGE, "full")
    page = Window.partitionBy(*PAGE)
    free = F.col("zone").isNull() & F.col("box").isNull()
    found = marked.join(boxed, key, "left").join(rules, PAGE, "left").withColumn("free", free)
    found = found.withColumn("body", F.coalesce(F.median(F.when(F.col("free") & (F.col("size") > 0), F.col("size"))).over(page), F.lit(0.0)))
    found = found.withColumn("note", F.coalesce(F.col("free") & (F.col("y0") > F.col("sep_y")) & (F.col("size") <= F.col("body") * limits.footnote_size), F.lit(False)))
    banded = F.col("free") & ~F.col("note") & F.col("y0").between(F.col("top") - limits.gutter_slack, F.col("bottom") + limits.gutter_slack)
    found = found.withColumn("side", F.when(banded, F.when((F.col("x0") + F.col("x1")) / 2 < F.col("sep_x"), 0).otherwise(1)))
    found = found.withColumn("columns", (F.count_if(F.col("side") == 0).over(page) >= 2) & (F.count_if(F.col("side") == 1).over(page) >= 2))
    kind = (
        F.when(F.col("zone").isNotNull(), F.col("zone")).when(F.col("box").isNotNull(), "callout").when(F.col("note"), "footnote")
        .when(F.col("columns") & F.col("side").isNotNull(), "column").when(~F.col("columns"), "body")
    )
    part = F.when(F.col("kind") == "callout", F.col("box")).when(F.col("kind") == "column", F.col("side")).otherwise(0).cast("long")
    return found.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("part", part).withColumn("phase", phase(F.col("kind"))).select(*lines.columns, "kind", "part", "phase")


def phase(kind: Column) -> Column:
    """The turn of a kind of region in reading order."""
    turn = ("header", "event", "callout", "figure", "footnote", "column", "body", "footer")
    return F.array_position(F.array(*map(F.lit, turn)), kind)


def detect_regions(lines: DataFrame, segments: DataFrame, fills: DataFrame, images: DataFrame, width: float, height: float, limits: Limits = LIMITS) -> DataFrame:
    """Regions of all pages: doc_id, page, kind, part, n_lines, box, confidence, reading_order.

    A region's place in reading order follows from the turn in which it is detected, headers first and footers last.
    """
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    regions = region_members(lines, segments, fills, images, width, height, limits).groupBy(*PAGE, "kind", "part", "phase").agg(F.count(F.lit(1)).alias("n_lines"), *box)
    pictures = images.select(*PAGE, F.lit("figure").alias("kind"), F.col("seq").alias("part"), phase(F.lit("figure")).alias("phase"), F.lit(0).cast("long").alias("n_lines"), "x0", "y0", "x1", "y1")
    rank = Window.partitionBy("doc_id").orderBy("page", "phase", "part")
    confidence = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]
    return regions.unionByName(pictures).select(*PAGE, "kind", "part", "n_lines", "x0", "y0", "x1", "y1", confidence.alias("confidence"), (F.row_number().over(rank) - 1).cast("long").alias("reading_order"))
