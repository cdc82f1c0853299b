"""What belongs to what: containment, overlap, nearness, best match, ownership. Joins are on a document, a page or a table and a further condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .runs import first_of, joined_text, ordered

PAGE = ["doc_id", "page"]


def of(alias: str):
    """Columns of one side of a join."""
    return lambda name: F.col(f"{alias}.{name}")


def same(a, b, keys: list[str]) -> Column:
    met = F.lit(True)
    for k in keys:
        met = met & (a(k) == b(k))
    return met


def glyphs_in_cells(glyphs: DataFrame, cells: DataFrame, slack: float = 2, bucket: int = 64) -> DataFrame:
    """The text of every cell: glyphs whose centre lies in its box. Cells are dealt to the bands of the page they reach, so that the join is on equal keys."""
    band = lambda c: F.floor(c / bucket).cast("long")
    reach = cells.withColumn("_band", F.explode(F.sequence(band(F.col("y0") - slack), band(F.col("y1") + slack))))
    c, g = of("c"), of("g")
    inside = g("cx").between(c("x0") - slack, c("x1") + slack) & g("cy").between(c("y0") - slack, c("y1") + slack)
    met = reach.alias("c").join(glyphs.withColumn("_band", band(F.col("cy"))).alias("g"), same(c, g, ["table_id", "_band"]) & inside)
    owned = met.select("c.table_id", "c.row_idx", "c.col", "g.src_col", "g.k", "g.ch")
    return owned.groupBy("table_id", "row_idx", "col").agg(F.count(F.lit(1)).alias("n_glyphs"), joined_text(["src_col", "k"], "ch").alias("text"))


def touching(boxes: DataFrame, segments: DataFrame, slack: float = 3) -> DataFrame:
    """How many rules touch each page's boxes, and how many of them are upright."""
    b, s = of("b"), of("s")
    met = (F.greatest(s("x0"), s("x1")) >= b("x0") - slack) & (F.least(s("x0"), s("x1")) <= b("x1") + slack) & (F.greatest(s("y0"), s("y1")) >= b("y0") - slack) & (F.least(s("y0"), s("y1")) <= b("y1") + slack)
    pairs = boxes.alias("b").join(segments.alias("s"), same(b, s, PAGE) & met)
    return pairs.groupBy("b.doc_id", "b.page").agg(F.count("s.seq").alias("touching"), F.sum(F.when(s("x0") == s("x1"), 1).otherwise(0)).alias("upright"))


def overlap(a, b) -> Column:
    """Common area over the smaller area, of two sides' boxes."""
    wide = F.greatest(F.lit(0), F.least(a("x1"), b("x1")) - F.greatest(a("x0"), b("x0")))
    high = F.greatest(F.lit(0), F.least(a("y1"), b("y1")) - F.greatest(a("y0"), b("y0")))
    area = lambda s: (s("x1") - s("x0")) * (s("y1") - s("y0"))
    return wide * high / F.greatest(F.lit(1), F.least(area(a), area(b)))


def distance(a, b) -> Column:
    apart = lambda lo, hi: F.greatest(F.lit(0), F.greatest(a(lo), b(lo)) - F.least(a(hi), b(hi)))
    return F.sqrt(F.pow(apart("x0", "x1"), F.lit(2)) + F.pow(apart("y0", "y1"), F.lit(2)))


def without_overlap(boxes: DataFrame, others: DataFrame, share: float = 0.5) -> DataFrame:
    """Boxes that no other box of the page covers by `share` of the smaller one."""
    a, b = of("f"), of("i")
    return boxes.alias("f").join(others.alias("i"), same(a, b, PAGE) & (overlap(a, b) >= share), "left_anti")


def bind_text(tagged: DataFrame, glyphs: DataFrame, bound: float = 0.94, unbound: float = 0.45) -> DataFrame:
    """The text of tagged leaves by document, page and marked-content id; a leaf without glyphs has little confidence and a warning."""
    text = glyphs.groupBy("doc", "page", "mcid").agg(F.count("ch").alias("n_glyphs"), joined_text(["page", "seq", "y0"], "ch").alias("text"))
    met = tagged.join(text, ["doc", "page", "mcid"], "left")
    none = F.coalesce("n_glyphs", F.lit(0)) == 0
    return met.select(
        "doc", "page", "mcid", "node", F.coalesce("n_glyphs", F.lit(0).cast("long")).alias("n_glyphs"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(none, F.lit(unbound)).otherwise(F.lit(bound)).alias("confidence"), F.when(none, F.lit("TAGGED_MCID_UNBOUND")).alias("warning"),
    )


def best_binding(tags: DataFrame, shapes: DataFrame, bonus: Column, base: float = 43, enough: float = 55, lead: float = 4) -> DataFrame:
    """For each tag the shape that shares most keys with it, and whether it is clearly the best. tags: doc, tag, k, role; shapes: doc, geo, k, kind; bonus: of role and kind."""
    sizes = tags.groupBy("doc", "tag").agg(F.count_distinct("k").alias("n"))
    met = tags.join(shapes, ["doc", "k"]).groupBy("doc", "tag", "geo").agg(F.count_distinct("k").alias("met"), F.max(bonus).alias("bonus"))
    scored = met.join(sizes, ["doc", "tag"]).withColumn("score", (base + F.least(F.lit(float(base)), float(base) * F.col("met") / F.col("n")) + F.col("bonus")).cast("double"))
    w = ordered(["doc", "tag"], F.col("score").desc(), "geo")
    ranked = first_of(scored.withColumn("runner_up", F.lead("score").over(w)), ["doc", "tag"], F.col("score").desc(), "geo")
    clear = (F.col("score") >= enough) & (F.col("runner_up").isNull() | (F.col("score") - F.col("runner_up") >= lead))
    return ranked.select("doc", "tag", "geo", "score", "runner_up", clear.alias("accepted"))


def title_words(text: Column) -> Column:
    """The words of a title, each once, in order of the alphabet; letters beyond a to z part words."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", " ")), " "), lambda x: x != "")))


def best_titles(titles: DataFrame, headings: DataFrame, least: float = 0.1, enough: float = 0.72) -> DataFrame:
    """The line of the page that shares most words with each title, the nearest of equals: doc_id, page, title_seq, target_seq, jaccard, resolved."""
    pairs = titles.join(headings, PAGE).filter("title_seq <> seq")
    alike = F.size(F.array_intersect("title", "words")) / F.greatest(F.lit(1), F.size(F.array_union("title", "words")))
    close = pairs.withColumn("jaccard", alike.cast("double")).filter(F.col("jaccard") >= least)
    best = first_of(close, [*PAGE, "title_seq"], F.col("jaccard").desc(), F.abs(F.col("seq") - F.col("title_seq")), "seq")
    return best.select(*PAGE, "title_seq", F.col("seq").alias("target_seq"), "jaccard", (F.col("jaccard") >= enough).alias("resolved"))


def nearest_line(places: DataFrame, lines: DataFrame, near: float = 72) -> DataFrame:
    """The line at or nearest to a height on its page: places' columns, target_seq, distance, near. Combined before the shuffle."""
    far = F.when(F.col("y").between(F.col("y0"), F.col("y1")), 0.0).otherwise(F.least(F.abs(F.col("y") - F.col("y0")), F.abs(F.col("y") - F.col("y1")))).cast("double")
    met = places.join(lines.select(*PAGE, "seq", "y0", "y1"), PAGE).withColumn("distance", far)
    best = met.groupBy(*PAGE, "y").agg(F.min(F.struct("distance", "seq")).alias("b"))
    return best.select(*PAGE, "y", F.col("b.seq").alias("target_seq"), F.col("b.distance").alias("distance"), (F.col("b.distance") <= near).alias("near"))


def cross_references(texts: DataFrame, targets: DataFrame, text: str = "body") -> DataFrame:
    """Pointers to figures, tables and the like in a text, each with its target or null. targets: category, label, id."""
    ref = texts.select("doc_id", F.explode(T.pointers(F.col(text))).alias("ref"))
    word, label = F.element_at(F.split("ref", r"\s+"), 1), F.element_at(F.split("ref", r"\s+"), 2)
    named = ref.select("doc_id", T.pointer_kind(word).alias("category"), F.lower(label).alias("label"), "ref")
    return named.join(targets, ["category", "label"], "left").withColumnRenamed("id", "target_id")


def resolve_citations(texts: DataFrame, notes: DataFrame, text: str = "body") -> DataFrame:
    """The numbers of each text's first group in square brackets, and the note of each or null. notes: label, definition."""
    group = F.regexp_extract(F.col(text), r"\[([0-9\s,;]+)\]", 1)
    label = texts.select("doc_id", F.explode(F.regexp_extract_all(group, F.lit("([0-9]+)"), 1)).alias("label")).withColumn("label", F.col("label").cast("long"))
    return label.join(notes, "label", "left").withColumn("resolved", F.col("definition").isNotNull())


def key_sets(rows: DataFrame, keys: list[str], key: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(key)).alias("keys"))


def compare_ownership(a: DataFrame, b: DataFrame) -> DataFrame:
    """How the key sets of two kinds of nodes of a document agree. a, b: doc, node, keys."""
    met = a.join(b.withColumnRenamed("node", "other").withColumnRenamed("keys", "theirs"), "doc")
    count = lambda c: F.size(c).cast("long")
    return met.select("doc", "node", "other", (F.col("keys") == F.col("theirs")).alias("exact"), count(F.array_except("keys", "theirs")).alias("missing"), count(F.array_intersect("keys", "theirs")).alias("shared"))


def covered_nodes(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """Nodes whose keys a document's claim holds all of, and whether they are neighbours. nodes: doc, idx, keys; claims: doc, claimed."""
    held = nodes.join(claims, "doc").filter(F.size(F.array_except("keys", "claimed")) == 0)
    out = held.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    return out.withColumn("contiguous", F.col("last_idx") - F.col("first_idx") + 1 == F.col("n"))


def closed_outlines(flat: DataFrame, upright: DataFrame, slack: float = 2.5, low: float = 8, high: float = 96, bucket: int = 8) -> DataFrame:
    """Boxes made of two flat rules and upright ones at both ends. flat: doc_id, page, seq, x0, x1, y, top; upright: doc_id, page, x, y0, y1.

    Uprights are found by their place across the page in buckets, so that the join is on equal keys.
    """
    a, b = of("a"), of("b")
    paired = (a("top") == 0) & (b("top") == 1) & (F.abs(a("x0") - b("x0")) <= slack) & (F.abs(a("x1") - b("x1")) <= slack) & (b("y") - a("y")).between(low, high)
    pair = flat.alias("a").join(flat.alias("b"), same(a, b, PAGE) & paired).select("a.doc_id", "a.page", "a.seq", "a.x0", "a.x1", a("y").alias("y0"), b("y").alias("y1")).distinct()
    band = lambda c: F.floor(c / bucket).cast("long")
    ends = pair.withColumn("end", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("x0").alias("x")), F.struct(F.lit("r").alias("side"), F.col("x1").alias("x")))))
    ends = ends.withColumn("_band", F.explode(F.sequence(band(F.col("end.x") - slack), band(F.col("end.x") + slack))))
    sides = upright.select(*PAGE, F.col("x").alias("at"), F.col("y0").alias("from"), F.col("y1").alias("to"), band(F.col("x")).alias("_band"))
    fits = (F.abs(F.col("at") - F.col("end.x")) <= slack) & (F.abs(F.col("from") - F.col("y0")) <= slack) & (F.abs(F.col("to") - F.col("y1")) <= slack)
    met = ends.join(sides, [*PAGE, "_band"]).filter(fits).groupBy(*PAGE, "seq", "x0", "y0", "x1", "y1").agg(F.count_distinct("end.side").alias("sides")).filter("sides = 2")
    half = lambda c: (F.round(F.col(c) * 2) / 2).alias(c)
    return met.groupBy(*PAGE, *[half(c) for c in ("x0", "y0", "x1", "y1")]).agg(F.min("seq").alias("seq"))


def near_segments(segments: DataFrame, gap: float = 60) -> DataFrame:
    """Pairs of rules of a page with ends within `gap`, by the sum of both differences."""
    a, b = of("a"), of("b")
    ends = [F.abs(a(f"x{i}") - b(f"x{j}")) + F.abs(a(f"y{i}") - b(f"y{j}")) for i in (0, 1) for j in (0, 1)]
    pairs = segments.alias("a").join(segments.alias("b"), same(a, b, PAGE) & (a("seq") < b("seq")) & (F.least(*ends) <= gap))
    return pairs.select("a.doc_id", "a.page", a("seq").alias("left_seq"), b("seq").alias("right_seq"), F.least(*ends).alias("gap"))


def visible(glyphs: DataFrame, fills: DataFrame, pale: float = 0.9) -> DataFrame:
    """Glyphs that can be seen: not hidden, and not pale unless a fill that was painted before lies under them. glyphs: doc_id, page, seq, cx, cy, paint_order, tone, hidden."""
    g, f = of("g"), of("f")
    under = same(g, f, PAGE) & g("cx").between(f("x0"), f("x1")) & g("cy").between(f("y0"), f("y1")) & (f("seq") < g("paint_order"))
    shown = glyphs.filter(~F.col("hidden"))
    dark = shown.filter(F.col("tone") < pale)
    return dark.unionByName(shown.filter(F.col("tone") >= pale).alias("g").join(fills.alias("f"), under, "left_semi"))


def outside_text(rules: DataFrame, lines: DataFrame, above: float = 1, below: float = 3, least: float = 60) -> DataFrame:
    """Flat rules of some length that no line of text stands on."""
    s, t = of("s"), of("l")
    under = same(s, t, PAGE) & s("y0").between(t("y1") - above, t("y1") + below) & (t("x0") < s("x1")) & (t("x1") > s("x0"))
    flat = rules.filter((F.col("y0") == F.col("y1")) & (F.abs(F.col("x1") - F.col("x0")) >= least))
    return flat.alias("s").join(lines.alias("l"), under, "left_anti")
