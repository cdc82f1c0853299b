"""Aggregates over what is read: provenance, modes, signatures, confidence, votes, scores and gates, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import first_of, ordered


def sorted_set(c: str | Column) -> Column:
    return F.array_sort(F.collect_set(c))


def box() -> list[Column]:
    """Aggregate: the box around boxes."""
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def merged_provenance(sources: DataFrame, keys: list[str]) -> DataFrame:
    """What the sources of each node have in common: their glyphs, regions and marked content, the box around them and the least confidence."""
    return sources.groupBy(*keys).agg(sorted_set("glyph").alias("glyph_ids"), sorted_set("region").alias("region_ids"), sorted_set("mcid").alias("mcids"), *box(), F.min("confidence").alias("confidence"))


def dominant(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value of each group, the first of equals: keys, value, n."""
    counts = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return first_of(counts, keys, F.col("n").desc(), value)


def column_counts(cells: DataFrame) -> DataFrame:
    """Columns, rows, cells and filled places of every table. cells: table_id, row_idx, col, colspan."""
    return cells.groupBy("table_id").agg(
        F.max(F.col("col") + F.col("colspan")).cast("long").alias("column_count"), F.count_distinct("row_idx").alias("row_count"), F.count(F.lit(1)).alias("cells"), F.sum("colspan").cast("long").alias("slots")
    )


def grid_signature(cells: DataFrame, unit: float) -> DataFrame:
    """The places of a table's column edges as shares of its width: one aggregation, and a second pass over each table's own edges."""
    edges = F.array_distinct(F.flatten(F.array(F.collect_set("x0"), F.collect_set(F.col("x0") + unit * F.col("colspan")))))
    tables = cells.groupBy("table_id").agg(edges.alias("edges"), F.min("x0").alias("low"), F.greatest(F.max("x1") - F.min("x0"), F.lit(1)).alias("wide"))
    shares = F.transform("edges", lambda e: F.round((e - F.col("low")) / F.col("wide"), 4))
    return tables.select("table_id", F.array_sort(F.array_distinct(F.concat(shares, F.array(F.lit(0.0), F.lit(1.0))))).alias("signature"))


def needs_html(cells: DataFrame, two_headers: Column, row_headers: Column) -> DataFrame:
    """Whether a table can't be told in Markdown: cells over several columns, more than one header row, or headers of rows."""
    spans = cells.groupBy("table_id").agg(F.bool_or(F.col("colspan") > 1).alias("spans"))
    out = spans.withColumn("two_headers", two_headers).withColumn("row_headers", row_headers)
    return out.withColumn("needs_html", F.col("spans") | F.col("two_headers") | F.col("row_headers"))


def rows_of_words(lines: DataFrame) -> DataFrame:
    """Lines with their number of words, and whether they end a sentence."""
    blanks = F.length("text") - F.length(F.regexp_replace("text", " +", ""))
    return lines.withColumn("words", blanks.cast("long") + 1).withColumn("ends", F.substring("text", -1, 1).isin(".", "?", "!"))


def borderless_confidence(rows: DataFrame, keys: list[str], few: int = 3, tall: float = 500) -> DataFrame:
    """How sure a table without rules is: less where its rows are sentences, its column count isn't steady, or it fills the page. rows: words, ends, y0, y1."""
    seen = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ends").cast("int")).alias("closing"), (F.max("y1") - F.min("y0")).alias("span"), F.count_distinct(F.col("words") % 3).alias("kinds"))
    steady = F.when(F.col("kinds") == 1, F.lit(0.04)).otherwise(F.lit(-0.1))
    prose = F.least(F.lit(0.18), F.col("closing").cast("double") / F.col("n") * 0.25)
    filling = F.when(F.col("span") > tall, F.lit(0.18)).otherwise(F.lit(0.0))
    sure = F.greatest(F.lit(0.5), F.least(F.lit(0.96), F.lit(0.88) + steady - prose - filling))
    return seen.select(*keys, F.when(F.col("n") < few, F.lit(0.55)).otherwise(sure).alias("confidence"))


def reject_reason(rows: DataFrame, keys: list[str], width: Column) -> DataFrame:
    """Why rows of text are no table, or null. rows: words, ends, text, y0, y1; width: how many columns a row has."""
    share = lambda c: F.avg(c.cast("int"))
    seen = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(width).alias("widths"), share(F.col("ends")).alias("sentence"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY words)").alias("middle"),
        share(F.col("words") > 8).alias("long"), (F.max("y1") - F.min("y0")).alias("span"), share(F.col("text").rlike("(19|20)[0-9][0-9]|https?://")).alias("published"),
    )
    against = [
        ("too_few_rows", F.col("n") < 3),
        ("unstable_column_count", F.col("widths") != 1),
        ("bibliography_pattern", F.col("published") >= 0.45),
        ("article_prose", (F.col("sentence") >= 0.6) & (F.col("middle") >= 8)),
        ("page_spanning_columns", (F.col("span") > 500) & (F.col("sentence") >= 0.35)),
        ("wrapped_prose_column", F.col("long") >= 0.5),
    ]
    return seen.select(*keys, F.coalesce(*[F.when(c, F.lit(name)) for name, c in against]).alias("reason"))


def panel_text_ratio(lines: DataFrame, panels: DataFrame) -> DataFrame:
    """The share of a page's letters whose line has its middle in a panel, for pages with panels."""
    l, f = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"f.{c}"))
    inside = ((l("x0") + l("x1")) / 2).between(f("x0"), f("x1")) & ((l("y0") + l("y1")) / 2).between(f("y0"), f("y1"))
    met = lines.alias("l").join(panels.alias("f"), (l("doc_id") == f("doc_id")) & (l("page") == f("page")))
    each = met.groupBy("l.doc_id", "l.page", "l.seq").agg(F.max(F.length("l.text")).alias("chars"), F.max(inside.cast("int")).alias("inside"))
    return each.groupBy("doc_id", "page").agg((F.sum(F.col("chars") * F.col("inside")).cast("double") / F.sum("chars")).alias("ratio"))


METRICS = ("nid", "teds", "mhs")


def overall(metrics: tuple[str, ...] = METRICS) -> Column:
    """The mean of the metrics that a document has."""
    total = sum((F.coalesce(m, F.lit(0.0)) for m in metrics[1:]), F.coalesce(metrics[0], F.lit(0.0)))
    return total / sum((F.col(m).isNotNull().cast("int") for m in metrics[1:]), F.col(metrics[0]).isNotNull().cast("int"))


def macro_scores(scores: DataFrame) -> DataFrame:
    """Means over documents, each metric over those that have it."""
    means = [F.round(F.avg(c), 9).alias(n) for n, c in (("overall", overall()), *((m, F.col(m)) for m in METRICS))]
    return scores.agg(*means, *[F.count(m).alias(f"{m}_docs") for m in METRICS[1:]], F.count(F.lit(1)).alias("docs"))


def gate(scores: DataFrame, policy: DataFrame, slack: float = 0.001) -> DataFrame:
    """Means against their floors and against an earlier run. policy: metric, floor, base."""
    means = scores.agg(F.avg(overall()).alias("overall"), *[F.avg(m).alias(m) for m in METRICS]).unpivot([], [*METRICS, "overall"], "metric", "v")
    met = means.join(policy, "metric").withColumn("above_floor", F.col("v") >= F.col("floor")).withColumn("not_worse", F.col("v") >= F.col("base") - slack)
    return met.select("metric", F.round("v", 9).alias("value"), "above_floor", "not_worse", (F.col("above_floor") & F.col("not_worse")).alias("passed"))


def summary(scores: DataFrame, enough: float = 0.5) -> DataFrame:
    passed = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return scores.agg(F.count(F.lit(1)).alias("documents"), passed(overall() >= enough).alias("passed"), passed(overall() < enough).alias("failed"))


def inventory(files: DataFrame, keys: list[str]) -> DataFrame:
    """Files, bytes and one digest of a folder's names, sizes and contents in order of names. files: name, size, digest."""
    entry = F.concat_ws("\x00", "name", F.col("size").cast("string"), "digest")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", entry.alias("entry")))), lambda x: x["entry"]), "\n")
    return files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"), F.sha2(listed, 256).alias("inventory"))


def asset_name(content: Column, kind: str = "vector", ending: str = "svg") -> Column:
    """A name that follows from what is in it."""
    return F.concat(F.lit(f"assets/{kind}-"), F.substring(F.sha2(content, 256), 1, 16), F.lit(f".{ending}"))


def uniform(values: DataFrame, keys: list[str], value: str, name: str, count: str) -> DataFrame:
    """The one value that all rows of a group have, or null."""
    one = (F.count_distinct(value) == 1) & (F.count(value) == F.count(F.lit(1)))
    return values.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), F.when(one, F.max(value)).alias(name))


def validate_claims(claims: DataFrame) -> DataFrame:
    """Whether what a node claims is checked, on one page, and claimed once. claims: node, claim, page, checked."""
    seen = claims.groupBy("node").agg(F.bool_and("checked").alias("checked"), F.count_distinct("page").alias("pages"), F.count(F.lit(1)).alias("n"), F.count_distinct("claim").alias("distinct"))
    reason = F.when(~F.col("checked"), "unvalidated_claim").when(F.col("pages") != 1, "several_pages").when(F.col("n") != F.col("distinct"), "duplicate_claim").otherwise("ok")
    return seen.select("node", reason.alias("reason"))


def vote(votes: DataFrame, line: str, owner: str, most: float = 0.9, rest: float = 0.05) -> DataFrame:
    """The owner that most of a line's glyphs name, its share, the next one's, and whether that is clear."""
    counts = votes.groupBy(line, owner).agg(F.count(F.lit(1)).alias("n"))
    w = ordered([line], F.col("n").desc(), owner)
    shares = counts.withColumn("_all", F.sum("n").over(Window.partitionBy(line))).withColumn("_second", F.lead("n").over(w))
    best = first_of(shares, [line], F.col("n").desc(), owner)
    out = best.select(line, owner, (F.col("n").cast("double") / F.col("_all")).alias("coverage"), F.coalesce(F.col("_second").cast("double") / F.col("_all"), F.lit(0.0)).alias("runner_up"))
    return out.withColumn("owned", (F.col("coverage") >= most) & (F.col("runner_up") <= rest))


CELL = ["rowspan", "colspan", "role", "txt"]


def compare_cells(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Whether two readings of every table have the same cells, and the same spans. Both: table_id, row_idx, col, rowspan, colspan, role, txt."""
    key = ["table_id", "row_idx", "col"]
    sides = expected.select(*key, F.struct(*CELL).alias("e")).join(actual.select(*key, F.struct(*CELL).alias("a")), key, "full")
    whole = F.coalesce(F.col("e") == F.col("a"), F.lit(False))
    spans = F.coalesce((F.col("e.rowspan") == F.col("a.rowspan")) & (F.col("e.colspan") == F.col("a.colspan")), F.lit(False))
    score = lambda c: F.when(F.bool_and(c), F.expr("1.0")).otherwise(F.expr("0.0"))
    return sides.groupBy("table_id").agg(score(whole).alias("cell_exact"), score(spans).alias("span_exact"), F.count("e").alias("expected_cells"), F.count("a").alias("actual_cells"))


def directory_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """What became of every path. Both: path, size, sha."""
    sides = expected.select("path", F.struct("size", "sha").alias("e")).join(actual.select("path", F.struct("size", "sha").alias("a")), "path", "full")
    state = F.when(F.col("e").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("e") != F.col("a"), "changed").otherwise("same")
    return sides.select("path", state.alias("state"))


def multiset_difference(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How many values, counted as often as they stand there, are lost in each group. One aggregation: no join."""
    sides = before.select(*keys, value, F.lit(1).alias("d")).unionByName(after.select(*keys, value, F.lit(-1).alias("d")))
    left = sides.groupBy(*keys, value).agg(F.greatest(F.sum("d"), F.lit(0).cast("long")).alias("lost"))
    return left.groupBy(*keys).agg(F.sum("lost").alias("missing")).withColumn("equal", F.col("missing") == 0)


def timing(runs: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """Pages, seconds, and seconds a page of every kind of run."""
    seen = runs.filter(F.col(seconds).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), F.sum(seconds).alias("_all"))
    return seen.select(*keys, "pages", F.round("_all", 6).alias("seconds"), F.round(F.col("_all") / F.col("pages"), 9).alias("seconds_per_page"))
