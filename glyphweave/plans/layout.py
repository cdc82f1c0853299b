"""Layout queries over the lines of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import layout
from .registry import query

SIGNATURE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\b(?:page\s+)?[ivxlcdm]{1,8}(\s*)$', '#\1'), '[0-9]+', '#', 'g'), '\s+', ' ', 'g'), '^[ \-|–—•·]+|[ \-|–—•·]+$', '', 'g')"""
FURNITURE = f"""
fx_marked AS (SELECT doc_id, page, seq, CASE WHEN y1 <= 792 * 0.15 THEN 'header' WHEN y0 >= 792 * 0.85 THEN 'footer' END AS zone, {SIGNATURE} AS signature FROM doc_lines),
fx_zones AS (SELECT * FROM fx_marked WHERE zone IS NOT NULL AND signature <> ''),
fx_pages AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE page % 2 = 0) AS even_pages, count(*) FILTER (WHERE page % 2 = 1) AS odd_pages FROM doc_pages GROUP BY doc_id),
fx_seen AS (SELECT doc_id, zone, signature, count(DISTINCT page) AS n, count(DISTINCT page) FILTER (WHERE page % 2 = 0) AS even, count(DISTINCT page) FILTER (WHERE page % 2 = 1) AS odd FROM fx_zones GROUP BY ALL),
fx_kept AS (SELECT s.doc_id, zone, signature FROM fx_seen s JOIN fx_pages p ON s.doc_id = p.doc_id WHERE pages >= 2 AND (
  n >= 2 AND n >= ceil(pages * 0.5) OR even_pages >= 2 AND even >= 2 AND even >= ceil(even_pages * 0.75) OR odd_pages >= 2 AND odd >= 2 AND odd >= ceil(odd_pages * 0.75))),
furniture AS (SELECT z.doc_id, z.page, z.seq, z.zone FROM fx_zones z JOIN fx_kept k ON z.doc_id = k.doc_id AND z.zone = k.zone AND z.signature = k.signature)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.doc_lines(spark, sf_dir)


@query("P-01 P-02 P-11 O-02", f"WITH {fx.DOC_LINES} SELECT doc_id, 'line-' || page || '-' || seq AS line_id, text, x0, y0, x1, y1, size, bold, mono FROM doc_lines")
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", layout.line_id().alias("line_id"), "text", "x0", "y0", "x1", "y1", "size", "bold", "mono")


@query(
    "A-02 A-03 A-05 A-06",
    f"""WITH {fx.DOC_LINES} SELECT doc_id, page, count(*) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, median(size) AS body_size,
    avg(cast(bold AS INT)) AS bold_ratio, avg(cast(mono AS INT)) AS mono_ratio FROM doc_lines GROUP BY doc_id, page""",
)
def page_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        layout.positive_median("size").alias("body_size"), F.avg(F.col("bold").cast("int")).alias("bold_ratio"), F.avg(F.col("mono").cast("int")).alias("mono_ratio"),
    )


@query("A-04 F-04 D-21", f"WITH {fx.LAYOUT},{FURNITURE} SELECT * FROM furniture")
def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.repeated_furniture(_lines(spark, sf_dir), fx.PAGE_HEIGHT)


@query("D-21 J-10", f"WITH {fx.LAYOUT},{FURNITURE} SELECT doc_id, page, seq, text FROM doc_lines l WHERE NOT EXISTS (SELECT 1 FROM furniture f WHERE f.doc_id = l.doc_id AND f.page = l.page AND f.seq = l.seq)")
def lines_without_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return layout.claim(lines, layout.repeated_furniture(lines, fx.PAGE_HEIGHT)).select("doc_id", "page", "seq", "text")


COLUMNS = """
col_tall AS (SELECT doc_id, page, seq, x0 AS sep_x, least(y0, y1) AS top, greatest(y0, y1) AS bottom FROM doc_segments WHERE x0 = x1 AND x0 BETWEEN 612 * 0.3 AND 612 * 0.7 AND abs(y1 - y0) >= 80),
col_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY bottom - top DESC, seq) AS n FROM col_tall) WHERE n = 1),
col_side AS (SELECT l.doc_id, l.page, l.seq, CASE WHEN (l.x0 + l.x1) / 2 < sep_x THEN 'left' ELSE 'right' END AS side FROM {free} l JOIN col_best b ON l.doc_id = b.doc_id AND l.page = b.page WHERE l.y0 BETWEEN top - 8 AND bottom + 8),
col_lines AS (SELECT doc_id, page, seq, side FROM (SELECT *, count(*) FILTER (WHERE side = 'left') OVER w AS ln, count(*) FILTER (WHERE side = 'right') OVER w AS rn FROM col_side WINDOW w AS (PARTITION BY doc_id, page)) WHERE ln >= 2 AND rn >= 2)
"""


@query("D-02 O-05 J-04", f"WITH {fx.LAYOUT},{COLUMNS.format(free='doc_lines')} SELECT * FROM col_lines")
def column_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return layout.column_lines(lines, fx.doc_segments(lines), fx.PAGE_WIDTH)


@query(
    "D-03 W-17",
    f"""WITH {fx.LAYOUT},
    two AS (SELECT * REPLACE (x0 % 90 + 72 + 240 * (seq % 2) AS x0, x0 % 90 + 172 + 240 * (seq % 2) AS x1) FROM doc_lines),
    rules AS (SELECT doc_id, page, seq AS rule_seq, x0 AS rule_x, least(y0, y1) AS top, greatest(y0, y1) AS bottom FROM doc_segments WHERE x0 = x1 AND width >= 1.5 AND x0 <= 612 * 0.3 AND abs(y1 - y0) >= 40),
    band AS (SELECT l.*, rule_seq, rule_x FROM two l JOIN rules r ON l.doc_id = r.doc_id AND l.page = r.page WHERE (l.y0 + l.y1) / 2 BETWEEN top - 8 AND bottom + 8 AND l.x0 >= rule_x - 3),
    starts AS (SELECT DISTINCT doc_id, page, rule_seq, round(x0, 1) AS start FROM band),
    gaps AS (SELECT *, lead(start) OVER (PARTITION BY doc_id, page, rule_seq ORDER BY start) AS nxt FROM starts),
    widest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, rule_seq ORDER BY nxt - start DESC, start) AS n FROM gaps WHERE nxt IS NOT NULL) WHERE n = 1),
    body AS (SELECT doc_id, page, rule_seq, median(size) AS body, count(*) AS cnt FROM band GROUP BY ALL),
    split AS (SELECT w.doc_id, w.page, w.rule_seq, body, nxt - start AS gap, (start + nxt) / 2 AS sep FROM widest w JOIN body b USING (doc_id, page, rule_seq) WHERE cnt >= 4 AND nxt - start >= greatest(72, body * 7)),
    sided AS (SELECT b.*, s.body, s.gap, CASE WHEN b.x0 < sep THEN 'left' ELSE 'right' END AS side FROM band b JOIN split s USING (doc_id, page, rule_seq)),
    boxes AS (SELECT doc_id, page, rule_seq, rule_x, body, gap, count(*) FILTER (WHERE side = 'left') AS ln, count(*) FILTER (WHERE side = 'right') AS rn, min(x0) FILTER (WHERE side = 'left') AS lx,
      min(y0) FILTER (WHERE side = 'left') AS l0, max(y1) FILTER (WHERE side = 'left') AS l1, min(y0) FILTER (WHERE side = 'right') AS r0, max(y1) FILTER (WHERE side = 'right') AS r1 FROM sided GROUP BY ALL),
    good AS (SELECT *, greatest(l1, r1) - least(l0, r0) + gap * 0.25 AS score FROM boxes WHERE ln >= 2 AND rn >= 2 AND least(l1 - l0, r1 - r0) > 0 AND least(l1, r1) - greatest(l0, r0) >= least(l1 - l0, r1 - r0) * 0.4 AND rule_x + greatest(4, body * 0.4) < lx),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, rule_seq) AS n FROM good) WHERE n = 1)
    SELECT s.doc_id, s.page, s.rule_seq, s.seq, s.side, b.score FROM sided s JOIN best b USING (doc_id, page, rule_seq)""",
)
def outer_rule_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    left = F.col("x0") % 90 + 240 * (F.col("seq") % 2)
    two = lines.withColumns({"x0": left + 72, "x1": left + 172})
    return layout.outer_rule_columns(two, fx.doc_segments(lines), fx.PAGE_WIDTH)


CALLOUTS = """
box AS (SELECT * FROM doc_fills f WHERE x1 - x0 BETWEEN 80 AND 650 AND y1 - y0 BETWEEN 18 AND 260 AND round(greatest(r, g, b) - least(r, g, b), 6) <= 0.18
  AND NOT EXISTS (SELECT 1 FROM doc_images i WHERE i.doc_id = f.doc_id AND i.page = f.page AND (f.x0 + f.x1) / 2 BETWEEN i.x0 - 3 AND i.x1 + 3 AND (f.y0 + f.y1) / 2 BETWEEN i.y0 - 3 AND i.y1 + 3)),
inside AS (SELECT l.doc_id, l.page, b.seq AS fill_seq, l.seq, l.mono FROM {free} l JOIN box b ON l.doc_id = b.doc_id AND l.page = b.page WHERE l.x0 >= b.x0 - 3 AND l.x1 <= b.x1 + 3 AND l.y0 >= b.y0 - 3 AND l.y1 <= b.y1 + 3),
callouts AS (SELECT doc_id, page, fill_seq, seq FROM (SELECT *, bool_and(mono) OVER (PARTITION BY doc_id, page, fill_seq) AS code FROM inside) WHERE NOT code)
"""


@query("D-05 J-11 P-03", f"WITH {fx.LAYOUT},{CALLOUTS.format(free='doc_lines')} SELECT * FROM callouts")
def callout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return layout.callout_lines(lines, fx.doc_fills(lines), fx.doc_images(lines))


NOTES = """
sep AS (SELECT doc_id, page, min(y0) AS sep_y FROM doc_segments WHERE y0 = y1 AND y0 > 792 * 0.65 AND abs(x1 - x0) BETWEEN 40 AND 612 * 0.55 GROUP BY ALL),
body AS (SELECT doc_id, page, median(size) AS body FROM {free} GROUP BY ALL),
notes AS (SELECT l.doc_id, l.page, l.seq FROM {free} l JOIN sep s ON l.doc_id = s.doc_id AND l.page = s.page JOIN body b ON l.doc_id = b.doc_id AND l.page = b.page WHERE l.y0 > sep_y AND l.size <= body * 0.95)
"""


@query("D-07 O-06", f"WITH {fx.LAYOUT},{NOTES.format(free='doc_lines')} SELECT * FROM notes")
def footnote_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return layout.footnote_lines(lines, fx.doc_segments(lines), fx.PAGE_WIDTH, fx.PAGE_HEIGHT)


@query("D-06 S-16", f"WITH {fx.LAYOUT} SELECT doc_id, 'p' || page || '-figure-' || (seq + 1) AS region_id, x0, y0, x1, y1, name, cast(0.88 AS DOUBLE) AS confidence FROM doc_images")
def figure_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = fx.doc_images(_lines(spark, sf_dir))
    return images.select("doc_id", F.format_string("p%d-figure-%d", "page", F.col("seq") + 1).alias("region_id"), "x0", "y0", "x1", "y1", "name", F.lit(0.88).alias("confidence"))


_FREE1 = "free1 AS (SELECT * FROM doc_lines l WHERE NOT EXISTS (SELECT 1 FROM furniture f WHERE f.doc_id = l.doc_id AND f.page = l.page AND f.seq = l.seq))"
_FREE2 = "boxed AS (SELECT doc_id, page, seq, min(fill_seq) AS part FROM callouts GROUP BY ALL), free2 AS (SELECT * FROM free1 l WHERE NOT EXISTS (SELECT 1 FROM boxed f WHERE f.doc_id = l.doc_id AND f.page = l.page AND f.seq = l.seq))"
_FREE3 = "free3 AS (SELECT * FROM free2 l WHERE NOT EXISTS (SELECT 1 FROM notes f WHERE f.doc_id = l.doc_id AND f.page = l.page AND f.seq = l.seq))"
REGIONS = f"""
{fx.LAYOUT},{FURNITURE},{_FREE1},{CALLOUTS.format(free='free1')},{_FREE2},{NOTES.format(free='free2')},{_FREE3},{COLUMNS.format(free='free3')},
members AS (
  SELECT doc_id, page, seq, zone AS kind, 0 AS part, CASE zone WHEN 'header' THEN 0 ELSE 7 END AS phase FROM furniture
  UNION ALL SELECT doc_id, page, seq, 'callout', part, 2 FROM boxed
  UNION ALL SELECT doc_id, page, seq, 'footnote', 0, 4 FROM notes
  UNION ALL SELECT doc_id, page, seq, 'column', CASE side WHEN 'left' THEN 0 ELSE 1 END, 5 FROM col_lines
  UNION ALL SELECT doc_id, page, seq, 'body', 0, 6 FROM free3 f WHERE NOT EXISTS (SELECT 1 FROM col_lines c WHERE c.doc_id = f.doc_id AND c.page = f.page)),
region_boxes AS (
  SELECT m.doc_id, m.page, kind, cast(part AS BIGINT) AS part, phase, count(*) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
  FROM members m JOIN doc_lines l ON m.doc_id = l.doc_id AND m.page = l.page AND m.seq = l.seq GROUP BY ALL
  UNION ALL SELECT doc_id, page, 'figure', seq, 3, 0, x0, y0, x1, y1 FROM doc_images),
regions AS (
  SELECT doc_id, page, kind, part, n_lines, x0, y0, x1, y1,
    cast(CASE kind WHEN 'header' THEN 0.94 WHEN 'callout' THEN 0.78 WHEN 'figure' THEN 0.88 WHEN 'footnote' THEN 0.74 WHEN 'column' THEN 0.92 WHEN 'body' THEN 0.86 ELSE 0.94 END AS DOUBLE) AS confidence,
    row_number() OVER (PARTITION BY doc_id ORDER BY page, phase, part) - 1 AS reading_order
  FROM region_boxes)
"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return layout.detect_regions(lines, fx.doc_segments(lines), fx.doc_fills(lines), fx.doc_images(lines), fx.PAGE_WIDTH, fx.PAGE_HEIGHT)


@query("D-01 W-13 J-10 O-01 U-01", f"WITH {REGIONS} SELECT * FROM regions")
def region_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir)


@query(
    "A-13 S-42 A-02",
    f"WITH {REGIONS} SELECT doc_id, kind, count(*) AS n_regions, cast(sum(n_lines) AS BIGINT) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(reading_order) AS first_order, max(reading_order) AS last_order FROM regions GROUP BY doc_id, kind",
)
def region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).groupBy("doc_id", "kind").agg(
        F.count(F.lit(1)).alias("n_regions"), F.sum("n_lines").alias("n_lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.min("reading_order").alias("first_order"), F.max("reading_order").alias("last_order"),
    )


@query(
    "P-10 S-43 P-09",
    f"""WITH {REGIONS} SELECT doc_id, reading_order, 'p' || page || '-' || kind || '-' || (reading_order + 1) || ' page=' || page || ' kind=' || kind || ' confidence=' || printf('%.2f', confidence) AS line,
    '<rect x="' || printf('%.1f', x0) || '" y="' || printf('%.1f', y0) || '" width="' || printf('%.1f', x1 - x0) || '" height="' || printf('%.1f', y1 - y0) || '" class="' || kind || '"/>' AS overlay
    FROM regions WHERE confidence < 0.9""",
)
def explain_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = regions(spark, sf_dir).filter("confidence < 0.9")
    line = F.format_string("p%d-%s-%d page=%d kind=%s confidence=%.2f", "page", "kind", F.col("reading_order") + 1, "page", "kind", "confidence")
    box = F.format_string('<rect x="%.1f" y="%.1f" width="%.1f" height="%.1f" class="%s"/>', "x0", "y0", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), "kind")
    return low.select("doc_id", "reading_order", line.alias("line"), box.alias("overlay"))


@query(
    "J-09 A-01 D-21",
    f"""WITH {REGIONS} SELECT doc_id, 'line-' || page || '-' || seq AS line_id, list_sort(list(DISTINCT 'p' || page || '-' || kind || '-' || (part + 1))) AS region_ids FROM members GROUP BY doc_id, page, seq""",
)
def line_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    members = layout.region_members(lines, fx.doc_segments(lines), fx.doc_fills(lines), fx.doc_images(lines), fx.PAGE_WIDTH, fx.PAGE_HEIGHT)
    name = F.format_string("p%d-%s-%d", "page", "kind", F.col("part") + 1)
    return members.groupBy("doc_id", "page", "seq").agg(F.array_sort(F.collect_set(name)).alias("region_ids")).select("doc_id", layout.line_id().alias("line_id"), "region_ids")


@query(
    "W-15 F-16",
    f"""WITH {fx.DOC_LINES}, g AS (SELECT doc_id, page, seq, y0 - lag(y0) OVER (PARTITION BY doc_id, page ORDER BY seq) AS pitch FROM doc_lines)
    SELECT doc_id, page, median(pitch) AS pitch, max(pitch) AS widest, count(*) FILTER (WHERE pitch > 17 + greatest(1, 0.12 * 17)) AS breaks FROM g WHERE pitch IS NOT NULL GROUP BY doc_id, page""",
)
def line_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "page").orderBy("seq")
    g = _lines(spark, sf_dir).withColumn("pitch", F.col("y0") - F.lag("y0").over(w)).filter("pitch IS NOT NULL")
    return g.groupBy("doc_id", "page").agg(F.median("pitch").alias("pitch"), F.max("pitch").alias("widest"), F.count_if(F.col("pitch") > 17 + max(1, 0.12 * 17)).alias("breaks"))
