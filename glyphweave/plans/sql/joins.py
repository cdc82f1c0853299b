"""Containment, overlap, best match, ownership: what the queries must give, told in SQL."""

from __future__ import annotations

from . import told

# Glyphs of the cells' texts, 8 wide; some lie on a border and belong to two cells.
GLYPHS = """
glyph AS (
  SELECT table_id, row_idx AS src_row, col AS src_col, k, substr(txt, cast(k + 1 AS INT), 1) AS ch, x0 + 4 + 8 * k - CASE WHEN (table_id + k) % 7 = 0 THEN 5 ELSE 0 END AS cx, y0 + 10 AS cy
  FROM (SELECT *, unnest(generate_series(0, length(txt) - 1)) AS k FROM table_cells WHERE length(txt) > 0) c)
"""
told(
    "range_join_glyph_cell",
    "J-03 D-14",
    f"""WITH {GLYPHS},
    owned AS (
      SELECT c.table_id, c.row_idx, c.col, g.ch, g.src_col, g.k FROM (SELECT *, cast(floor(y0 / 64) AS BIGINT) AS b0, cast(floor((y1 + 2) / 64) AS BIGINT) AS b1 FROM table_cells) c
      JOIN (SELECT *, cast(floor(cy / 64) AS BIGINT) AS b FROM glyph) g ON c.table_id = g.table_id AND g.b >= c.b0 AND g.b <= c.b1
      WHERE g.cx BETWEEN c.x0 - 2 AND c.x1 + 2 AND g.cy BETWEEN c.y0 - 2 AND c.y1 + 2)
    SELECT table_id, row_idx, col, count(*) AS n_glyphs, string_agg(ch, '' ORDER BY src_col, k) AS text FROM owned GROUP BY table_id, row_idx, col""",
)
told(
    "segment_table_overlap",
    "J-04",
    """WITH box AS (SELECT doc_id, page, seq, x0, y0, x1, y1 FROM doc_fills)
    SELECT b.doc_id, b.page, count(s.seq) AS touching, sum(CASE WHEN s.x0 = s.x1 THEN 1 ELSE 0 END) AS upright
    FROM box b JOIN doc_segments s ON b.doc_id = s.doc_id AND b.page = s.page
      AND greatest(s.x0, s.x1) >= b.x0 - 3 AND least(s.x0, s.x1) <= b.x1 + 3 AND greatest(s.y0, s.y1) >= b.y0 - 3 AND least(s.y0, s.y1) <= b.y1 + 3
    GROUP BY b.doc_id, b.page""",
)
OVERLAP = "greatest(0, least(f.x1, i.x1) - greatest(f.x0, i.x0)) * greatest(0, least(f.y1, i.y1) - greatest(f.y0, i.y0)) / greatest(1, least((f.x1 - f.x0) * (f.y1 - f.y0), (i.x1 - i.x0) * (i.y1 - i.y0)))"
told(
    "not_exists_overlap",
    "J-11 F-61",
    f"SELECT f.doc_id, f.page, f.seq, f.x0, f.y0, f.x1, f.y1 FROM doc_fills f LEFT ANTI JOIN doc_images i ON f.doc_id = i.doc_id AND f.page = i.page AND {OVERLAP} >= 0.5".replace("LEFT ANTI JOIN", "ANTI JOIN"),
)
told(
    "overlap_ratios",
    "F-61 U-02",
    f"SELECT f.doc_id, f.page, {OVERLAP} AS overlap, sqrt(power(greatest(0, greatest(f.x0, i.x0) - least(f.x1, i.x1)), 2) + power(greatest(0, greatest(f.y0, i.y0) - least(f.y1, i.y1)), 2)) AS distance FROM doc_fills f JOIN doc_images i ON f.doc_id = i.doc_id AND f.page = i.page",
)
# Tagged leaves are order lines, glyphs are the lines of the other numbering that share a part.
TAGGED = """
tagged AS (SELECT l_orderkey AS doc, l_partkey % 50 AS mcid, 1 + l_linenumber % 2 AS page, min(l_linenumber) AS node, max(l_returnflag) AS role FROM lineitem GROUP BY l_orderkey, l_partkey % 50, 1 + l_linenumber % 2),
glyphs AS (SELECT l_orderkey AS doc, l_partkey % 50 AS mcid, 1 + l_linenumber % 2 AS page, l_linenumber AS seq, cast(min(l_quantity) AS BIGINT) AS y0, min(substr(l_linestatus, 1, 1)) AS ch FROM lineitem WHERE l_tax > 0.01 GROUP BY l_orderkey, l_partkey % 50, 1 + l_linenumber % 2, l_linenumber)
"""
told(
    "tagged_text",
    "J-01 S-20",
    f"""WITH {TAGGED}
    SELECT t.doc, t.page, t.mcid, t.node, count(g.ch) AS n_glyphs, coalesce(string_agg(g.ch, '' ORDER BY g.page, g.seq, g.y0), '') AS text,
      CASE WHEN count(g.ch) = 0 THEN cast(0.45 AS DOUBLE) ELSE cast(0.94 AS DOUBLE) END AS confidence, CASE WHEN count(g.ch) = 0 THEN 'TAGGED_MCID_UNBOUND' END AS warning
    FROM tagged t LEFT JOIN glyphs g ON t.doc = g.doc AND t.page = g.page AND t.mcid = g.mcid GROUP BY t.doc, t.page, t.mcid, t.node""",
)
told(
    "tag_bind_scores",
    "J-02 P-17",
    """WITH tag AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS tag, l_partkey % 40 AS k, l_returnflag AS role FROM lineitem),
    geo AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey % 4 AS geo, l_partkey % 40 AS k, l_linestatus AS kind FROM lineitem),
    size_of AS (SELECT doc, tag, count(DISTINCT k) AS n FROM tag GROUP BY doc, tag),
    meet AS (SELECT t.doc, t.tag, g.geo, count(DISTINCT t.k) AS met, max(CASE WHEN t.role = 'R' AND g.kind = 'F' THEN 14 WHEN t.role = 'A' THEN 8 ELSE -18 END) AS bonus FROM tag t JOIN geo g ON t.doc = g.doc AND t.k = g.k GROUP BY t.doc, t.tag, g.geo),
    scored AS (SELECT m.doc, m.tag, m.geo, 43 + least(43, 43.0 * met / n) + bonus AS score FROM meet m JOIN size_of s ON m.doc = s.doc AND m.tag = s.tag),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc, tag ORDER BY score DESC, geo) AS n, lead(score) OVER (PARTITION BY doc, tag ORDER BY score DESC, geo) AS second FROM scored)
    SELECT doc, tag, geo, cast(score AS DOUBLE) AS score, cast(second AS DOUBLE) AS runner_up, score >= 55 AND (second IS NULL OR score - second >= 4) AS accepted FROM ranked WHERE n = 1""",
)
told(
    "outline_targets",
    "J-05 F-02 U-02",
    r"""WITH w AS (SELECT doc_id, page, seq, bold, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')), ' '), lambda x: x <> ''))) AS words FROM doc_lines),
    title AS (SELECT doc_id, page, seq AS title_seq, words FROM w WHERE bold),
    heading AS (SELECT doc_id, page, seq, words FROM w),
    pair AS (SELECT t.doc_id, t.page, t.title_seq, h.seq, 1.0 * len(list_intersect(t.words, h.words)) / greatest(1, len(list_distinct(list_concat(t.words, h.words)))) AS jaccard FROM title t JOIN heading h ON t.doc_id = h.doc_id AND t.page = h.page AND t.title_seq <> h.seq),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, title_seq ORDER BY jaccard DESC, abs(seq - title_seq), seq) AS n FROM pair WHERE jaccard >= 0.1)
    SELECT doc_id, page, title_seq, seq AS target_seq, cast(jaccard AS DOUBLE) AS jaccard, jaccard >= 0.72 AS resolved FROM ranked WHERE n = 1""",
)
told(
    "nearest_target",
    "J-06 S-22",
    """WITH dest AS (SELECT doc_id, page, cast(60 + 37 * (doc_id % 17) AS DOUBLE) AS y FROM doc_pages),
    far AS (SELECT d.doc_id, d.page, d.y, l.seq, CASE WHEN d.y BETWEEN l.y0 AND l.y1 THEN 0 ELSE least(abs(d.y - l.y0), abs(d.y - l.y1)) END AS distance FROM dest d JOIN doc_lines l ON d.doc_id = l.doc_id AND d.page = l.page),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY distance, seq) AS n FROM far)
    SELECT doc_id, page, y, seq AS target_seq, cast(distance AS DOUBLE) AS distance, distance <= 72 AS near FROM ranked WHERE n = 1""",
)
MARKED = "marked AS (SELECT doc_id, 'See Figure ' || (doc_id % 5 + 1) || ' and Table ' || (doc_id % 3) || '; cf. Eq. ' || (doc_id % 4) || ' [' || (doc_id % 9 + 1) || ', ' || (doc_id % 7 + 2) || '] in Section ' || (doc_id % 6) || '.' AS body FROM documents)"
told(
    "crossrefs",
    "J-07 F-08",
    rf"""WITH {MARKED},
    hit AS (SELECT doc_id, unnest(regexp_extract_all(body, '(Figure|Fig\.|Table|Section|Sec\.|Equation|Eq\.|Appendix)\s+[A-Za-z0-9]+', 0)) AS ref FROM marked),
    named AS (SELECT doc_id, CASE lower(split_part(ref, ' ', 1)) WHEN 'fig.' THEN 'figure' WHEN 'sec.' THEN 'section' WHEN 'eq.' THEN 'equation' ELSE lower(split_part(ref, ' ', 1)) END AS category, lower(split_part(ref, ' ', 2)) AS label, ref FROM hit),
    target AS (SELECT 'figure' AS category, cast(n_nationkey AS varchar(9)) AS label, 'fig-' || n_nationkey AS id FROM nation WHERE n_nationkey BETWEEN 1 AND 4 UNION ALL SELECT 'table', cast(n_nationkey AS varchar(9)), 'tab-' || n_nationkey FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'equation', cast(n_nationkey AS varchar(9)), 'eq-' || n_nationkey FROM nation WHERE n_nationkey IN (0, 2))
    SELECT h.doc_id, h.category, h.label, h.ref, t.id AS target_id FROM named h LEFT JOIN target t ON h.category = t.category AND h.label = t.label""",
)
told(
    "citations",
    "F-08 J-08 D-50",
    rf"""WITH {MARKED},
    hit AS (SELECT doc_id, regexp_extract(body, '\[([0-9]+(?:\s*[,;]\s*[0-9]+)*)\]', 1) AS labels FROM marked),
    piece AS (SELECT doc_id, unnest(string_split(labels, ',')) AS label FROM hit),
    label AS (SELECT doc_id, cast(trim(label) AS BIGINT) AS label FROM piece),
    note AS (SELECT cast(r_regionkey + 1 AS BIGINT) AS label, r_name AS body FROM region)
    SELECT l.doc_id, l.label, n.body AS definition, n.body IS NOT NULL AS resolved FROM label l LEFT JOIN note n ON l.label = n.label""",
)
KEYS = "SELECT l_orderkey AS doc, l_returnflag AS node, list_sort(list(DISTINCT l_partkey % 12)) AS keys FROM lineitem GROUP BY l_orderkey, l_returnflag"
told(
    "ownership_equality",
    "J-15 J-16 U-03",
    f"""WITH a AS ({KEYS}), b AS ({KEYS.replace("l_returnflag", "l_linestatus")})
    SELECT a.doc, a.node, b.node AS other, a.keys = b.keys AS exact, cast(len(list_filter(a.keys, lambda x: NOT list_contains(b.keys, x))) AS BIGINT) AS missing, cast(len(list_intersect(a.keys, b.keys)) AS BIGINT) AS shared FROM a JOIN b ON a.doc = b.doc""",
)
told(
    "covered_top_level",
    "J-18 D-41",
    """WITH node AS (SELECT l_orderkey AS doc, l_linenumber AS idx, list_sort(list(DISTINCT l_partkey % 20)) AS keys FROM lineitem GROUP BY l_orderkey, l_linenumber),
    claim AS (SELECT l_orderkey AS doc, list(DISTINCT l_partkey % 20) AS keys FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 GROUP BY l_orderkey),
    covered AS (SELECT n.doc, n.idx FROM node n JOIN claim c ON n.doc = c.doc WHERE len(list_filter(n.keys, lambda x: NOT list_contains(c.keys, x))) = 0)
    SELECT doc, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx, max(idx) - min(idx) + 1 = count(*) AS contiguous FROM covered GROUP BY doc""",
)
told(
    "closed_outlines",
    "J-14 D-60",
    """WITH flat AS (SELECT doc_id, page, seq, x0, x1, y0 AS y, 0 AS top FROM doc_fills UNION ALL SELECT doc_id, page, seq + 100, x0 + page % 3, x1, y1, 1 FROM doc_fills),
    upright AS (SELECT doc_id, page, seq, x0 AS x, y0, y1 FROM doc_fills UNION ALL SELECT doc_id, page, seq + 100, x1, y0, y1 FROM doc_fills),
    pair AS (SELECT a.doc_id, a.page, a.seq, a.x0, a.x1, a.y AS y0, b.y AS y1 FROM flat a JOIN flat b ON a.doc_id = b.doc_id AND a.page = b.page AND a.top = 0 AND b.top = 1 WHERE abs(a.x0 - b.x0) <= 2.5 AND abs(a.x1 - b.x1) <= 2.5 AND b.y - a.y BETWEEN 8 AND 96),
    side AS (SELECT p.doc_id, p.page, p.seq, p.x0, p.y0, p.x1, p.y1, sum(CASE WHEN abs(u.x - p.x0) <= 2.5 THEN 1 ELSE 0 END) AS lefts, sum(CASE WHEN abs(u.x - p.x1) <= 2.5 THEN 1 ELSE 0 END) AS rights
      FROM pair p JOIN upright u ON p.doc_id = u.doc_id AND p.page = u.page AND (cast(floor(u.x / 8) AS BIGINT) BETWEEN cast(floor(p.x0 / 8) AS BIGINT) - 1 AND cast(floor(p.x0 / 8) AS BIGINT) + 1 OR cast(floor(u.x / 8) AS BIGINT) BETWEEN cast(floor(p.x1 / 8) AS BIGINT) - 1 AND cast(floor(p.x1 / 8) AS BIGINT) + 1)
      WHERE abs(u.y0 - p.y0) <= 2.5 AND abs(u.y1 - p.y1) <= 2.5 GROUP BY p.doc_id, p.page, p.seq, p.x0, p.y0, p.x1, p.y1)
    SELECT doc_id, page, round(x0 * 2) / 2 AS x0, round(y0 * 2) / 2 AS y0, round(x1 * 2) / 2 AS x1, round(y1 * 2) / 2 AS y1, min(seq) AS seq FROM side WHERE lefts > 0 AND rights > 0 GROUP BY doc_id, page, round(x0 * 2) / 2, round(y0 * 2) / 2, round(x1 * 2) / 2, round(y1 * 2) / 2""",
)
told(
    "segment_adjacency",
    "J-13",
    """WITH s AS (SELECT doc_id, page, seq, x0, y0, x1, y1 FROM doc_segments)
    SELECT a.doc_id, a.page, a.seq AS left_seq, b.seq AS right_seq, least(abs(a.x0 - b.x0) + abs(a.y0 - b.y0), abs(a.x0 - b.x1) + abs(a.y0 - b.y1), abs(a.x1 - b.x0) + abs(a.y1 - b.y0), abs(a.x1 - b.x1) + abs(a.y1 - b.y1)) AS gap
    FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seq < b.seq WHERE least(abs(a.x0 - b.x0) + abs(a.y0 - b.y0), abs(a.x0 - b.x1) + abs(a.y0 - b.y1), abs(a.x1 - b.x0) + abs(a.y1 - b.y0), abs(a.x1 - b.x1) + abs(a.y1 - b.y1)) <= 60""",
)
told(
    "visible_glyphs",
    "P-04",
    """WITH g AS (SELECT doc_id, page, seq, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, seq * 2 + 1 AS paint_order, CASE WHEN (doc_id + seq) % 5 = 0 THEN 0.98 ELSE 0.1 END AS tone, (doc_id + seq) % 17 = 0 AS hidden FROM doc_lines),
    under AS (SELECT g.doc_id, g.page, g.seq, max(f.seq) AS fill FROM g JOIN doc_fills f ON g.doc_id = f.doc_id AND g.page = f.page WHERE g.cx BETWEEN f.x0 AND f.x1 AND g.cy BETWEEN f.y0 AND f.y1 AND f.seq < g.paint_order GROUP BY g.doc_id, g.page, g.seq)
    SELECT g.doc_id, g.page, g.seq FROM g LEFT JOIN under u ON g.doc_id = u.doc_id AND g.page = u.page AND g.seq = u.seq WHERE NOT hidden AND (tone < 0.9 OR u.fill IS NOT NULL)""",
)
