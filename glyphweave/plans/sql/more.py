"""Folds, alignment, admission, safe attributes, figures: what the queries must give, told in SQL."""

from __future__ import annotations

from . import told

told(
    "event_claims",
    "D-08 J-10",
    """WITH e AS (SELECT doc_id, page, seq, r.rank, CASE r.rank WHEN 1 THEN 'table' WHEN 2 THEN 'callout' ELSE 'equation' END AS kind FROM doc_lines l JOIN (SELECT cast(1 AS BIGINT) AS rank UNION ALL SELECT 2 UNION ALL SELECT 3) r ON (l.doc_id + l.seq) % (r.rank + 2) = 0),
    c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, seq ORDER BY rank) AS n FROM e)
    SELECT doc_id, page, kind, count(*) AS n_lines, cast(CASE kind WHEN 'table' THEN 0.94 WHEN 'callout' THEN 0.9 ELSE 0.86 END AS DOUBLE) AS confidence FROM c WHERE n = 1 GROUP BY doc_id, page, kind""",
)
told(
    "prune_edge_columns",
    "D-16 A-09",
    """WITH c AS (SELECT table_id, row_idx, col, CASE WHEN col = 0 AND table_id % 3 = 0 THEN '' WHEN col = 2 AND table_id % 5 = 0 THEN '' ELSE txt END AS txt, CASE WHEN col = 0 AND table_id % 3 = 0 THEN 8 WHEN col = 2 AND table_id % 5 = 0 THEN 10 ELSE 200 END AS width FROM table_cells),
    k AS (SELECT table_id, col, max(width) AS width, max(length(txt)) AS longest FROM c GROUP BY table_id, col), t AS (SELECT *, sum(width) OVER (PARTITION BY table_id) AS total, count(*) OVER (PARTITION BY table_id) AS cols, min(col) OVER (PARTITION BY table_id) AS lo, max(col) OVER (PARTITION BY table_id) AS hi FROM k)
    SELECT table_id, col FROM t WHERE NOT (cols > 2 AND longest = 0 AND width <= 12 AND width <= 0.03 * total AND (col = lo OR col = hi))""",
)
told(
    "column_alignment",
    "D-17",
    """WITH g AS (SELECT table_id, col, x0 + CASE (table_id + col) % 3 WHEN 0 THEN 4 WHEN 1 THEN 100 - 8 * length(txt) - 4 ELSE (100 - 8 * length(txt)) / 2.0 END AS tx0, length(txt) * 8 AS w, x0, x1 FROM table_cells WHERE length(txt) > 0),
    v AS (SELECT table_id, col, round(var_pop(tx0 - x0), 6) AS l, round(var_pop(x1 - tx0 - w), 6) AS r, round(var_pop((tx0 + w / 2.0) - (x0 + x1) / 2), 6) AS c, count(*) AS n FROM g GROUP BY table_id, col)
    SELECT table_id, col, CASE WHEN n < 2 OR l <= r AND l <= c THEN 'left' WHEN r <= c THEN 'right' ELSE 'center' END AS alignment FROM v""",
)
told(
    "hanging_bullets",
    "D-22 W-12",
    """WITH i AS (SELECT doc_id, page, seq, x0, y0, y1, lag(x0) OVER w AS px, lead(x0) OVER w AS nx, lead(y0) OVER w AS ny FROM doc_lines WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq))
    SELECT doc_id, page, seq FROM i WHERE nx > x0 + 8 AND nx <= x0 + 60 AND ny - y1 <= 12 AND (px IS NULL OR px <> x0)""",
)
told(
    "artifact_recovery",
    "D-25 P-13",
    """SELECT doc_id, page, seq, CASE WHEN size >= 11 AND length(text) <= 60 THEN 'heading' ELSE 'callout' END AS kind, least(cast(0.96 AS DOUBLE), CASE WHEN size >= 11 AND length(text) <= 60 THEN cast(0.86 AS DOUBLE) ELSE cast(0.88 AS DOUBLE) END) AS confidence, 'artifact_recovered' AS evidence
    FROM doc_lines WHERE bold AND y0 > 792 * 0.15 AND y1 < 792 * 0.85""",
)
told(
    "tagged_prior",
    "D-40 P-17",
    """WITH n AS (SELECT l_orderkey AS doc, l_linenumber AS node, CASE l_returnflag WHEN 'A' THEN 'paragraph' WHEN 'N' THEN 'heading' ELSE 'list' END AS old, CASE l_linestatus WHEN 'F' THEN 'heading' ELSE 'paragraph' END AS new, l_discount * 10 AS score, l_partkey AS k FROM lineitem),
    allowed AS (SELECT 'paragraph' AS a, 'heading' AS b UNION ALL SELECT 'heading', 'paragraph' UNION ALL SELECT 'paragraph', 'quote')
    SELECT n.doc, n.node, n.k, CASE WHEN n.old = n.new OR (al.a IS NOT NULL AND score >= 0.55 AND NOT (n.node = 1 AND n.old = 'heading')) THEN n.new ELSE n.old END AS kind FROM n LEFT JOIN allowed al ON n.old = al.a AND n.new = al.b""",
)
told(
    "formula_continuation",
    "D-42 W-07",
    r"""WITH t AS (SELECT doc_id, page, seq, CASE WHEN seq % 7 = 0 THEN 'so it follows:' WHEN seq % 7 = 1 THEN 'x = a + b' ELSE text END AS line, mono FROM doc_lines), n AS (SELECT *, lead(line) OVER w AS nxt, lead(mono) OVER w AS nmono FROM t WINDOW w AS (PARTITION BY doc_id, page ORDER BY seq))
    SELECT doc_id, page, seq FROM n WHERE substr(line, length(line), 1) = ':' AND (regexp_matches(nxt, '^[A-Za-z0-9_ ]{1,12}\s*[=<>+*/-]\s*') OR nmono)""",
)
told(
    "thematic_rules",
    "D-20",
    """SELECT s.doc_id, s.page, s.seq FROM doc_segments s LEFT JOIN (SELECT s.doc_id, s.page, s.seq FROM doc_segments s JOIN doc_lines l ON s.doc_id = l.doc_id AND s.page = l.page AND s.y0 BETWEEN l.y1 - 1 AND l.y1 + 3 AND l.x0 < s.x1 AND l.x1 > s.x0 GROUP BY s.doc_id, s.page, s.seq) u ON s.doc_id = u.doc_id AND s.page = u.page AND s.seq = u.seq
    WHERE s.y0 = s.y1 AND u.seq IS NULL AND abs(s.x1 - s.x0) >= 60""",
)
told(
    "strip_layout_hints",
    "P-14",
    """SELECT p_partkey, list_sort(['level=' || p_size, 'lang=' || p_brand]) AS attrs FROM part""",
)
told(
    "node_json",
    "P-15 S-42",
    """SELECT doc_id, page, seq, '{"confidence":' || printf('%.4f', round_even(cast(doc_id % 97 AS DOUBLE) / 97, 4)) || ',"bbox":[' || printf('%.3f,%.3f,%.3f,%.3f', x0, y0, x1, y1) || '],"page":' || page || '}' AS json FROM doc_lines""",
)
told(
    "safe_ids",
    "F-54",
    """WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'sec:' || p_partkey WHEN 1 THEN p_name WHEN 2 THEN 'gw-' || p_partkey ELSE '-x' || p_brand END AS raw FROM part)
    SELECT p_partkey, CASE WHEN regexp_matches(raw, '^[A-Za-z0-9][A-Za-z0-9_.:-]*$') AND NOT starts_with(raw, 'gw-') THEN raw ELSE 'gw-' || rtrim(translate(base64(encode(raw)), '+/=', '-_ ')) END AS id FROM r""",
)
told(
    "font_traits",
    "F-34",
    """WITH f AS (SELECT p_partkey, 'ABCDEF+' || CASE p_partkey % 8 WHEN 0 THEN 'Helvetica-Bold' WHEN 1 THEN 'CMBX10' WHEN 2 THEN 'Times-Italic' WHEN 3 THEN 'CourierNew' WHEN 4 THEN 'Foo-Medium' WHEN 5 THEN 'Source-Semibold' WHEN 6 THEN 'DejaVuSansMono-Oblique' ELSE 'Regular' END AS name FROM part)
    SELECT p_partkey, regexp_matches(name, '(?i)bold|black|heavy|demi|cmbx') AS bold, regexp_matches(name, '(?i)italic|oblique|slanted') AS italic, regexp_matches(name, '(?i)mono|courier|consol|typewriter|cmtt') AS mono FROM f""",
)
told(
    "image_markup",
    "R-03 D-34 S-41",
    """SELECT doc_id, page, seq, CASE (doc_id + page) % 3 WHEN 0 THEN '![' || name || '](assets/' || name || '.png)' WHEN 1 THEN '<img src="assets/' || name || '.png" alt="' || name || '" width="' || cast(x1 - x0 AS BIGINT) || '">' ELSE CASE WHEN abs((x0 + x1) / 2 - 306) <= 12 THEN '<p align="center"><img src="assets/' || name || '.png" alt="' || name || '"></p>' ELSE '![' || name || '](assets/' || name || '.png)' END END AS markup FROM doc_images""",
)
told(
    "timing",
    "M-05",
    "SELECT event_type, count(*) AS pages, round(sum(value), 6) AS seconds, round(sum(value) / count(*), 9) AS seconds_per_page FROM events WHERE value IS NOT NULL GROUP BY event_type",
)
