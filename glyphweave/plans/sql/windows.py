"""Runs, islands, continuation, nesting, order: what the queries must give, told in SQL."""

from __future__ import annotations

from . import told

told(
    "gap_clusters",
    "W-01 D-11",
    """WITH v AS (SELECT l_orderkey AS grp, cast(l_quantity AS DOUBLE) AS v, l_partkey AS tie FROM lineitem), g AS (SELECT grp, v, tie, CASE WHEN v - lag(v) OVER (PARTITION BY grp ORDER BY v, tie) <= 2 THEN 0 ELSE 1 END AS new FROM v),
    c AS (SELECT grp, v, sum(new) OVER (PARTITION BY grp ORDER BY v, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM g)
    SELECT grp, cast(cluster AS BIGINT) AS cluster, avg(v) AS centre, min(v) AS low, max(v) AS high, count(*) AS n FROM c GROUP BY grp, cluster""",
)
told(
    "start_gap_split",
    "W-17 D-03",
    """WITH s AS (SELECT DISTINCT l_orderkey AS grp, round(l_quantity, 1) AS x FROM lineitem), g AS (SELECT grp, x, lead(x) OVER (PARTITION BY grp ORDER BY x) AS nxt FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY nxt - x DESC, x) AS k FROM g WHERE nxt IS NOT NULL)
    SELECT grp, x AS left_start, nxt AS right_start, nxt - x AS gap, (x + nxt) / 2 AS separator FROM r WHERE k = 1""",
)
told(
    "coalesce_runs",
    "W-03 D-31 F-17",
    """WITH t AS (SELECT conv_id, turn, text, substr(text, 1, 1) IN ('A', 'B', 'C', 'D', 'E', 'F', 'G', 'H', 'I', 'J', 'K') AS style FROM conversations WHERE text IS NOT NULL),
    f AS (SELECT *, CASE WHEN style = lag(style) OVER (PARTITION BY conv_id ORDER BY turn, text) THEN 0 ELSE 1 END AS new FROM t), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f)
    SELECT conv_id, cast(run AS BIGINT) AS run, max(style) AS style, count(*) AS parts, string_agg(text, '' ORDER BY turn, text) AS text FROM r GROUP BY conv_id, run""",
)
KIND = "CASE WHEN (doc_id + seq) % 11 = 0 THEN 'heading' WHEN (doc_id + seq) % 11 IN (2, 3, 4) THEN 'list' WHEN (doc_id + seq) % 11 = 7 THEN 'table' ELSE 'paragraph' END"
told(
    "list_event_groups",
    "W-05 D-30",
    f"""WITH e AS (SELECT doc_id, page, seq, {KIND} AS kind FROM doc_lines), i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) - row_number() OVER (PARTITION BY doc_id, page, kind ORDER BY seq) AS island FROM e)
    SELECT doc_id, page, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS events FROM i WHERE kind = 'list' GROUP BY doc_id, page, island""",
)
told(
    "reference_runs",
    "W-06 D-14 F-11",
    """WITH m AS (SELECT doc_id, page, seq, seq + 2 * cast(floor((seq + doc_id) / 6) AS BIGINT) AS label FROM doc_lines), g AS (SELECT *, label - lag(label) OVER (PARTITION BY doc_id, page ORDER BY seq) AS step FROM m),
    r AS (SELECT *, sum(CASE WHEN step = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)
    SELECT doc_id, page, min(seq) AS first_seq, min(label) AS first_label, max(label) AS last_label, count(*) AS n FROM r GROUP BY doc_id, page, run HAVING count(*) >= 2""",
)
told(
    "continuation_join",
    "W-07 W-09",
    """WITH b AS (SELECT doc_id, page, min(seq) AS lo, max(seq) AS hi FROM doc_lines GROUP BY doc_id, page), last AS (SELECT l.doc_id, l.page, l.text FROM doc_lines l JOIN b ON l.doc_id = b.doc_id AND l.page = b.page AND l.seq = b.hi), first AS (SELECT l.doc_id, l.page, l.text FROM doc_lines l JOIN b ON l.doc_id = b.doc_id AND l.page = b.page AND l.seq = b.lo)
    SELECT a.doc_id, a.page AS from_page, substr(a.text, length(a.text), 1) NOT IN ('.', '?', '!', ':') AS continues, CASE WHEN substr(a.text, length(a.text), 1) NOT IN ('.', '?', '!', ':') THEN a.text || ' ' || b.text ELSE a.text END AS text, cast(0.9 AS DOUBLE) AS confidence FROM last a JOIN first b ON a.doc_id = b.doc_id AND b.page = a.page + 1""",
)
told(
    "continued_tables",
    "W-08 A-09",
    """WITH t AS (SELECT o_custkey AS doc, o_orderkey AS tbl, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, 2 + o_orderkey % 2 AS cols, cast(400 + o_orderkey % 3 * 9 AS DOUBLE) AS width, cast(300 + o_orderkey % 5 * 100 AS DOUBLE) AS bottom, cast(60 + o_orderkey % 7 * 60 AS DOUBLE) AS top, o_orderstatus AS header FROM orders),
    m AS (SELECT *, lag(cols) OVER w AS pc, lag(width) OVER w AS pw, lag(bottom) OVER w AS pb, lag(header) OVER w AS ph FROM t WINDOW w AS (PARTITION BY doc ORDER BY page)),
    f AS (SELECT *, CASE WHEN pc = cols AND abs(pw - width) <= greatest(5, pw * 0.04) AND pb >= 792 * 0.55 AND top <= 792 * 0.45 AND ph = header THEN 0 ELSE 1 END AS new FROM m),
    g AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM f)
    SELECT doc, min(tbl) AS first_table, count(*) AS fragments, min(page) AS first_page, max(page) AS last_page, cast(CASE WHEN count(*) > 1 THEN 0.95 ELSE 1 END AS DOUBLE) AS confidence FROM g GROUP BY doc, grp""",
)
told(
    "toc_lookahead",
    "W-10 D-51",
    """WITH n AS (SELECT doc_id, page * 40 + seq AS pos, (doc_id + seq) % 11 = 0 AS heading, (seq + doc_id) % 3 = 0 AS entry FROM doc_lines)
    SELECT doc_id, pos, entries FROM (SELECT doc_id, pos, heading, sum(CASE WHEN entry THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 80 FOLLOWING) AS entries FROM n) x WHERE heading AND entries >= 2""",
)
told(
    "sections_by_heading",
    "W-11 D-30 D-50",
    f"""WITH e AS (SELECT doc_id, page * 40 + seq AS pos, {KIND} AS kind, 1 + (doc_id + page) % 3 AS level FROM doc_lines), s AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM e)
    SELECT doc_id, heading, count(*) AS blocks, min(pos) AS first_pos, max(pos) AS last_pos, sum(CASE WHEN kind = 'table' THEN 1 ELSE 0 END) AS tables FROM s GROUP BY doc_id, heading""",
)
told(
    "heading_anchors",
    "W-16 F-03 D-50",
    """WITH h AS (SELECT doc_id, page * 40 + seq AS pos, text FROM doc_lines WHERE bold), s AS (SELECT doc_id, pos, CASE WHEN trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'node-' || pos ELSE trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') END AS slug FROM h),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY pos) AS k FROM s)
    SELECT doc_id, pos, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS anchor FROM n""",
)
told(
    "tag_order_cohorts",
    "W-14 O-09",
    """WITH t AS (SELECT l_orderkey AS doc, l_linenumber AS idx, l_partkey AS tag_order, l_quantity AS x0, l_quantity + 5 AS x1, l_extendedprice AS y0 FROM lineitem),
    inv AS (SELECT a.doc, count(*) AS inversions, sum(CASE WHEN b.x0 - a.x1 >= 4 OR a.x0 - b.x1 >= 4 THEN 1 ELSE 0 END) AS independent FROM t a JOIN t b ON a.doc = b.doc AND a.idx < b.idx AND a.tag_order > b.tag_order GROUP BY a.doc)
    SELECT doc, inversions, independent, inversions = independent AS accepted FROM inv""",
)
told(
    "row_spans",
    "W-18 D-11",
    """WITH c AS (SELECT table_id, row_idx, col, CASE WHEN (table_id + row_idx + col) % 5 = 0 THEN 2 ELSE 1 END AS colspan FROM table_cells)
    SELECT table_id, row_idx, col, colspan, cast(sum(colspan) OVER (PARTITION BY table_id, row_idx ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - colspan AS BIGINT) AS grid_col FROM c""",
)
told(
    "dedupe_rounded",
    "O-03 O-04",
    "SELECT label, vec_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY label, x, y ORDER BY vec_id) AS n FROM (SELECT label, vec_id, round(cast(embedding[1] AS DOUBLE), 1) + 0.0 AS x, round(cast(embedding[2] AS DOUBLE), 1) + 0.0 AS y FROM embeddings) e) r WHERE n = 1",
)
told("topk_low_confidence", "P-09 O-07 A-07", "SELECT source, doc_id, confidence FROM (SELECT source, doc_id, cast(n_chars % 1000 AS DOUBLE) / 1000 AS confidence, row_number() OVER (PARTITION BY source ORDER BY n_chars % 1000, doc_id) AS n FROM documents) d WHERE n <= 8 AND confidence < 0.8")
told("label_sort", "O-08", "SELECT label, row_number() OVER (ORDER BY try_cast(label AS BIGINT) IS NULL, try_cast(label AS BIGINT) NULLS LAST, label) AS place FROM (SELECT DISTINCT CASE WHEN n_nationkey % 3 = 0 THEN substr(n_name, 1, 3) ELSE cast(n_nationkey * 7 AS varchar(9)) END AS label FROM nation) l")
told(
    "adjacent_panels",
    "O-10",
    """WITH f AS (SELECT doc_id, page, seq, x0, y0, x1, y1 FROM doc_fills UNION ALL SELECT doc_id, page, seq + 50, x0, y0, x1, y1 FROM doc_images), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, seq) AS place, lead(y0) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, seq) AS next_y0, lead(x0) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, seq) AS next_x0 FROM f)
    SELECT doc_id, page, seq, place, next_y0 IS NOT NULL AND abs(next_y0 - y0) <= 100 AS beside FROM o""",
)
told(
    "longest_separator",
    "O-05 O-06",
    "SELECT doc_id, page, max_by(seq, abs(y1 - y0) * 1000 - seq) AS seq, max(abs(y1 - y0)) AS extent, min(CASE WHEN y0 = y1 THEN y0 END) AS first_flat FROM doc_segments GROUP BY doc_id, page",
)
told(
    "indent_parents",
    "W-12 D-32",
    """WITH l AS (SELECT doc_id, page, seq, x0, size FROM doc_lines), p AS (SELECT a.doc_id, a.page, a.seq, max(b.seq) AS parent FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.page = b.page AND b.seq < a.seq AND b.seq >= a.seq - 12 AND b.x0 < a.x0 - greatest(4, 0.45 * a.size) GROUP BY a.doc_id, a.page, a.seq)
    SELECT l.doc_id, l.page, l.seq, p.parent FROM l LEFT JOIN p ON l.doc_id = p.doc_id AND l.page = p.page AND l.seq = p.seq""",
)
