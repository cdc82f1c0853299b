"""Provenance, scores, signatures, votes, gates: what the queries must give, told in SQL."""

from __future__ import annotations

from . import told

told(
    "provenance_merge",
    "A-01 A-02 A-07 X-11",
    """SELECT l_orderkey AS node, l_linenumber AS page, list_sort(list(DISTINCT l_partkey)) AS glyph_ids, list_sort(list(DISTINCT l_returnflag)) AS region_ids,
    list_sort(list(DISTINCT l_suppkey % 7)) AS mcids, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity) AS x1, max(l_extendedprice) AS y1, min(1 - l_discount) AS confidence FROM lineitem GROUP BY l_orderkey, l_linenumber""",
)
told(
    "bbox_union",
    "A-02 F-61",
    "SELECT label, min(embedding[1]) AS x0, min(embedding[2]) AS y0, max(embedding[3]) AS x1, max(embedding[4]) AS y1, count(*) AS n FROM embeddings GROUP BY label",
)
told(
    "dominant_mode",
    "A-05 D-18",
    """WITH v AS (SELECT l_orderkey AS doc, l_shipdate, l_returnflag || l_linestatus AS mode FROM lineitem), c AS (SELECT doc, mode, count(*) AS n FROM v GROUP BY doc, mode),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, mode) AS k FROM c) SELECT doc, mode, n FROM r WHERE k = 1""",
)
# A grid of an order: the columns that a row fills depend on its quantity.
GRID = "grid AS (SELECT table_id, row_idx, col, x0, y0, x1, y1, txt, CASE WHEN (table_id + row_idx) % 11 = 0 AND col = 1 THEN 2 ELSE 1 END AS colspan FROM table_cells WHERE NOT ((table_id + row_idx) % 11 = 0 AND col = 2))"
told(
    "column_counts",
    "A-09 D-11",
    f"WITH {GRID} SELECT table_id, cast(max(col + colspan) AS BIGINT) AS column_count, count(DISTINCT row_idx) AS row_count, count(*) AS cells, cast(sum(colspan) AS BIGINT) AS slots FROM grid GROUP BY table_id",
)
told(
    "grid_signature",
    "A-09",
    f"""WITH {GRID}, box AS (SELECT table_id, min(x0) AS bx0, greatest(max(x1) - min(x0), 1) AS w FROM grid GROUP BY table_id),
    edge AS (SELECT g.table_id, round((x0 - bx0) / w, 4) AS e FROM grid g JOIN box b ON g.table_id = b.table_id UNION SELECT g.table_id, round((x0 + 100 * colspan - bx0) / w, 4) FROM grid g JOIN box b ON g.table_id = b.table_id UNION SELECT table_id, cast(0 AS DOUBLE) FROM box UNION SELECT table_id, cast(1 AS DOUBLE) FROM box)
    SELECT table_id, list_sort(list(DISTINCT e)) AS signature FROM edge GROUP BY table_id""",
)
told(
    "html_vs_gfm",
    "D-15 R-02",
    f"WITH {GRID} SELECT table_id, bool_or(colspan > 1) AS spans, table_id % 13 = 0 AS two_headers, table_id % 17 = 0 AS row_headers, bool_or(colspan > 1) OR table_id % 13 = 0 OR table_id % 17 = 0 AS needs_html FROM grid GROUP BY table_id",
)
PARAGRAPH = "para AS (SELECT doc_id, page, seq, text, y0, y1, cast(length(text) - length(regexp_replace(text, ' +', '', 'g')) AS BIGINT) + 1 AS words, substr(text, length(text), 1) IN ('.', '?', '!') AS ends FROM doc_lines)"
told(
    "borderless_confidence",
    "A-08",
    f"""WITH {PARAGRAPH}, s AS (SELECT doc_id, page, count(*) AS n, sum(CASE WHEN ends THEN 1 ELSE 0 END) AS p, max(y1) - min(y0) AS span, count(DISTINCT words % 3) = 1 AS stable FROM para GROUP BY doc_id, page)
    SELECT doc_id, page, CASE WHEN n < 3 THEN cast(0.55 AS DOUBLE) ELSE greatest(cast(0.5 AS DOUBLE), least(cast(0.96 AS DOUBLE), cast(0.88 AS DOUBLE) + CASE WHEN stable THEN cast(0.04 AS DOUBLE) ELSE cast(-0.1 AS DOUBLE) END - least(cast(0.18 AS DOUBLE), cast(p AS DOUBLE) / n * cast(0.25 AS DOUBLE)) - CASE WHEN span > 500 THEN cast(0.18 AS DOUBLE) ELSE cast(0 AS DOUBLE) END)) END AS confidence FROM s""",
)
told(
    "table_reject_reason",
    "P-16 D-12 D-13",
    rf"""WITH {PARAGRAPH}, w AS (SELECT doc_id, page, count(*) AS n, count(DISTINCT 2 + (doc_id + page) % 2 * (seq % 2)) AS widths, avg(CASE WHEN ends THEN 1 ELSE 0 END) AS sentence, quantile_disc(words, 0.5) AS med,
      avg(CASE WHEN words > 8 THEN 1 ELSE 0 END) AS long_first, max(y1) - min(y0) AS span, avg(CASE WHEN regexp_matches(text, '(19|20)[0-9][0-9]|https?://') THEN 1 ELSE 0 END) AS biblio FROM para GROUP BY doc_id, page)
    SELECT doc_id, page, CASE WHEN n < 3 THEN 'too_few_rows' WHEN widths <> 1 THEN 'unstable_column_count' WHEN biblio >= 0.45 THEN 'bibliography_pattern' WHEN sentence >= 0.6 AND med >= 8 THEN 'article_prose' WHEN span > 500 AND sentence >= 0.35 THEN 'page_spanning_columns' WHEN long_first >= 0.5 THEN 'wrapped_prose_column' END AS reason FROM w""",
)
told(
    "panel_text_ratio",
    "A-10",
    """WITH t AS (SELECT l.doc_id, l.page, l.seq, length(l.text) AS chars, max(CASE WHEN (l.x0 + l.x1) / 2 BETWEEN f.x0 AND f.x1 AND (l.y0 + l.y1) / 2 BETWEEN f.y0 AND f.y1 THEN 1 ELSE 0 END) AS inside FROM doc_lines l JOIN doc_fills f ON l.doc_id = f.doc_id AND l.page = f.page GROUP BY l.doc_id, l.page, l.seq, length(l.text))
    SELECT doc_id, page, cast(sum(chars * inside) AS DOUBLE) / sum(chars) AS ratio FROM t GROUP BY doc_id, page""",
)
# Scores of a document: metrics are null where it has nothing to be scored on.
SCORES = "score AS (SELECT d.doc_id, cast(d.n_chars % 97 AS DOUBLE) / 97 AS nid, CASE WHEN l.quality IS NOT NULL THEN cast(l.quality + d.doc_id % 3 AS DOUBLE) / 4 END AS teds, CASE WHEN d.doc_id % 2 = 0 THEN cast(d.doc_id % 11 AS DOUBLE) / 11 END AS mhs FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
OVERALL = "(coalesce(nid, 0) + coalesce(teds, 0) + coalesce(mhs, 0)) / (CASE WHEN nid IS NULL THEN 0 ELSE 1 END + CASE WHEN teds IS NULL THEN 0 ELSE 1 END + CASE WHEN mhs IS NULL THEN 0 ELSE 1 END)"
told("document_scores", "A-11 M-04", f"WITH {SCORES} SELECT doc_id, nid, teds, mhs, {OVERALL} AS overall FROM score")
told(
    "macro_scores",
    "A-11 M-04",
    f"WITH {SCORES} SELECT round(avg({OVERALL}), 9) AS overall, round(avg(nid), 9) AS nid, round(avg(teds), 9) AS teds, round(avg(mhs), 9) AS mhs, count(teds) AS teds_docs, count(mhs) AS mhs_docs, count(*) AS docs FROM score",
)
told(
    "score_gate",
    "A-12 M-04",
    f"""WITH {SCORES}, m AS (SELECT 'nid' AS metric, avg(nid) AS v FROM score UNION ALL SELECT 'teds', avg(teds) FROM score UNION ALL SELECT 'mhs', avg(mhs) FROM score UNION ALL SELECT 'overall', avg({OVERALL}) FROM score),
    policy AS (SELECT 'nid' AS metric, cast(0.4 AS DOUBLE) AS floor, cast(0.45 AS DOUBLE) AS base UNION ALL SELECT 'teds', cast(0.8 AS DOUBLE), cast(0.3 AS DOUBLE) UNION ALL SELECT 'mhs', cast(0.3 AS DOUBLE), cast(0.9 AS DOUBLE) UNION ALL SELECT 'overall', cast(0.1 AS DOUBLE), cast(0.1 AS DOUBLE))
    SELECT m.metric, round(v, 9) AS value, v >= floor AS above_floor, v >= base - 0.001 AS not_worse, v >= floor AND v >= base - 0.001 AS passed FROM m JOIN policy p ON m.metric = p.metric""",
)
told("summary_counts", "A-13 M-03", f"WITH {SCORES} SELECT count(*) AS documents, sum(CASE WHEN {OVERALL} >= 0.5 THEN 1 ELSE 0 END) AS passed, sum(CASE WHEN {OVERALL} < 0.5 THEN 1 ELSE 0 END) AS failed FROM score")
told(
    "inventory_digest",
    "A-14 U-06 F-67",
    """WITH f AS (SELECT source AS folder, 'doc-' || doc_id AS name, length(text) AS size, sha256(text) AS digest FROM documents WHERE text IS NOT NULL)
    SELECT folder, count(*) AS files, cast(sum(size) AS BIGINT) AS bytes, sha256(string_agg(name || chr(0) || size || chr(0) || digest, chr(10) ORDER BY name)) AS inventory FROM f GROUP BY folder""",
)
told("asset_names", "F-67 S-41", "SELECT page_id, 'assets/vector-' || substr(sha256(html), 1, 16) || '.svg' AS asset, length(html) AS size FROM pages WHERE html IS NOT NULL")
told("uniform_value", "A-15 D-70", "SELECT o_custkey AS field, count(*) AS widgets, CASE WHEN count(DISTINCT o_orderstatus) = 1 AND count(o_orderstatus) = count(*) THEN max(o_orderstatus) END AS appearance FROM orders GROUP BY o_custkey")
told(
    "claim_validation",
    "A-16",
    """WITH c AS (SELECT l_orderkey AS node, count(*) AS claims, count(DISTINCT l_partkey * 100 + l_linenumber) AS distinct_claims, count(DISTINCT l_linenumber % 2) AS pages, min(CASE WHEN l_discount > 0.09 THEN 0 ELSE 1 END) AS validated FROM lineitem GROUP BY l_orderkey)
    SELECT node, CASE WHEN validated = 0 THEN 'unvalidated_claim' WHEN pages <> 1 THEN 'several_pages' WHEN claims <> distinct_claims THEN 'duplicate_claim' ELSE 'ok' END AS reason FROM c""",
)
told(
    "line_owner_vote",
    "A-17",
    """WITH v AS (SELECT l_orderkey AS line, l_returnflag AS owner, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag), r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY n DESC, owner) AS k, sum(n) OVER (PARTITION BY line) AS total, lead(n) OVER (PARTITION BY line ORDER BY n DESC, owner) AS second FROM v)
    SELECT line, owner, cast(n AS DOUBLE) / total AS coverage, coalesce(cast(second AS DOUBLE) / total, cast(0 AS DOUBLE)) AS runner_up, cast(n AS DOUBLE) / total >= 0.9 AND coalesce(cast(second AS DOUBLE) / total, cast(0 AS DOUBLE)) <= 0.05 AS owned FROM r WHERE k = 1""",
)
MATCH = """exp AS (SELECT table_id, row_idx, col, 1 AS rowspan, 1 AS colspan, CASE WHEN row_idx = 0 THEN 'th' ELSE 'td' END AS role, lower(txt) AS txt FROM table_cells),
act AS (SELECT table_id, row_idx, col, 1 AS rowspan, CASE WHEN table_id % 10 = 0 AND col = 2 THEN 2 ELSE 1 END AS colspan, CASE WHEN row_idx = 0 THEN 'th' ELSE 'td' END AS role, CASE WHEN table_id % 6 = 0 AND row_idx = 1 THEN 'x' ELSE lower(txt) END AS txt FROM table_cells)"""
told(
    "cell_exact_match",
    "M-02 U-04",
    f"""WITH {MATCH}, d AS (SELECT coalesce(e.table_id, a.table_id) AS table_id, CASE WHEN e.txt = a.txt AND e.colspan = a.colspan AND e.rowspan = a.rowspan AND e.role = a.role THEN 0 ELSE 1 END AS wrong, CASE WHEN e.colspan = a.colspan AND e.rowspan = a.rowspan THEN 0 ELSE 1 END AS wrong_span, e.table_id AS want_id, a.table_id AS got_id
      FROM exp e FULL JOIN act a ON e.table_id = a.table_id AND e.row_idx = a.row_idx AND e.col = a.col)
    SELECT table_id, CASE WHEN sum(wrong) = 0 THEN 1.0 ELSE 0.0 END AS cell_exact, CASE WHEN sum(wrong_span) = 0 THEN 1.0 ELSE 0.0 END AS span_exact, count(want_id) AS expected_cells, count(got_id) AS actual_cells FROM d GROUP BY table_id""",
)
told(
    "directory_difference",
    "U-06 U-03",
    """WITH e AS (SELECT page_id AS path, length(html) AS size, sha256(html) AS sha FROM pages WHERE url NOT LIKE '%#%'), a AS (SELECT page_id AS path, length(html) AS size, sha256(CASE WHEN page_id % 5 = 0 THEN html || ' ' ELSE html END) AS sha FROM pages WHERE url NOT LIKE '%?%')
    SELECT coalesce(e.path, a.path) AS path, CASE WHEN e.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN e.sha <> a.sha OR e.size <> a.size THEN 'changed' ELSE 'same' END AS state FROM e FULL JOIN a ON e.path = a.path""",
)
told(
    "multiset_guard",
    "U-04 U-05",
    """WITH a AS (SELECT doc_id, text FROM doc_lines), b AS (SELECT doc_id, text FROM doc_lines WHERE NOT (doc_id % 9 = 0 AND seq = 3)), x AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b), n AS (SELECT doc_id, count(*) AS missing FROM x GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n.missing, 0) AS missing, n.missing IS NULL AS equal FROM (SELECT DISTINCT doc_id FROM doc_lines) d LEFT JOIN n ON d.doc_id = n.doc_id""",
)
