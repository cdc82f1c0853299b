"""Trees in adjacency form: what the queries must give, told in SQL."""

from __future__ import annotations

from . import told

WALK = """walk AS (
  SELECT node_id, parent_id, kind, text, 0 AS depth, cast(node_id AS varchar) AS path FROM node_tree WHERE parent_id IS NULL
  UNION ALL SELECT n.node_id, n.parent_id, n.kind, n.text, w.depth + 1, w.path || '/' || n.node_id FROM node_tree n JOIN walk w ON n.parent_id = w.node_id WHERE w.depth < 64)"""
told("node_tree_walk", "F-65 S-05 S-21", f"WITH RECURSIVE {WALK} SELECT node_id, parent_id, kind, depth, path FROM walk")
told(
    "node_text",
    "F-65 R-12",
    f"WITH RECURSIVE {WALK} SELECT split_part(path, '/', 1) AS root, string_agg(text, ' ' ORDER BY path) AS text, count(*) AS nodes, max(depth) AS depth FROM walk GROUP BY split_part(path, '/', 1)",
)
NODES = "n AS (SELECT CASE WHEN l_partkey % 97 = 0 THEN 'dup' ELSE cast(l_orderkey * 10 + l_linenumber AS varchar(20)) END AS node_id, CASE l_returnflag WHEN 'A' THEN 'paragraph' WHEN 'N' THEN 'heading' ELSE 'blink' END AS kind, l_discount * 11 AS confidence, l_suppkey % 5 AS sources, l_orderkey AS doc FROM lineitem)"
told(
    "graph_validation",
    "P-05 P-06 P-07 P-12",
    f"""WITH {NODES}, kinds AS (SELECT 'paragraph' AS kind UNION ALL SELECT 'heading' UNION ALL SELECT 'list' UNION ALL SELECT 'table'),
    d AS (SELECT doc, 'duplicate node id' AS error, count(*) AS n FROM (SELECT doc, node_id FROM n GROUP BY doc, node_id HAVING count(*) > 1) x GROUP BY doc),
    k AS (SELECT doc, 'unknown kind' AS error, count(*) AS n FROM n ANTI JOIN kinds ON n.kind = kinds.kind GROUP BY doc),
    c AS (SELECT doc, 'confidence out of range' AS error, count(*) AS n FROM n WHERE NOT (confidence BETWEEN 0 AND 1) GROUP BY doc),
    s AS (SELECT doc, 'no provenance' AS error, count(*) AS n FROM n WHERE sources = 0 AND kind NOT IN ('document', 'section', 'artifact', 'anchor', 'page_break') GROUP BY doc)
    SELECT * FROM d UNION ALL SELECT * FROM k UNION ALL SELECT * FROM c UNION ALL SELECT * FROM s""",
)
told(
    "graph_cycles",
    "P-08 J-13",
    """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 30 AS b FROM nation),
    w AS (SELECT a AS root, b AS at, cast('/' || a || '/' AS varchar) AS seen, 0 AS depth, false AS cycle FROM e UNION ALL SELECT w.root, e.b, w.seen || e.a || '/', w.depth + 1, contains(w.seen, '/' || e.b || '/') FROM w JOIN e ON e.a = w.at WHERE NOT w.cycle AND w.depth < 40)
    SELECT root, max(depth) AS depth, bool_or(cycle) AS cycle FROM w GROUP BY root""",
)
told(
    "artifact_removal",
    "P-13 P-12",
    f"WITH RECURSIVE {WALK}, gone AS (SELECT path FROM walk WHERE kind = 'heading' AND length(text) % 3 = 0) SELECT w.node_id, w.kind, w.depth FROM walk w ANTI JOIN gone g ON w.path = g.path OR starts_with(w.path, g.path || '/')",
)
told("walk_excluding", "U-03 F-65", f"WITH RECURSIVE {WALK.replace('WHERE w.depth < 64', chr(10) + 'WHERE w.depth < 64 AND NOT (w.kind = ' + chr(39) + 'heading' + chr(39) + ' AND length(w.text) % 2 = 0)')} SELECT node_id, kind, depth FROM walk")
told(
    "acroform_names",
    "S-21 D-70",
    """WITH RECURSIVE f AS (SELECT cast(r_regionkey AS BIGINT) AS id, cast(NULL AS BIGINT) AS parent, lower(r_name) AS part, cast(NULL AS BIGINT) AS ft FROM region UNION ALL SELECT cast(100 + n_nationkey AS BIGINT), cast(n_regionkey AS BIGINT), lower(n_name), cast(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 4 END AS BIGINT) FROM nation),
    w AS (SELECT id, cast(part AS varchar) AS name, coalesce(ft, 1) AS ft, 0 AS depth FROM f WHERE parent IS NULL UNION ALL SELECT f.id, w.name || '.' || f.part, coalesce(f.ft, w.ft), w.depth + 1 FROM f JOIN w ON f.parent = w.id WHERE w.depth < 20)
    SELECT id, name, ft AS field_type, depth FROM w""",
)
told(
    "page_tree_inheritance",
    "S-05 F-62",
    """WITH RECURSIVE p AS (SELECT cast(r_regionkey AS BIGINT) AS id, cast(NULL AS BIGINT) AS parent, cast(r_regionkey * 90 AS BIGINT) AS rotate, cast(NULL AS DOUBLE) AS height FROM region UNION ALL SELECT cast(100 + n_nationkey AS BIGINT), cast(n_regionkey AS BIGINT), CASE WHEN n_nationkey % 2 = 0 THEN cast(n_nationkey * 90 AS BIGINT) END, CASE WHEN n_nationkey % 5 = 0 THEN cast(700 + n_nationkey AS DOUBLE) END FROM nation),
    w AS (SELECT id, coalesce(rotate, 0) AS rotate, coalesce(height, cast(792 AS DOUBLE)) AS height, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.id, coalesce(p.rotate, w.rotate), coalesce(p.height, w.height), w.depth + 1 FROM p JOIN w ON p.parent = w.id WHERE w.depth < 256)
    SELECT id, rotate % 360 AS rotate, height, row_number() OVER (ORDER BY id) AS page FROM w WHERE depth = 1""",
)
told(
    "role_map_closure",
    "S-20 P-17",
    """WITH RECURSIVE m AS (SELECT 'custom' || n_nationkey AS src, CASE WHEN n_nationkey % 4 = 0 THEN 'P' WHEN n_nationkey % 7 = 1 THEN 'H1' ELSE 'custom' || (n_nationkey - 1) END AS dst FROM nation),
    w AS (SELECT src, dst, 1 AS steps FROM m UNION ALL SELECT w.src, m.dst, w.steps + 1 FROM w JOIN m ON w.dst = m.src WHERE w.steps < 30)
    SELECT src AS role, dst AS resolved, steps, CASE dst WHEN 'P' THEN 'paragraph' WHEN 'H1' THEN 'heading' END AS kind FROM w WHERE dst IN ('P', 'H1')""",
)
told(
    "xref_newest",
    "S-02 S-04",
    """WITH e AS (SELECT l_orderkey AS doc, l_partkey % 30 AS obj, l_linenumber AS revision, l_suppkey AS place, l_returnflag = 'R' AS free FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY doc, obj ORDER BY revision DESC, place DESC, free) AS n FROM e)
    SELECT doc, obj, revision, place FROM r WHERE n = 1 AND NOT free""",
)
told(
    "page_selection",
    "S-06",
    """WITH s AS (SELECT unnest(string_split('1,3-5,9-', ',')) AS part_text), r AS (SELECT cast(split_part(part_text, '-', 1) AS BIGINT) AS lo, CASE WHEN contains(part_text, '-') THEN coalesce(try_cast(nullif(split_part(part_text, '-', 2), '') AS BIGINT), 999999) ELSE cast(split_part(part_text, '-', 1) AS BIGINT) END AS hi FROM s)
    SELECT p.doc_id, p.page FROM doc_pages p WHERE EXISTS (SELECT 1 FROM r WHERE p.page BETWEEN r.lo AND r.hi)""",
)
