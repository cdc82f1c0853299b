"""Semantic trees as relations of nodes and parents, and graphs that should be trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of a tree that a walk goes down. Beyond it Spark fails the query: no level is ever left out in silence.
LEVELS = 1000


def _recursive(sql: str, **tables: DataFrame) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(sql.replace("WITH RECURSIVE w", f"WITH RECURSIVE w MAX RECURSION LEVEL {LEVELS}", 1), **tables)


def walk(nodes: DataFrame, goes_on: str = "true") -> DataFrame:
    """Every node under a root with its depth and path. nodes: node_id, parent_id, kind, text; `goes_on`: SQL over w.*, whether the walk enters a node's children."""
    return _recursive(
        f"""WITH RECURSIVE w AS (
        SELECT node_id, parent_id, kind, text, 0 AS depth, cast(node_id AS string) AS path FROM {{nodes}} WHERE parent_id IS NULL
        UNION ALL SELECT n.node_id, n.parent_id, n.kind, n.text, w.depth + 1, w.path || '/' || n.node_id FROM {{nodes}} n JOIN w ON n.parent_id = w.node_id WHERE {goes_on}) SELECT * FROM w""",
        nodes=nodes,
    )


def inherit(nodes: DataFrame, **defaults: str) -> DataFrame:
    """Nodes with the columns named, each from the nearest node above that has it, or else the default. nodes: id, parent, ..."""
    first = ", ".join(f"coalesce({c}, {d}) AS {c}" for c, d in defaults.items())
    further = ", ".join(f"coalesce(n.{c}, w.{c})" for c in defaults)
    return _recursive(f"WITH RECURSIVE w AS (SELECT id, {first}, 0 AS depth FROM {{nodes}} WHERE parent IS NULL UNION ALL SELECT n.id, {further}, w.depth + 1 FROM {{nodes}} n JOIN w ON n.parent = w.id) SELECT * FROM w", nodes=nodes)


def dotted_names(fields: DataFrame, field_type: str = "1") -> DataFrame:
    """Full names and inherited types of form fields. fields: id, parent, part, ft."""
    return _recursive(
        f"""WITH RECURSIVE w AS (SELECT id, cast(part AS string) AS name, coalesce(ft, {field_type}) AS field_type, 0 AS depth FROM {{fields}} WHERE parent IS NULL
        UNION ALL SELECT f.id, w.name || '.' || f.part, coalesce(f.ft, w.field_type), w.depth + 1 FROM {{fields}} f JOIN w ON f.parent = w.id) SELECT * FROM w""",
        fields=fields,
    )


def find_cycles(edges: DataFrame) -> DataFrame:
    """From every node with an edge: how far the walk goes and whether it comes back to a place where it has been. edges: a, b. A walk ends at its first cycle."""
    return _recursive(
        """WITH RECURSIVE w AS (SELECT a AS root, b AS at, cast('/' || a || '/' AS string) AS seen, 0 AS depth, false AS cycle FROM {edges}
        UNION ALL SELECT w.root, e.b, w.seen || e.a || '/', w.depth + 1, contains(w.seen, '/' || e.b || '/') FROM w JOIN {edges} e ON e.a = w.at WHERE NOT w.cycle)
        SELECT root, max(depth) AS depth, bool_or(cycle) AS cycle FROM w GROUP BY root""",
        edges=edges,
    )


def resolve_roles(roles: DataFrame, known: list[str]) -> DataFrame:
    """Roles to the known one that they stand for, over any number of steps. roles: src, dst. A walk ends at a known role or where it has been."""
    held = ", ".join(f"'{k}'" for k in known)
    return _recursive(
        f"""WITH RECURSIVE w AS (SELECT src, dst, 1 AS steps, '/' || src || '/' || dst || '/' AS seen FROM {{roles}}
        UNION ALL SELECT w.src, r.dst, w.steps + 1, w.seen || r.dst || '/' FROM w JOIN {{roles}} r ON w.dst = r.src WHERE NOT contains(w.seen, '/' || r.dst || '/'))
        SELECT src AS role, dst AS resolved, steps FROM w WHERE dst IN ({held})""",
        roles=roles,
    )


def without_subtrees(walked: DataFrame, gone: Column) -> DataFrame:
    """Nodes of a walk that aren't, and don't stand under, a node for which `gone` holds. Every path's beginnings are looked up, so that the join is on equal keys."""
    roots = walked.filter(gone).select(F.col("path").alias("_gone"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = walked.select("path", F.explode(above).alias("_gone")).join(roots, "_gone", "left_semi").select("path").distinct()
    return walked.join(hit, "path", "left_anti")


#: Kinds of nodes that may stand without a source.
SOURCELESS = ("document", "section", "artifact", "anchor", "page_break")


def faults(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """How many faults of each sort a document has: doc, error, n. nodes: doc, node_id, kind, confidence, sources. One pass, and one aggregation for repeated ids."""
    again = nodes.groupBy("doc", "node_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").groupBy("doc").agg(F.count(F.lit(1)).alias("n")).select("doc", F.lit("duplicate node id").alias("error"), "n")
    each = F.array(
        F.when(~F.col("kind").isin(*kinds), "unknown kind"),
        F.when(~F.col("confidence").between(0, 1), "confidence out of range"),
        F.when((F.col("sources") == 0) & ~F.col("kind").isin(*SOURCELESS), "no provenance"),
    )
    found = nodes.select("doc", F.explode(F.filter(each, lambda e: e.isNotNull())).alias("error")).groupBy("doc", "error").agg(F.count(F.lit(1)).alias("n"))
    return again.unionByName(found)


def newest_entries(entries: DataFrame) -> DataFrame:
    """Of each object the entry of the newest revision, unless it is free. entries: doc, obj, revision, place, free."""
    best = F.max(F.struct("revision", "place", (~F.col("free")).alias("used"))).alias("b")
    return entries.groupBy("doc", "obj").agg(best).filter("b.used").select("doc", "obj", "b.revision", "b.place")


def selected_pages(pages: DataFrame, spec: str) -> DataFrame:
    """The pages that a list such as 1,3-5,9- names."""
    chosen = F.lit(False)
    for part in spec.split(","):
        low, dash, high = part.strip().partition("-")
        n = F.col("page")
        chosen = chosen | ((n >= int(low or 1)) & (n <= int(high)) if high else n >= int(low or 1) if dash else n == int(low))
    return pages.filter(chosen)
