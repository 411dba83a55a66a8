"""Queries of the general data problems (p1, p3-p6) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.operators import changes, history, orphans, skew, trees
from symlake.operators.snapshots import built_snapshots
from symlake.session import table


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return built_snapshots(
        table(spark, d, "baselines"), table(spark, d, "symbols"), table(spark, d, "files")
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.dominant_symbols(table(spark, d, "refs"))


def p1_symbol_usage(spark: SparkSession, d: str) -> DataFrame:
    return skew.symbol_usage(table(spark, d, "refs"), table(spark, d, "symbols"))


def p1_target_kinds(spark: SparkSession, d: str) -> DataFrame:
    return skew.reference_targets(table(spark, d, "refs"), table(spark, d, "symbols"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return trees.type_roots(table(spark, d, "type_relations"), table(spark, d, "symbols"))


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    full = trees.type_hierarchies(table(spark, d, "type_relations"), table(spark, d, "symbols"))
    return full.select(
        F.col("group").alias("hierarchy"),
        F.col("node").alias("symbol_id"),
        F.col("root").alias("root_id"),
        "depth",
        F.array_join("path", " > ").alias("path"),
        "n_descendants",
        "on_cycle",
    )


def _links(spark: SparkSession, d: str) -> DataFrame:
    return trees.type_links(table(spark, d, "type_relations"), table(spark, d, "symbols"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return trees.all_descendants(_links(spark, d)).withColumnRenamed("group", "hierarchy")


def p3_cycles(spark: SparkSession, d: str) -> DataFrame:
    return trees.cycles(_links(spark, d)).withColumnRenamed("group", "hierarchy")


def p3_other_parents(spark: SparkSession, d: str) -> DataFrame:
    return trees.other_parents(_links(spark, d)).withColumnRenamed("group", "hierarchy")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.symbol_versions(table(spark, d, "symbols"), _snapshots(spark, d))


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    return history.symbol_history(table(spark, d, "symbols"), _snapshots(spark, d))


def _orphan_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("refs", "facts", "symbols", "files", "stub_symbols")]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(*_orphan_tables(spark, d))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(*_orphan_tables(spark, d), table(spark, d, "baselines"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return changes.symbol_and_file_changes(
        table(spark, d, "symbols"), table(spark, d, "files"), _snapshots(spark, d)
    )


QUERIES = {
    f.__name__: f
    for f in (
        p1_found,
        p1_symbol_usage,
        p1_target_kinds,
        p3_found,
        p3_hierarchy,
        p3_descendants,
        p3_cycles,
        p3_other_parents,
        p4_found,
        p4_history,
        p5_found,
        p5_report,
        p6_found,
    )
}

SNAPSHOTS = """
snaps AS (
  SELECT repo_id, commit_sha, created_at,
         row_number() OVER (PARTITION BY repo_id ORDER BY created_at, commit_sha) AS ord
  FROM (SELECT repo_id, commit_sha, min(created_at) AS created_at FROM baselines GROUP BY ALL) b
  WHERE EXISTS (SELECT 1 FROM symbols s WHERE s.repo_id = b.repo_id AND s.commit_sha = b.commit_sha)
     OR EXISTS (SELECT 1 FROM files f WHERE f.repo_id = b.repo_id AND f.commit_sha = b.commit_sha)
)"""

#: white space runs to one blank
SQUEEZE = "trim(regexp_replace({}, '[\\s\\p{{Z}}]+', ' ', 'g'))"

VERSIONS = f"""
payloads AS (
  SELECT DISTINCT s.repo_id, s.stable_id, n.ord,
         {SQUEEZE.format('s.signature')} AS signature, lower(trim(s.visibility)) AS visibility
  FROM symbols s JOIN snaps n USING (repo_id, commit_sha) WHERE s.stable_id IS NOT NULL
),
marked AS (
  SELECT *, CASE WHEN lag(ord) OVER w = ord - 1
                  AND lag(signature) OVER w IS NOT DISTINCT FROM signature
                  AND lag(visibility) OVER w IS NOT DISTINCT FROM visibility THEN 0 ELSE 1 END AS starts
  FROM payloads WINDOW w AS (PARTITION BY repo_id, stable_id ORDER BY ord)
)"""

TYPES = "('class', 'struct', 'interface', 'record', 'enum')"

#: arguments of one brace group, nested groups removed first (three levels are in the data)
_INNER = "regexp_replace({}, '(\\{{[^{{}}]*)\\{{[^{{}}]*\\}}', '\\1', 'g')"
_FLAT = _INNER.format(_INNER.format(_INNER.format(_INNER.format("related_symbol_id"))))

LINKS = f"""
flat AS (
  SELECT type_symbol_id AS node, {_FLAT} AS r FROM type_relations
  WHERE lower(trim(relation_kind)) = 'basetype'
),
types AS (
  SELECT DISTINCT repo_id, symbol_id, fqname, regexp_replace(containing_type, '^global::', '') AS up
  FROM symbols WHERE lower(trim(kind)) IN {TYPES}
),
links AS (
  SELECT 'base' AS hierarchy, node, min(
    CASE WHEN contains(r, '{{')
         THEN regexp_replace(r, '\\{{.*', '') || '`' || CAST(length(r) - length(replace(r, ',', '')) + 1 AS VARCHAR)
         ELSE r END) AS parent
  FROM flat GROUP BY node
  UNION ALL
  SELECT 'containment', t.symbol_id, min(p.symbol_id)
  FROM types t JOIN types p ON p.repo_id = t.repo_id AND p.fqname = t.up
  GROUP BY t.symbol_id
),
chain AS (
  SELECT hierarchy, node, parent AS top, [node] AS seen, 1 AS steps, parent = node AS closed FROM links
  UNION ALL
  SELECT c.hierarchy, c.node, l.parent, list_append(c.seen, c.top), c.steps + 1,
         list_contains(list_append(c.seen, c.top), l.parent)
  FROM chain c JOIN links l ON l.hierarchy = c.hierarchy AND l.node = c.top
  WHERE NOT c.closed
),
ends AS (
  SELECT hierarchy, node, arg_max(top, steps) AS top, arg_max(seen, steps) AS seen,
         arg_max(closed, steps) AS closed
  FROM chain GROUP BY hierarchy, node
),
rooted AS (
  SELECT hierarchy, node AS symbol_id, closed,
         CASE WHEN closed THEN list_min(list_slice(seen, list_position(seen, top), len(seen))) ELSE top END AS root_id
  FROM ends
)"""

#: for each node: the ids up to the top or to the cycle it meets, that cycle, and how far it is
PLACED = f"""{LINKS},
met AS (
  SELECT hierarchy, node, closed, top, CASE WHEN closed THEN list_slice(seen, 1, list_position(seen, top) - 1) ELSE seen END AS below,
         CASE WHEN closed THEN list_slice(seen, list_position(seen, top), len(seen)) ELSE [] END AS ring
  FROM ends
  UNION ALL
  SELECT DISTINCT l.hierarchy, l.parent, false, l.parent, [], [] FROM links l
  WHERE NOT EXISTS (SELECT 1 FROM links k WHERE k.hierarchy = l.hierarchy AND k.node = l.parent)
),
pairs AS (
  SELECT hierarchy, unnest(list_append(below, top)) AS ancestor, node AS descendant,
         unnest(range(0, len(below) + 1)) AS distance FROM met
  UNION ALL
  SELECT hierarchy, unnest(list_filter(ring, lambda r: r <> top)), node, len(below) + 1 FROM met
),
apart AS (SELECT hierarchy, ancestor, descendant, CAST(distance AS INT) AS distance FROM pairs WHERE ancestor <> descendant)"""

ORPHANS = """
found AS (
  SELECT DISTINCT 'refs' AS source_table, edge_seq AS row_key, repo_id, commit_sha FROM refs r
  WHERE lower(trim(coalesce(resolution_state, 'resolved'))) <> 'unresolved'
    AND to_symbol_id <> ''
    AND to_symbol_id NOT IN (SELECT symbol_id FROM stub_symbols)
    AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.repo_id = r.repo_id
                    AND s.commit_sha = r.commit_sha AND s.symbol_id = r.to_symbol_id)
  UNION ALL
  SELECT DISTINCT 'facts', fact_seq, repo_id, commit_sha FROM facts a
  WHERE file_id <> ''
    AND NOT EXISTS (SELECT 1 FROM files f WHERE f.repo_id = a.repo_id
                    AND f.commit_sha = a.commit_sha AND f.file_id = a.file_id)
)"""


def _diff(entity: str, source: str, key: str, payload: str) -> str:
    return f"""
  SELECT coalesce(b.repo_id, a.repo_id) AS repo_id, n.commit_sha, '{entity}' AS entity,
         coalesce(b.k, a.k) AS record_key,
         CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM (SELECT DISTINCT repo_id, ord, {key} AS k, {payload} AS v FROM {source} JOIN snaps USING (repo_id, commit_sha)
        WHERE {key} IS NOT NULL) b
  FULL JOIN (SELECT DISTINCT repo_id, ord + 1 AS ord, {key} AS k, {payload} AS v
             FROM {source} JOIN snaps USING (repo_id, commit_sha) WHERE {key} IS NOT NULL) a
    ON a.repo_id = b.repo_id AND a.ord = b.ord AND a.k = b.k
  JOIN snaps n ON n.repo_id = coalesce(b.repo_id, a.repo_id) AND n.ord = coalesce(b.ord, a.ord)
  WHERE n.ord > 1 AND (a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v)"""


SQL = {
    "p1_found": """
WITH u AS (
  SELECT 'from' AS side, from_symbol_id AS symbol_id FROM refs
  UNION ALL SELECT 'to', to_symbol_id FROM refs)
SELECT side, symbol_id FROM u WHERE symbol_id <> '' GROUP BY ALL
HAVING count(*) >= 0.02 * (SELECT count(*) FROM refs)""",
    "p1_symbol_usage": """
WITH u AS (
  SELECT 'from' AS side, from_symbol_id AS symbol_id, nullif(to_symbol_id, '') AS peer, indexed_at FROM refs
  UNION ALL SELECT 'to', to_symbol_id, nullif(from_symbol_id, ''), indexed_at FROM refs),
k AS (SELECT symbol_id, min(lower(trim(kind))) AS kind FROM symbols GROUP BY 1)
SELECT side, u.symbol_id, any_value(kind) AS kind, count(*) AS n_rows, count(DISTINCT peer) AS n_peers,
       min(indexed_at) AS first_seen, max(indexed_at) AS last_seen
FROM u LEFT JOIN k ON k.symbol_id = u.symbol_id WHERE u.symbol_id <> '' GROUP BY side, u.symbol_id""",
    "p1_target_kinds": """
WITH k AS (SELECT symbol_id, min(lower(trim(kind))) AS target_kind FROM symbols GROUP BY 1)
SELECT ref_kind, target_kind, count(*) AS n_rows
FROM refs LEFT JOIN k ON k.symbol_id = to_symbol_id GROUP BY ALL""",
    "p3_found": f"WITH RECURSIVE {LINKS} SELECT hierarchy, symbol_id, root_id FROM rooted",
    "p3_hierarchy": f"""
WITH RECURSIVE {PLACED},
spelled AS (
  SELECT hierarchy, node, closed AND len(below) = 0 AS on_cycle,
         CASE WHEN NOT closed OR top = list_min(ring) THEN list_append(below, top)
              ELSE list_concat(below, [top, list_min(ring)]) END AS upward
  FROM met),
counted AS (SELECT hierarchy, ancestor AS node, count(*) AS n FROM apart GROUP BY ALL)
SELECT s.hierarchy, s.node AS symbol_id, upward[-1] AS root_id, CAST(len(upward) - 1 AS INT) AS depth,
       array_to_string(list_reverse(upward), ' > ') AS path, coalesce(n, 0) AS n_descendants, on_cycle
FROM spelled s LEFT JOIN counted c ON c.hierarchy = s.hierarchy AND c.node = s.node""",
    "p3_descendants": f"WITH RECURSIVE {PLACED} SELECT * FROM apart",
    "p3_cycles": f"""
WITH RECURSIVE {PLACED}
SELECT m.hierarchy, m.node AS from_node, l.parent AS to_node, CAST(len(ring) AS INT) AS n_nodes
FROM met m JOIN links l ON l.hierarchy = m.hierarchy AND l.node = m.node
WHERE closed AND len(below) = 0 AND l.parent = list_min(ring)""",
    "p3_other_parents": f"""
WITH {LINKS.split("chain AS")[0].rstrip().rstrip(",")},
every AS (
  SELECT 'base' AS hierarchy, node,
    CASE WHEN contains(r, '{{')
         THEN regexp_replace(r, '\\{{.*', '') || '`' || CAST(length(r) - length(replace(r, ',', '')) + 1 AS VARCHAR)
         ELSE r END AS parent FROM flat
  UNION
  SELECT 'containment', t.symbol_id, min(p.symbol_id) FROM types t JOIN types p ON p.repo_id = t.repo_id AND p.fqname = t.up
  GROUP BY t.repo_id, t.symbol_id, t.up)
SELECT e.* FROM every e JOIN links l ON l.hierarchy = e.hierarchy AND l.node = e.node WHERE e.parent <> l.parent""",
    "p4_found": f"""
WITH {SNAPSHOTS}, {VERSIONS}
SELECT m.repo_id, m.stable_id, n.commit_sha AS valid_from_sha
FROM marked m JOIN snaps n USING (repo_id, ord) WHERE starts = 1""",
    "p4_history": f"""
WITH {SNAPSHOTS}, {VERSIONS},
runs AS (
  SELECT *, sum(starts) OVER (PARTITION BY repo_id, stable_id ORDER BY ord) AS version FROM marked),
versions AS (
  SELECT repo_id, stable_id, CAST(version AS BIGINT) AS version, any_value(signature) AS signature,
         any_value(visibility) AS visibility, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS n_snapshots
  FROM runs GROUP BY repo_id, stable_id, version)
SELECT v.repo_id, stable_id, version, signature, visibility, a.created_at AS valid_from,
       b.created_at AS valid_to, a.commit_sha AS valid_from_sha, n_snapshots
FROM versions v JOIN snaps a ON a.repo_id = v.repo_id AND a.ord = v.first_ord
LEFT JOIN snaps b ON b.repo_id = v.repo_id AND b.ord = v.last_ord + 1""",
    "p5_found": f"WITH {ORPHANS} SELECT DISTINCT source_table, row_key FROM found",
    "p5_report": f"""
WITH {ORPHANS}, base AS (
  SELECT repo_id, commit_sha, strftime(min(created_at), '%Y-%m') AS month FROM baselines GROUP BY ALL)
SELECT source_table, month, count(*) AS n_orphans
FROM found LEFT JOIN base USING (repo_id, commit_sha) GROUP BY ALL""",
    "p6_found": f"""
WITH {SNAPSHOTS}
{_diff('symbol', 'symbols', 'stable_id', SQUEEZE.format('signature'))}
UNION ALL
{_diff('file', 'files', 'file_id', 'lower(trim(sha256))')}""",
}
