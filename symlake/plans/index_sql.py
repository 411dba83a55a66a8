"""SQL twins of the code index queries, for an engine with ANSI SQL over the same tables."""

from __future__ import annotations

from symlake.plans.data_problems import _FLAT, SNAPSHOTS, SQUEEZE

K = "repo_id, commit_sha"

SYM = f"""
sym AS (
  SELECT DISTINCT {K}, symbol_id, fqname, lower(trim(kind)) AS kind, file_id, span_start, span_end,
         {SQUEEZE.format('signature')} AS signature, documentation, namespace,
         nullif(regexp_replace(trim(containing_type), '^global::', ''), '') AS containing_type,
         lower(trim(visibility)) AS visibility, confidence, stable_id, is_decompiled
  FROM symbols)"""
REF = f"""
ref AS (
  SELECT edge_seq, {K}, nullif(from_symbol_id, '') AS from_symbol_id, nullif(to_symbol_id, '') AS to_symbol_id,
         ref_kind, file_id, loc_start, lower(trim(coalesce(resolution_state, 'resolved'))) AS resolution_state,
         nullif(to_name, '') AS to_name, nullif(to_container_hint, '') AS to_container_hint
  FROM refs QUALIFY row_number() OVER (PARTITION BY edge_seq ORDER BY indexed_at DESC) = 1)"""
FACT = f"""
fact AS (SELECT DISTINCT fact_seq, {K}, symbol_id, fact_kind, value, nullif(file_id, '') AS file_id, confidence FROM facts)"""
FILE = f"""
file AS (
  SELECT {K}, file_id, regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '') AS path,
         lower(trim(sha256)) AS sha256, project_name, content
  FROM files QUALIFY row_number() OVER (PARTITION BY {K}, file_id ORDER BY content IS NULL, path, sha256, project_name NULLS FIRST, content) = 1)"""
REL = f"""
rel AS (
  SELECT DISTINCT {K}, type_symbol_id, CASE WHEN contains(r, '{{')
         THEN regexp_replace(r, '\\{{.*', '') || '`' || CAST(length(r) - length(replace(r, ',', '')) + 1 AS VARCHAR)
         ELSE r END AS related_symbol_id, relation_kind
  FROM (SELECT {K}, type_symbol_id, {_FLAT} AS r, lower(trim(relation_kind)) AS relation_kind FROM type_relations))"""
BASE = f"""
base AS (
  SELECT {K}, min(created_at) AS created_at, max(size_bytes) AS size_bytes,
         bool_or(is_current_head) AS is_current_head, bool_or(is_active_workspace_base) AS is_active_workspace_base
  FROM baselines GROUP BY {K})"""


def _camel(x: str) -> str:
    for a in ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        x = f"regexp_replace({x}, '{a}', '\\1 \\2', 'g')"
    return x


DOC_NAME = "regexp_replace(regexp_replace(regexp_replace(symbol_id, '^[A-Z]:', ''), '\\(.*$', ''), '`+\\d+', '', 'g')"
_LAST = f"split_part({DOC_NAME}, '.', -1)"
DISPLAY = f"CASE WHEN {_LAST} IN ('#ctor', '#cctor') THEN split_part({DOC_NAME}, '.', -2) ELSE {_LAST} END"


def _words(x: str) -> str:
    raw = f"list_filter(regexp_split_to_array(coalesce({x}, ''), '[^A-Za-z0-9]+'), lambda w: length(w) > 1)"
    parts = f"flatten(list_transform({raw}, lambda w: string_split({_camel('w')}, ' ')))"
    return f"list_filter(list_transform(list_concat({raw}, {parts}), lambda w: lower(w)), lambda w: length(w) > 1)"


TOKENS = f"""
shown AS (SELECT *, {DISPLAY} AS display FROM sym),
tok AS (
  SELECT *, list_distinct(list_concat([lower(display), lower({DOC_NAME})],
      list_filter(list_transform(string_split({_camel('display')}, ' '), lambda w: lower(w)), lambda w: length(w) > 1),
      list_filter(list_transform(string_split(coalesce(namespace, ''), '.'), lambda w: lower(w)), lambda w: length(w) > 1),
      {_words('signature')}, {_words('documentation')})) AS tokens,
    list_distinct(list_concat([lower(display)],
      list_filter(list_transform(string_split({_camel('display')}, ' '), lambda w: lower(w)), lambda w: length(w) > 1))) AS own
  FROM shown)"""

#: search text, its tokens (lower case, split at separators)
_ASKED = {
    "reader": ["reader"],
    "order service": ["order", "service"],
    "Snapshot.Read": ["snapshot", "read"],
    "IQueueStore": ["iqueuestore"],
    "merge al": ["merge", "al"],
    "OrderReader": ["orderreader"],
    "LockReader": ["lockreader"],
    "GaugeTracker": ["gaugetracker"],
}


def _search(names: list[str], limit: int, where: str = "true") -> str:
    asked = ", ".join("('" + n + "', [" + ", ".join(f"'{t}'" for t in _ASKED[n]) + "])" for n in names)
    return f"""{SYM}, {TOKENS},
asked(query, q) AS (VALUES {asked}),
hit AS (
  SELECT query, {K}, symbol_id,
    CASE WHEN lower(display) = lower(query) THEN 100
         WHEN lower(symbol_id) = lower(query) OR ends_with(lower(symbol_id), '.' || lower(query)) THEN 80
         WHEN starts_with(lower(display), lower(query)) THEN 40 ELSE 10 END
    + CAST(floor(20 * len(list_filter(q, lambda p: len(list_filter(own, lambda t: starts_with(t, p))) > 0)) / len(q)) AS INT)
    + CASE WHEN length(display) < 30 THEN 5 ELSE 0 END AS score
  FROM tok, asked
  WHERE {where} AND len(list_filter(q, lambda p: len(list_filter(tokens, lambda t: starts_with(t, p))) = 0)) = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query, {K} ORDER BY score DESC, symbol_id) AS INT) AS rank,
         count(*) OVER (PARTITION BY query, {K}) > {limit} AS truncated FROM hit),
found AS (SELECT query, {K}, symbol_id, score, rank, truncated FROM ranked WHERE rank <= {limit})"""


def _find(mine: str, other: str, limit: int, where: str) -> str:
    return f"""{REF}, {FILE},
ranked AS (
  SELECT r.repo_id, r.commit_sha, {mine} AS symbol_id, edge_seq, {other} AS other_id, ref_kind, path, loc_start,
         CAST(row_number() OVER w AS INT) AS rank, count(*) OVER (PARTITION BY r.repo_id, r.commit_sha, {mine}) > {limit} AS truncated
  FROM ref r JOIN file f ON f.repo_id = r.repo_id AND f.commit_sha = r.commit_sha AND f.file_id = r.file_id
  WHERE {mine} IS NOT NULL AND {where}
  WINDOW w AS (PARTITION BY r.repo_id, r.commit_sha, {mine} ORDER BY path, loc_start, edge_seq)),
found AS (SELECT * FROM ranked WHERE rank <= {limit})"""


def _excerpt(x: str) -> str:
    t = f"trim(regexp_replace({x}, '[\\r\\t]', ' ', 'g'))"
    return f"CASE WHEN length({t}) > 200 THEN substr({t}, 1, 197) || '...' ELSE {t} END"


def _bfs(roots: str, mine: str, other: str, limit: int = 20, depth: int = 2) -> str:
    q = f"{K}, root"
    out = f"""{REF}, {FACT}, {SYM},
near0 AS (
  SELECT {K}, {mine} AS hub, {other} AS other, ref_kind,
         row_number() OVER (PARTITION BY {K}, {mine} ORDER BY edge_seq) AS r
  FROM ref WHERE {mine} IS NOT NULL),
near1 AS (
  SELECT {K}, hub, other, min(r) AS r FROM near0
  WHERE r <= {2 * (limit + 1)} AND ref_kind IN ('Call', 'Instantiate') AND other IS NOT NULL GROUP BY {K}, hub, other),
near AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {K}, hub ORDER BY r) AS place FROM near1) WHERE place <= {limit + 1}),
roots AS ({roots}),
l0 AS (SELECT {q}, root AS symbol_id, 1 AS place, 0 AS depth, false AS cutoff FROM roots)"""
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT {q}, symbol_id FROM l{i}" for i in range(d))
        out += f""",
e{d} AS (
  SELECT p.repo_id, p.commit_sha, p.root, p.symbol_id AS from_node, n.other AS to_node, {d} AS depth,
         p.place AS parent_place, n.place
  FROM l{d - 1} p JOIN near n ON n.repo_id = p.repo_id AND n.commit_sha = p.commit_sha AND n.hub = p.symbol_id),
f{d} AS (
  SELECT e.repo_id, e.commit_sha, e.root, e.to_node AS symbol_id, min((parent_place, place)) AS first
  FROM e{d} e WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.repo_id = e.repo_id
    AND s.commit_sha = e.commit_sha AND s.root = e.root AND s.symbol_id = e.to_node)
  GROUP BY e.repo_id, e.commit_sha, e.root, e.to_node),
l{d} AS (
  SELECT {q}, symbol_id, place, {d} AS depth, cutoff FROM (
    SELECT *, row_number() OVER (PARTITION BY {q} ORDER BY first) AS place,
           count(*) OVER (PARTITION BY {q}) > {limit} AS cutoff FROM f{d}) WHERE place <= {limit})"""
    return out + f""",
reached AS ({" UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(depth + 1))}),
nodes AS (
  SELECT {q}, symbol_id, depth, bool_or(cutoff) OVER (PARTITION BY {q}) AS truncated FROM reached)"""


_ROUTES = f"SELECT DISTINCT {K}, symbol_id AS root FROM fact WHERE fact_kind = 'Route'"
_TREE = """
t{d} AS (SELECT t.repo_id, t.commit_sha, t.root, path || ' > ' || to_node AS path, {d} AS depth, to_node AS symbol_id FROM t{up} t
       JOIN link l ON l.repo_id = t.repo_id AND l.commit_sha = t.commit_sha AND l.root = t.root AND l.from_node = t.symbol_id)"""
_FACES = f"SELECT {K}, symbol_id AS root FROM sym WHERE kind = 'interface'"

OVERLAY = f"""{SNAPSHOTS}, {SYM}, {FILE},
step AS (
  SELECT a.repo_id, a.commit_sha AS next_sha, b.commit_sha FROM snaps a JOIN snaps b ON b.repo_id = a.repo_id AND b.ord = a.ord - 1),
fa AS (SELECT f.* FROM file f JOIN step USING (repo_id, commit_sha)),
fb AS (SELECT f.repo_id, s.commit_sha, file_id, path, sha256 FROM file f JOIN step s ON s.repo_id = f.repo_id AND s.next_sha = f.commit_sha),
changed AS (
  SELECT * FROM (
    SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.commit_sha, b.commit_sha) AS commit_sha,
           coalesce(a.file_id, b.file_id) AS file_id,
           CASE WHEN a.path IS NULL THEN 'Added' WHEN b.path IS NULL THEN 'Deleted'
                WHEN a.path <> b.path THEN 'Renamed' WHEN a.sha256 <> b.sha256 THEN 'Modified' END AS change_kind
    FROM fa a FULL JOIN fb b ON a.repo_id = b.repo_id AND a.commit_sha = b.commit_sha AND a.file_id = b.file_id)
  WHERE change_kind IS NOT NULL),
sb AS (SELECT y.* REPLACE (s.commit_sha AS commit_sha) FROM sym y JOIN step s ON s.repo_id = y.repo_id AND s.next_sha = y.commit_sha),
oversym AS (SELECT * FROM sb y WHERE EXISTS (SELECT 1 FROM changed c WHERE c.repo_id = y.repo_id
  AND c.commit_sha = y.commit_sha AND c.file_id = y.file_id)),
deleted AS (
  SELECT {K}, symbol_id FROM sym y
  WHERE EXISTS (SELECT 1 FROM changed c WHERE c.repo_id = y.repo_id AND c.commit_sha = y.commit_sha AND c.file_id = y.file_id)
    AND NOT EXISTS (SELECT 1 FROM sb WHERE sb.repo_id = y.repo_id AND sb.commit_sha = y.commit_sha AND sb.symbol_id = y.symbol_id))"""


def _merge(source: str, cols: str, extra: str = "true") -> str:
    """Rows of changed files from the next snapshot, the others from the base."""
    return f"""
merged AS (
  SELECT {cols}, 'overlay' AS side FROM (
    SELECT x.* REPLACE (s.commit_sha AS commit_sha) FROM {source} x JOIN step s ON s.repo_id = x.repo_id AND s.next_sha = x.commit_sha) x
  WHERE EXISTS (SELECT 1 FROM changed c WHERE c.repo_id = x.repo_id AND c.commit_sha = x.commit_sha AND c.file_id = x.file_id)
  UNION ALL
  SELECT {cols}, 'baseline' FROM {source} x
  WHERE NOT EXISTS (SELECT 1 FROM changed c WHERE c.repo_id = x.repo_id AND c.commit_sha = x.commit_sha AND c.file_id = x.file_id)
    AND {extra})"""


_TITLES = (
    "CASE fact_kind WHEN 'Route' THEN 'Endpoints' WHEN 'DbTable' THEN 'Data' WHEN 'Config' THEN 'Configuration' "
    "WHEN 'DiRegistration' THEN 'Services' WHEN 'Middleware' THEN 'Pipeline' WHEN 'RetryPolicy' THEN 'Resilience' "
    "WHEN 'Exception' THEN 'Errors' WHEN 'Log' THEN 'Logging' END"
)
_ORDER = "list_position(['Endpoints','Data','Configuration','Services','Pipeline','Resilience','Errors','Logging'], section)"

SECTIONS = f"""{FACT},
item AS (
  SELECT {K}, {_TITLES} AS section, value, fact_seq,
         CASE WHEN fact_kind = 'Route' THEN value ELSE trim(split_part(value, '|', 1)) END AS item,
         array_to_string(list_slice(string_split(regexp_replace(substr(symbol_id, 3), '\\(.*$', ''), '.'), -2, -1), '.') AS symbol_name
  FROM fact WHERE {_TITLES} IS NOT NULL),
section AS (
  SELECT {K}, section, rank, item, symbol_name, n_items FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY {K}, section ORDER BY value, fact_seq) AS INT) AS rank,
           count(*) OVER (PARTITION BY {K}, section) AS n_items FROM item)
  WHERE rank <= 50)"""

DIFF = f"""{SNAPSHOTS}, {SYM},
a AS (SELECT y.*, n.ord + 1 AS ord FROM sym y JOIN snaps n USING (repo_id, commit_sha)
      WHERE EXISTS (SELECT 1 FROM snaps m WHERE m.repo_id = y.repo_id AND m.ord = n.ord + 1)),
b AS (SELECT y.*, n.ord FROM sym y JOIN snaps n USING (repo_id, commit_sha) WHERE n.ord > 1),
p1 AS (
  SELECT a.repo_id, a.ord, a.kind, a.symbol_id AS from_id, b.symbol_id AS to_id,
         CASE WHEN a.symbol_id <> b.symbol_id THEN 'Renamed'
              WHEN a.signature IS DISTINCT FROM b.signature THEN 'SignatureChanged'
              WHEN a.visibility IS DISTINCT FROM b.visibility THEN 'VisibilityChanged' END AS change_kind
  FROM a JOIN b ON a.repo_id = b.repo_id AND a.ord = b.ord AND a.stable_id = b.stable_id),
ra AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.repo_id = a.repo_id AND p1.ord = a.ord AND p1.from_id = a.symbol_id)),
rb AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.repo_id = b.repo_id AND p1.ord = b.ord AND p1.to_id = b.symbol_id)),
p2 AS (
  SELECT coalesce(ra.repo_id, rb.repo_id) AS repo_id, coalesce(ra.ord, rb.ord) AS ord, coalesce(ra.kind, rb.kind) AS kind,
         ra.symbol_id AS from_id, rb.symbol_id AS to_id,
         CASE WHEN rb.symbol_id IS NULL THEN 'Removed' WHEN ra.symbol_id IS NULL THEN 'Added'
              WHEN ra.signature IS DISTINCT FROM rb.signature THEN 'SignatureChanged' END AS change_kind
  FROM ra FULL JOIN rb ON ra.repo_id = rb.repo_id AND ra.ord = rb.ord AND ra.symbol_id = rb.symbol_id),
d AS (SELECT * FROM p1 WHERE change_kind IS NOT NULL UNION ALL SELECT * FROM p2 WHERE change_kind IS NOT NULL)"""

_FACT_KEY = (
    "fact_kind || ':' || CASE WHEN fact_kind = 'Route' THEN value WHEN fact_kind IN ('Config', 'DbTable') "
    "THEN split_part(value, '|', 1) WHEN fact_kind = 'DiRegistration' THEN trim(split_part(value, '→', 1)) ELSE value END"
)

FACT_DIFF = f"""
keyed AS (SELECT {K}, fact_kind, {_FACT_KEY} AS fact_key, min(value) AS value FROM fact GROUP BY ALL),
old_fact AS (SELECT k.*, n.ord + 1 AS ord FROM keyed k JOIN snaps n USING (repo_id, commit_sha)
      WHERE EXISTS (SELECT 1 FROM snaps m WHERE m.repo_id = k.repo_id AND m.ord = n.ord + 1)),
new_fact AS (SELECT k.*, n.ord FROM keyed k JOIN snaps n USING (repo_id, commit_sha) WHERE n.ord > 1),
fact_diff AS (SELECT * FROM (
  SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, CAST(coalesce(a.ord, b.ord) AS INT) AS ord,
      coalesce(a.fact_kind, b.fact_kind) AS fact_kind, coalesce(a.fact_key, b.fact_key) AS fact_key,
      a.value AS from_value, b.value AS to_value,
      CASE WHEN b.value IS NULL THEN 'Removed' WHEN a.value IS NULL THEN 'Added' WHEN a.value <> b.value THEN 'Changed' END AS change_kind
  FROM old_fact a FULL JOIN new_fact b ON a.repo_id = b.repo_id AND a.ord = b.ord AND a.fact_kind = b.fact_kind AND a.fact_key = b.fact_key)
  WHERE change_kind IS NOT NULL)"""

_CHANGES = ["Added", "Removed", "Renamed", "SignatureChanged", "VisibilityChanged"]
_FACT_CHANGES = [(k, c) for k in ("Route", "Config", "DbTable", "DiRegistration") for c in ("Added", "Removed", "Changed")]
_SYMBOL_COUNTS = ", ".join(f"count(*) FILTER (change_kind = '{c}') AS n_{c.lower()}" for c in _CHANGES)
_FACT_COUNTS = ", ".join(f"count(*) FILTER (fact_kind = '{k}' AND change_kind = '{c}') AS n_{k.lower()}_{c.lower()}" for k, c in _FACT_CHANGES)
_ALL_COUNTS = ", ".join(f"coalesce({n}, 0) AS {n}" for n in [*(f"n_{c.lower()}" for c in _CHANGES), *(f"n_{k.lower()}_{c.lower()}" for k, c in _FACT_CHANGES)])

RETENTION = f"""{BASE},
aged AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, commit_sha) AS INT) AS age_rank FROM base),
judged AS (
  SELECT {K}, age_rank, size_bytes, CASE WHEN is_current_head OR is_active_workspace_base THEN 'protected'
         WHEN age_rank <= 3 THEN 'kept' ELSE 'removed' END AS verdict FROM aged)"""

RESOLVE = f"""{REF}, {SYM},
named AS (
  SELECT {K}, regexp_extract(regexp_replace(symbol_id, '\\(.*$', ''), '([^.:`]+)(?:`+\\d+)?$', 1) AS to_name,
         regexp_extract(containing_type, '([^.<]+)(?:<.*>)?$', 1) AS owner, symbol_id FROM sym),
n1 AS (SELECT {K}, to_name, min(symbol_id) AS target FROM named GROUP BY {K}, to_name HAVING count(*) = 1),
n2 AS (SELECT {K}, to_name, owner, min(symbol_id) AS target FROM named WHERE owner <> '' GROUP BY {K}, to_name, owner HAVING count(*) = 1),
resolved AS (
  SELECT edge_seq, coalesce(n1.target, n2.target) AS to_symbol_id
  FROM (SELECT *, regexp_extract(to_container_hint, '([^.<]+)(?:<.*>)?$', 1) AS owner FROM ref
        WHERE resolution_state = 'unresolved' AND to_name IS NOT NULL) r
  LEFT JOIN n1 ON n1.repo_id = r.repo_id AND n1.commit_sha = r.commit_sha AND n1.to_name = r.to_name
  LEFT JOIN n2 ON n2.repo_id = r.repo_id AND n2.commit_sha = r.commit_sha AND n2.to_name = r.to_name AND n2.owner = r.owner
  WHERE coalesce(n1.target, n2.target) IS NOT NULL)"""


def _top_facts(kind: str, limit: int) -> str:
    return f"""{FACT},
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY value, symbol_id, fact_seq) AS rank
                 FROM fact WHERE fact_kind = '{kind}') WHERE rank <= {limit})"""


_ROUTE = "split_part(value, ' ', 1) AS method, CASE WHEN contains(value, ' ') THEN regexp_replace(value, '^[^ ]* ', '') ELSE '' END AS path"
_CONF = "['High', 'Medium', 'Low']"
TABLES = f"""
t AS (SELECT {K}, lower(split_part(value, '|', 1)) AS tk, split_part(value, '|', 1) AS name,
      CASE WHEN contains(value, '|') THEN regexp_replace(value, '^[^|]*\\|', '') ELSE '' END AS origin, symbol_id, confidence,
      row_number() OVER (PARTITION BY {K}, lower(split_part(value, '|', 1)) ORDER BY value, symbol_id, fact_seq) AS n
      FROM fact WHERE fact_kind = 'DbTable'),
g AS (SELECT {K}, tk, min(name) FILTER (n = 1) AS name, min(origin) FILTER (n = 1) AS origin,
      min(symbol_id) FILTER (n = 1) AS first_referrer, count(DISTINCT symbol_id) AS n_referrers,
      {_CONF}[max(list_position({_CONF}, confidence))] AS confidence FROM t GROUP BY {K}, tk)"""
_TABLE_COLUMNS = f"""{K}, CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) END AS schema_name,
       CASE WHEN contains(name, '.') THEN regexp_replace(name, '^[^.]*\\.', '') ELSE name END AS table_name,
       CASE WHEN starts_with(origin, 'DbSet') THEN first_referrer END AS entity, n_referrers, confidence"""
_COUNTS = "count(*) AS n_refs, count(DISTINCT from_symbol_id) AS n_sources, count(DISTINCT to_symbol_id) AS n_targets"

SQL = {
    "symbols_search": f"WITH {_search(['reader', 'order service', 'Snapshot.Read', 'IQueueStore', 'merge al'], 20)} SELECT * FROM found",
    "symbols_search_filtered": f"WITH {_search(['reader', 'order service'], 20, where='''kind IN ('class', 'interface')''')} SELECT * FROM found",
    "search_savings": f"""WITH {_search(['reader', 'order service', 'Snapshot.Read', 'IQueueStore', 'merge al'], 20)}
SELECT query, count(*) AS n_hits, count(*) * 750 AS tokens_saved,
       CAST(round(count(*) * 750 / 1000.0 * 0.003, 6) AS DOUBLE) AS usd_saved FROM found GROUP BY query""",
    "symbols_search_written": f"""WITH {FILE}, {_search(['reader', 'order service'], 20, where="""coalesce(is_decompiled, 0) = 0
    AND EXISTS (SELECT 1 FROM file f WHERE f.repo_id = tok.repo_id AND f.commit_sha = tok.commit_sha AND f.file_id = tok.file_id
                AND starts_with(lower(f.path), 'src/') AND NOT (contains(f.path, '.Tests/') OR contains(f.path, '.Benchmarks/') OR contains(f.path, '.TestUtilities/')))""")} SELECT * FROM found""",
    "symbols_resolve_name": f"""WITH {_search(['OrderReader', 'LockReader', 'GaugeTracker'], 21)}
SELECT query, {K}, CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome,
       CASE WHEN count(*) = 1 THEN min(symbol_id) END AS symbol_id,
       array_to_string(list_slice(list(symbol_id ORDER BY rank), 1, 5), ' | ') AS candidates
FROM found GROUP BY query, {K}""",
    "symbols_browse": f"""WITH {SYM} SELECT * FROM (
SELECT {K}, symbol_id, kind, CAST(row_number() OVER (PARTITION BY {K} ORDER BY fqname, symbol_id) AS INT) AS rank
FROM sym WHERE kind IN ('interface', 'enum')) WHERE rank <= 20""",
    "index_tokens": f"""WITH {SYM}, {TOKENS}
SELECT {K}, token, count(*) AS n_symbols FROM (SELECT {K}, unnest(tokens) AS token FROM tok) GROUP BY {K}, token""",
    "symbols_card": f"""WITH {SYM}, {FACT}, {FILE},
note AS (SELECT {K}, symbol_id, array_to_string(list_sort(list(DISTINCT fact_kind || '=' || value)), '; ') AS facts,
         count(*) AS n_facts FROM fact GROUP BY {K}, symbol_id)
SELECT s.repo_id, s.commit_sha, s.symbol_id, kind, signature, visibility,
       CASE WHEN path IS NULL THEN 'Low' ELSE confidence END AS confidence, path, span_start,
       coalesce(n_facts, 0) AS n_facts, facts
FROM sym s LEFT JOIN file f ON f.repo_id = s.repo_id AND f.commit_sha = s.commit_sha AND f.file_id = s.file_id
LEFT JOIN note n ON n.repo_id = s.repo_id AND n.commit_sha = s.commit_sha AND n.symbol_id = s.symbol_id""",
    "refs_find": f"WITH {_find('to_symbol_id', 'from_symbol_id', 50, 'true')} SELECT * FROM found",
    "refs_find_calls": f"""WITH {_find('to_symbol_id', 'from_symbol_id', 5, "ref_kind = 'Call' AND resolution_state = 'resolved'")} SELECT * FROM found""",
    "refs_outgoing": f"WITH {_find('from_symbol_id', 'to_symbol_id', 50, 'true')} SELECT * FROM found",
    "refs_excerpts": f"""WITH {_find('to_symbol_id', 'from_symbol_id', 50, 'true')}
SELECT d.*, {_excerpt("string_split(content, chr(10))[loc_start]")} AS excerpt
FROM found d LEFT JOIN file f ON f.repo_id = d.repo_id AND f.commit_sha = d.commit_sha AND f.path = d.path AND content IS NOT NULL""",
    "refs_counts": f"WITH {REF} SELECT {K}, ref_kind, resolution_state, {_COUNTS} FROM ref GROUP BY {K}, ref_kind, resolution_state",
    "refs_unresolved": f"""WITH {REF}, {FILE}
SELECT r.repo_id, r.commit_sha, edge_seq, from_symbol_id, to_name, to_container_hint, path, loc_start
FROM ref r JOIN file f ON f.repo_id = r.repo_id AND f.commit_sha = r.commit_sha AND f.file_id = r.file_id
WHERE resolution_state = 'unresolved'""",
    "refs_resolve": f"WITH {RESOLVE} SELECT * FROM resolved",
    "refs_upgraded": f"""WITH {RESOLVE},
up AS (SELECT r.repo_id, r.commit_sha, ref_kind, from_symbol_id, coalesce(v.to_symbol_id, r.to_symbol_id) AS to_symbol_id,
       CASE WHEN v.edge_seq IS NOT NULL THEN 'resolved' ELSE resolution_state END AS resolution_state
       FROM ref r LEFT JOIN resolved v USING (edge_seq))
SELECT {K}, ref_kind, resolution_state, {_COUNTS} FROM up GROUP BY {K}, ref_kind, resolution_state""",
    "graph_callees": f"WITH {_bfs(_ROUTES, 'from_symbol_id', 'to_symbol_id')} SELECT * FROM nodes",
    "graph_callers": f"""WITH {_bfs(_FACES, 'to_symbol_id', 'from_symbol_id')}
SELECT n.*, coalesce(s.kind, 'method') AS kind FROM nodes n
LEFT JOIN sym s ON s.repo_id = n.repo_id AND s.commit_sha = n.commit_sha AND s.symbol_id = n.symbol_id""",
    "graph_edges": f"""WITH {_bfs(_ROUTES, 'from_symbol_id', 'to_symbol_id')}
SELECT {K}, root, from_node, to_node, depth FROM e1 UNION ALL SELECT {K}, root, from_node, to_node, depth FROM e2""",
    "graph_trace_feature": f"""WITH {_bfs(_ROUTES, 'from_symbol_id', 'to_symbol_id', 100, 3)},
link AS (
  SELECT DISTINCT e.repo_id, e.commit_sha, e.root, e.from_node, e.to_node
  FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3) e
  JOIN nodes n ON n.repo_id = e.repo_id AND n.commit_sha = e.commit_sha AND n.root = e.root AND n.symbol_id = e.to_node),
t0 AS (SELECT {K}, root, root AS path, 0 AS depth, root AS symbol_id FROM roots),
{",".join(_TREE.format(d=d, up=d - 1) for d in (1, 2, 3))},
note AS (SELECT {K}, symbol_id, array_to_string(list_sort(list(DISTINCT fact_kind || ':' || trim(split_part(value, '|', 1)))), '; ') AS annotations
         FROM fact GROUP BY {K}, symbol_id)
SELECT t.*, annotations FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3) t
LEFT JOIN note n ON n.repo_id = t.repo_id AND n.commit_sha = t.commit_sha AND n.symbol_id = t.symbol_id""",
    "types_hierarchy": f"""WITH {SYM}, {REL},
up AS (SELECT {K}, type_symbol_id AS symbol_id, min(related_symbol_id) FILTER (relation_kind = 'basetype') AS base_type,
       coalesce(array_to_string(list_sort(list(DISTINCT related_symbol_id) FILTER (relation_kind = 'interface')), ', '), '') AS interfaces
       FROM rel GROUP BY {K}, type_symbol_id),
down AS (SELECT {K}, related_symbol_id AS symbol_id, count(DISTINCT type_symbol_id) AS n_derived FROM rel GROUP BY {K}, related_symbol_id)
SELECT s.repo_id, s.commit_sha, s.symbol_id, base_type, coalesce(interfaces, '') AS interfaces, coalesce(n_derived, 0) AS n_derived
FROM sym s LEFT JOIN up u ON u.repo_id = s.repo_id AND u.commit_sha = s.commit_sha AND u.symbol_id = s.symbol_id
LEFT JOIN down n ON n.repo_id = s.repo_id AND n.commit_sha = s.commit_sha AND n.symbol_id = s.symbol_id
WHERE kind IN ('class', 'struct', 'interface', 'record', 'enum', 'delegate') AND (u.symbol_id IS NOT NULL OR n.symbol_id IS NOT NULL)""",
    "types_derived": f"""WITH {SYM}, {REL}
SELECT DISTINCT r.repo_id, r.commit_sha, related_symbol_id AS symbol_id, type_symbol_id AS derived_id, relation_kind,
       coalesce(s.fqname, CASE WHEN regexp_matches(type_symbol_id, '^[A-Z]:') THEN substr(type_symbol_id, 3) ELSE type_symbol_id END) AS display_name
FROM rel r LEFT JOIN sym s ON s.repo_id = r.repo_id AND s.commit_sha = r.commit_sha AND s.symbol_id = r.type_symbol_id""",
    "interface_members": f"""WITH {SYM}, {REL},
m AS (SELECT {K}, symbol_id, 'T:' || regexp_extract(symbol_id, '^[A-Z]:(.*?)\\.[^.(]+(?:\\(.*)?$', 1) AS type_symbol_id,
      substr(symbol_id, 1, 2) AS k, regexp_extract(symbol_id, '^[A-Z]:.*?(\\.[^.(]+(?:\\(.*)?)$', 1) AS tail
      FROM sym WHERE regexp_matches(symbol_id, '^[MPE]:')),
w AS (SELECT m.repo_id, m.commit_sha, m.symbol_id, k || substr(related_symbol_id, 3) || tail AS interface_member
      FROM m JOIN rel r ON r.repo_id = m.repo_id AND r.commit_sha = m.commit_sha AND r.type_symbol_id = m.type_symbol_id
      WHERE relation_kind = 'interface')
SELECT w.* FROM w JOIN sym s ON s.repo_id = w.repo_id AND s.commit_sha = w.commit_sha AND s.symbol_id = w.interface_member""",
    "surfaces_endpoints": f"WITH {_top_facts('Route', 50)} SELECT {K}, fact_seq, {_ROUTE}, symbol_id FROM top",
    "surfaces_endpoints_get": f"""WITH {_top_facts('Route', 30)} SELECT {K}, fact_seq, {_ROUTE}, symbol_id FROM top
WHERE lower(split_part(value, ' ', 1)) = 'get'""",
    "surfaces_config_keys": f"""WITH {_top_facts('Config', 50)}
SELECT {K}, fact_seq, split_part(value, '|', 1) AS key,
       CASE WHEN contains(value, '|') THEN regexp_replace(value, '^[^|]*\\|', '') ELSE 'unknown' END AS pattern, symbol_id FROM top""",
    "surfaces_config_sections": f"""WITH {FACT}
SELECT {K}, split_part(split_part(value, '|', 1), ':', 1) AS section, count(DISTINCT split_part(value, '|', 1)) AS n_keys
FROM fact WHERE fact_kind = 'Config' GROUP BY ALL""",
    "surfaces_db_tables": f"WITH {FACT}, {TABLES} SELECT {_TABLE_COLUMNS} FROM g",
    "surfaces_db_tables_top": f"""WITH {FACT}, {TABLES}
SELECT {_TABLE_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY tk) AS place FROM g)
WHERE place <= 20 AND starts_with(lower(CASE WHEN contains(name, '.') THEN regexp_replace(name, '^[^.]*\\.', '') ELSE name END), 's')""",
    "surfaces_registrations": f"""WITH {FACT},
r AS (SELECT *, regexp_replace(value, '\\|HostedService$', '') AS bare FROM fact WHERE fact_kind = 'DiRegistration'),
p AS (SELECT *, CASE WHEN contains(bare, '|') THEN regexp_replace(bare, '\\|[^|]*$', '') ELSE bare END AS pair FROM r)
SELECT {K}, fact_seq, trim(split_part(pair, '→', 1)) AS service, trim(split_part(pair, '→', 2)) AS implementation,
       CASE WHEN contains(bare, '|') THEN split_part(bare, '|', -1) END AS lifetime, ends_with(value, '|HostedService') AS hosted FROM p""",
    "surfaces_middleware": f"""WITH {FACT}
SELECT {K}, fact_seq, trim(split_part(value, '|', 1)) AS name,
       TRY_CAST(regexp_extract(value, '\\|pos:(\\d{{1,9}})', 1) AS INT) AS position, ends_with(value, '|terminal') AS terminal
FROM fact WHERE fact_kind = 'Middleware'""",
    "code_search_text": f"""WITH {FILE},
line AS (SELECT {K}, path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line
         FROM file WHERE content IS NOT NULL),
r AS (SELECT {K}, path, CAST(line AS INT) AS line, {_excerpt('text')} AS excerpt,
      CAST(row_number() OVER (PARTITION BY {K} ORDER BY lower(path), path, line) AS INT) AS rank,
      count(*) OVER (PARTITION BY {K}) > 100 AS truncated
      FROM line WHERE regexp_matches(text, 'throw new \\w+Exception'))
SELECT * FROM r WHERE rank <= 100""",
    "code_search_glob": f"""WITH {FILE},
line AS (SELECT {K}, path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line
         FROM file WHERE content IS NOT NULL AND regexp_matches(path, '(?i)^src/(?:.*/)?[^/]*\\.cs$')),
r AS (SELECT {K}, path, CAST(line AS INT) AS line, {_excerpt('text')} AS excerpt,
      CAST(row_number() OVER (PARTITION BY {K} ORDER BY lower(path), path, line) AS INT) AS rank,
      count(*) OVER (PARTITION BY {K}) > 20 AS truncated
      FROM line WHERE regexp_matches(text, '(?i)cursor'))
SELECT * FROM r WHERE rank <= 20""",
    "code_definition_spans": f"""WITH {SYM}, {FILE},
s AS (SELECT y.repo_id, y.commit_sha, symbol_id, y.file_id, span_start, span_end, path,
      string_split(content, chr(10)) AS lines, greatest(span_start - 2, 1) AS first_line
      FROM sym y JOIN file f ON f.repo_id = y.repo_id AND f.commit_sha = y.commit_sha AND f.file_id = y.file_id
      WHERE content IS NOT NULL AND span_start > 0 AND span_end >= span_start),
c AS (SELECT *, len(lines) AS n_lines, least(span_end + 2, len(lines)) AS last0 FROM s),
n AS (SELECT *, least(greatest(last0 - first_line + 1, 0), 120) AS cnt FROM c)
SELECT {K}, symbol_id, file_id, span_start, span_end, path, first_line, CAST(first_line + cnt - 1 AS INT) AS last_line,
       CAST(n_lines AS INT) AS n_lines, last0 - first_line + 1 > 120 AS truncated,
       array_to_string(list_transform(range(first_line, first_line + cnt),
         lambda i: lpad(CAST(i AS VARCHAR), 5, ' ') || ' | ' || rtrim(replace(lines[i], chr(13), ''))), chr(10)) AS code FROM n""",
    "diff_symbols": f"WITH {DIFF} SELECT repo_id, CAST(ord AS INT) AS ord, change_kind, kind, from_id, to_id FROM d",
    "diff_statistics": f"""WITH {DIFF} SELECT repo_id, CAST(ord AS INT) AS ord,
  count(*) FILTER (change_kind = 'Added') AS n_added, count(*) FILTER (change_kind = 'Removed') AS n_removed,
  count(*) FILTER (change_kind = 'Renamed') AS n_renamed, count(*) FILTER (change_kind = 'SignatureChanged') AS n_signaturechanged,
  count(*) FILTER (change_kind = 'VisibilityChanged') AS n_visibilitychanged FROM d GROUP BY repo_id, ord""",
    "diff_fact_statistics": f"""WITH {DIFF}, {FACT}, {FACT_DIFF},
s AS (SELECT repo_id, CAST(ord AS INT) AS ord, {_SYMBOL_COUNTS} FROM d GROUP BY repo_id, ord),
f AS (SELECT repo_id, ord, {_FACT_COUNTS} FROM fact_diff GROUP BY repo_id, ord)
SELECT coalesce(s.repo_id, f.repo_id) AS repo_id, coalesce(s.ord, f.ord) AS ord, {_ALL_COUNTS}
FROM s FULL JOIN f ON f.repo_id = s.repo_id AND f.ord = s.ord""",
    "diff_facts": f"WITH {SNAPSHOTS}, {FACT}, {FACT_DIFF} SELECT * FROM fact_diff",
    "overlay_changes": f"WITH {OVERLAY} SELECT * FROM changed",
    "overlay_deleted": f"WITH {OVERLAY} SELECT * FROM deleted",
    "overlay_symbols": f"""WITH {OVERLAY}
SELECT {K}, symbol_id, kind, signature, 'overlay' AS side FROM oversym
UNION ALL
SELECT {K}, symbol_id, kind, signature, 'baseline' FROM sym y
WHERE NOT EXISTS (SELECT 1 FROM deleted x WHERE x.repo_id = y.repo_id AND x.commit_sha = y.commit_sha AND x.symbol_id = y.symbol_id)
  AND NOT EXISTS (SELECT 1 FROM changed x WHERE x.repo_id = y.repo_id AND x.commit_sha = y.commit_sha AND x.file_id = y.file_id)
  AND NOT EXISTS (SELECT 1 FROM oversym x WHERE x.repo_id = y.repo_id AND x.commit_sha = y.commit_sha AND x.symbol_id = y.symbol_id)""",
    "overlay_refs": "WITH " + OVERLAY + "," + REF + "," + _merge(
        "ref", f"{K}, ref_kind",
        "NOT EXISTS (SELECT 1 FROM deleted g WHERE g.repo_id = x.repo_id AND g.commit_sha = x.commit_sha AND g.symbol_id = x.to_symbol_id)",
    ) + f" SELECT {K}, ref_kind, side, count(*) AS n_refs FROM merged GROUP BY ALL",
    "overlay_callees": f"""WITH {OVERLAY}, {REF},
followed AS (
  SELECT x.repo_id, s.commit_sha, ref_kind, to_symbol_id, 'overlay' AS side FROM ref x JOIN step s ON s.repo_id = x.repo_id AND s.next_sha = x.commit_sha
  WHERE EXISTS (SELECT 1 FROM changed c WHERE c.repo_id = x.repo_id AND c.commit_sha = s.commit_sha AND c.file_id = x.file_id)
  UNION ALL
  SELECT {K}, ref_kind, to_symbol_id, 'baseline' FROM ref x
  WHERE NOT EXISTS (SELECT 1 FROM changed c WHERE c.repo_id = x.repo_id AND c.commit_sha = x.commit_sha))
SELECT {K}, ref_kind, side, count(*) AS n_refs FROM followed x
WHERE NOT EXISTS (SELECT 1 FROM deleted g WHERE g.repo_id = x.repo_id AND g.commit_sha = x.commit_sha AND g.symbol_id = x.to_symbol_id)
GROUP BY ALL""",
    "overlay_facts": "WITH " + OVERLAY + "," + FACT + "," + _merge("fact", f"{K}, fact_seq, fact_kind, value") + " SELECT * FROM merged",
    "overlay_type_relations": f"""WITH {OVERLAY}, {REL}
SELECT x.repo_id, s.commit_sha, type_symbol_id, related_symbol_id, relation_kind, 'overlay' AS side
FROM rel x JOIN step s ON s.repo_id = x.repo_id AND s.next_sha = x.commit_sha
JOIN oversym y ON y.repo_id = x.repo_id AND y.commit_sha = s.commit_sha AND y.symbol_id = type_symbol_id
UNION ALL
SELECT {K}, type_symbol_id, related_symbol_id, relation_kind, 'baseline' FROM rel x
WHERE NOT EXISTS (SELECT 1 FROM oversym y WHERE y.repo_id = x.repo_id AND y.commit_sha = x.commit_sha AND y.symbol_id = type_symbol_id)
  AND NOT EXISTS (SELECT 1 FROM deleted y WHERE y.repo_id = x.repo_id AND y.commit_sha = x.commit_sha AND y.symbol_id = type_symbol_id)""",
    "summary_statistics": f"""WITH {SYM}, {REF}, {FACT}, {FILE},
u AS (
  SELECT {K}, 1 AS n_symbols, CASE WHEN kind IN ('class', 'struct', 'interface', 'record', 'enum', 'delegate') THEN 1 ELSE 0 END AS n_types,
         0 AS n_files, NULL AS project, 0 AS n_refs, 0 AS n_unresolved, 0 AS n_facts FROM sym
  UNION ALL SELECT {K}, 0, 0, 1, project_name, 0, 0, 0 FROM file
  UNION ALL SELECT {K}, 0, 0, 0, NULL, 1, CASE WHEN resolution_state = 'unresolved' THEN 1 ELSE 0 END, 0 FROM ref
  UNION ALL SELECT {K}, 0, 0, 0, NULL, 0, 0, 1 FROM fact)
SELECT {K}, CAST(sum(n_symbols) AS BIGINT) AS n_symbols, CAST(sum(n_types) AS BIGINT) AS n_types, CAST(sum(n_files) AS BIGINT) AS n_files,
       count(DISTINCT project) AS n_projects, CAST(sum(n_refs) AS BIGINT) AS n_refs,
       CAST(sum(n_unresolved) AS BIGINT) AS n_unresolved, CAST(sum(n_facts) AS BIGINT) AS n_facts FROM u GROUP BY {K}""",
    "summary_levels": f"""WITH {REF}, {FILE},
p AS (SELECT r.repo_id, r.commit_sha, project_name, bool_or(resolution_state = 'resolved') AS compiled
      FROM ref r JOIN file f ON f.repo_id = r.repo_id AND f.commit_sha = r.commit_sha AND f.file_id = r.file_id
      WHERE project_name IS NOT NULL GROUP BY ALL)
SELECT {K}, count(*) AS n_projects, count(*) FILTER (compiled) AS n_compiled,
       CASE WHEN count(*) FILTER (compiled) = count(*) THEN 'Full' WHEN count(*) FILTER (compiled) = 0 THEN 'SyntaxOnly' ELSE 'Partial' END AS semantic_level
FROM p GROUP BY {K}""",
    "summary_sections": f"WITH {SECTIONS} SELECT * FROM section",
    "summary_errors_and_logs": f"""WITH {FACT}
SELECT {K}, count(DISTINCT CASE WHEN fact_kind = 'Exception' THEN trim(split_part(value, '|', 1)) END) AS n_exception_types,
       count(DISTINCT CASE WHEN fact_kind = 'Log' THEN trim(split_part(value, '|', 1)) END) AS n_log_templates
FROM fact WHERE fact_kind IN ('Exception', 'Log') GROUP BY {K}""",
    "summary_services": f"""WITH {SYM}, {FILE},
m AS (SELECT {K}, containing_type AS fqname, count(*) AS n_members,
      array_to_string(list_sort(list(DISTINCT regexp_extract(fqname, '([^.]*)$', 1))), ', ') AS members
      FROM sym WHERE containing_type IS NOT NULL AND kind IN ('method', 'property') GROUP BY {K}, containing_type)
SELECT s.repo_id, s.commit_sha, s.symbol_id, s.fqname, coalesce(n_members, 0) AS n_members, coalesce(members, '') AS members
FROM sym s JOIN file f ON f.repo_id = s.repo_id AND f.commit_sha = s.commit_sha AND f.file_id = s.file_id
LEFT JOIN m ON m.repo_id = s.repo_id AND m.commit_sha = s.commit_sha AND m.fqname = s.fqname
WHERE kind IN ('class', 'interface', 'record') AND visibility = 'public'
  AND regexp_matches(regexp_replace(s.fqname, '<.*$', ''), '(?i)(service|controller|handler|repository|manager|processor)$')
  AND NOT regexp_matches(path, '\\.(?:Tests|Benchmarks|TestUtilities)/')""",
    "summary_surface": f"""WITH {SYM}, {FILE},
seen AS (SELECT s.* FROM sym s JOIN file f ON f.repo_id = s.repo_id AND f.commit_sha = s.commit_sha AND f.file_id = s.file_id
  WHERE visibility = 'public' AND NOT (contains(path, '.Tests/') OR contains(path, '.Benchmarks/') OR contains(path, '.TestUtilities/'))),
types AS (SELECT * FROM seen WHERE kind IN ('class', 'struct', 'interface', 'record', 'enum', 'delegate')
  AND NOT coalesce(ends_with(fqname, 'AutoGeneratedProgram') OR ends_with(fqname, '<Program>$'), false))
SELECT {K}, fqname AS type_name, symbol_id, kind, signature FROM types
UNION ALL
SELECT {K}, containing_type, symbol_id, kind, signature FROM seen m WHERE kind IN ('method', 'property')
  AND EXISTS (SELECT 1 FROM types t WHERE t.repo_id = m.repo_id AND t.commit_sha = m.commit_sha AND t.fqname = m.containing_type)""",
    "summary_data_tables": f"""WITH {FACT},
one AS (SELECT *, trim(split_part(value, '|', 1)) AS table_name,
        row_number() OVER (PARTITION BY {K}, lower(trim(split_part(value, '|', 1))) ORDER BY value, fact_seq) AS n FROM fact WHERE fact_kind = 'DbTable')
SELECT {K}, table_name, value FROM one WHERE n = 1""",
    "summary_export": f"""WITH {SECTIONS},
b AS (SELECT {K}, section, CAST({_ORDER} AS INT) AS position,
      '## ' || section || chr(10) || array_to_string(list('- ' || item || ' - ' || symbol_name ORDER BY rank), chr(10)) AS body
      FROM section GROUP BY {K}, section),
r AS (SELECT *, length(body) // 4 AS tokens,
      CAST(sum(length(body) // 4) OVER (PARTITION BY {K} ORDER BY position) AS BIGINT) AS running_tokens FROM b)
SELECT {K}, section, position, tokens, running_tokens, running_tokens <= 4000 AS fits,
       CASE WHEN running_tokens <= 4000 THEN body
            ELSE regexp_replace(substr(body, 1, (4000 - (running_tokens - tokens)) * 4), '\\n[^\\n]*$', chr(10) || '...') END AS body
FROM r WHERE running_tokens - tokens < 4000""",
    "summary_projects": f"""WITH {SYM}, {FILE}
SELECT f.repo_id, f.commit_sha, project_name, count(DISTINCT f.file_id) AS n_files, count(symbol_id) AS n_symbols
FROM file f LEFT JOIN sym s ON f.repo_id = s.repo_id AND f.commit_sha = s.commit_sha AND f.file_id = s.file_id
WHERE project_name IS NOT NULL GROUP BY f.repo_id, f.commit_sha, project_name""",
    "baselines_catalog": f"""WITH {SNAPSHOTS}, {BASE},
h AS (SELECT repo_id, max(created_at) AS head_at FROM base WHERE is_current_head GROUP BY repo_id)
SELECT b.repo_id, b.commit_sha, b.created_at, size_bytes, CAST(ord AS INT) AS ord, ord IS NOT NULL AS is_built,
       coalesce(b.created_at < head_at, false) AS is_stale
FROM base b LEFT JOIN snaps n ON n.repo_id = b.repo_id AND n.commit_sha = b.commit_sha LEFT JOIN h ON h.repo_id = b.repo_id""",
    "baselines_cleanup": f"WITH {RETENTION} SELECT * FROM judged",
    "baselines_reclaimed": f"""WITH {RETENTION} SELECT repo_id, verdict, count(*) AS n_baselines, CAST(sum(size_bytes) AS BIGINT) AS bytes
FROM judged GROUP BY repo_id, verdict""",
    "structural_ids": f"""WITH {SYM},
x AS (SELECT *, concat_ws('|', kind, coalesce(containing_type, ''), coalesce(namespace, ''),
        regexp_extract(coalesce(signature, ''), '^(?:static )?([^ (]+) ', 1), regexp_extract(symbol_id, '\\((.*)\\)$', 1)) AS shape FROM sym),
n AS (SELECT *, row_number() OVER (PARTITION BY {K}, shape ORDER BY span_start, symbol_id) - 1 AS n FROM x)
SELECT {K}, symbol_id, 'sym_' || substr(sha256(CASE WHEN n > 0 THEN shape || '#' || CAST(n AS VARCHAR) ELSE shape END), 1, 16) AS structural_id FROM n""",
    "plain_ids": f"""WITH {SYM}, {FILE}
SELECT s.repo_id, s.commit_sha, symbol_id,
  'sym_' || substr(sha256(coalesce(kind, '') || chr(0) || coalesce(fqname, '') || chr(0) || coalesce(project_name, '')), 1, 16) AS plain_id,
  substr(sha256(concat_ws('|', coalesce(kind, ''), coalesce(signature, ''), coalesce(documentation, ''),
    coalesce(CAST(span_start AS VARCHAR), '') || '-' || coalesce(CAST(span_end AS VARCHAR), ''), coalesce(visibility, ''))), 1, 16) AS content_hash
FROM sym s LEFT JOIN file f ON f.repo_id = s.repo_id AND f.commit_sha = s.commit_sha AND f.file_id = s.file_id""",
    "symbols_context": f"""WITH {_bfs(_ROUTES, 'from_symbol_id', 'to_symbol_id', 10)}, {FILE},
n AS (SELECT n.repo_id, n.commit_sha, root, depth, n.symbol_id, coalesce(kind, 'method') AS kind, signature, span_start, span_end, content,
      span_end - span_start + 1 AS n_lines, CASE WHEN depth = 0 THEN 200 ELSE 50 END AS most
      FROM nodes n LEFT JOIN sym s ON s.repo_id = n.repo_id AND s.commit_sha = n.commit_sha AND s.symbol_id = n.symbol_id
      LEFT JOIN file f ON f.repo_id = s.repo_id AND f.commit_sha = s.commit_sha AND f.file_id = s.file_id WHERE depth <= 1)
SELECT {K}, root, depth, symbol_id, kind, signature, n_lines, n_lines > most AS truncated,
       CASE WHEN content IS NOT NULL AND span_start IS NOT NULL THEN array_to_string(list_slice(regexp_split_to_array(content, '\\r?\\n'),
         greatest(span_start, 1), greatest(span_start, 1) + greatest(least(n_lines, most), 0) - 1), chr(10)) END AS code FROM n""",
    "symbols_by_file": f"""WITH {SYM}, {FILE}
SELECT s.repo_id, s.commit_sha, path, count(*) AS n_symbols, array_to_string(list(symbol_id ORDER BY span_start, symbol_id), chr(10)) AS outline
FROM sym s JOIN file f ON f.repo_id = s.repo_id AND f.commit_sha = s.commit_sha AND f.file_id = s.file_id
GROUP BY s.repo_id, s.commit_sha, path""",
    "search_answers": f"""WITH {_search(['reader', 'order service', 'Snapshot.Read', 'IQueueStore', 'merge al'], 20)}
SELECT query, {K}, CASE WHEN count(*) = 1 THEN '1 symbol' ELSE CAST(count(*) AS VARCHAR) || ' symbols' END || ' for ''' || query || '''' ||
  CASE WHEN bool_or(truncated) THEN ', more exist.' ELSE '.' END || ' Best: ' || arg_min(symbol_id, rank) AS answer
FROM found GROUP BY query, {K}""",
    "diff_rendered": f"""WITH {DIFF}, {FACT}, {FACT_DIFF},
told AS (
  SELECT repo_id, CAST(ord AS INT) AS ord, 2 AS section,
         '- ' || change_kind || ': ' || coalesce(from_id || CASE WHEN to_id <> from_id THEN ' -> ' || to_id ELSE '' END, to_id) AS line FROM d
  UNION ALL
  SELECT repo_id, ord, list_position(['Route', '', 'Config', 'DbTable', 'DiRegistration'], fact_kind), '- ' || change_kind || ' ' || fact_kind || ': ' ||
         CASE WHEN fact_kind IN ('Config', 'DbTable') THEN split_part(coalesce(to_value, from_value), '|', 1) ELSE coalesce(to_value, from_value) END
  FROM fact_diff WHERE fact_kind IN ('Route', 'Config', 'DbTable', 'DiRegistration')),
placed AS (SELECT *, row_number() OVER (PARTITION BY repo_id, ord ORDER BY section, line) AS rank, count(*) OVER (PARTITION BY repo_id, ord) AS n_changes FROM told)
SELECT repo_id, ord, CAST(ceil(rank / 1000) AS INT) AS part, min(n_changes) AS n_changes, array_to_string(list(line ORDER BY rank), chr(10)) AS body
FROM placed GROUP BY repo_id, ord, CAST(ceil(rank / 1000) AS INT)""",
    "interface_callers": f"""WITH {SYM}, {REL}, {REF},
m AS (SELECT {K}, symbol_id, 'T:' || regexp_extract(symbol_id, '^[A-Z]:(.*?)\\.[^.(]+(?:\\(.*)?$', 1) AS type_symbol_id,
      substr(symbol_id, 1, 2) AS k, regexp_extract(symbol_id, '^[A-Z]:.*?(\\.[^.(]+(?:\\(.*)?)$', 1) AS tail
      FROM sym WHERE regexp_matches(symbol_id, '^[MPE]:')),
w AS (SELECT m.repo_id, m.commit_sha, m.symbol_id, k || substr(related_symbol_id, 3) || tail AS interface_member
      FROM m JOIN rel r ON r.repo_id = m.repo_id AND r.commit_sha = m.commit_sha AND r.type_symbol_id = m.type_symbol_id
      WHERE relation_kind = 'interface'),
i AS (SELECT w.* FROM w JOIN sym s ON s.repo_id = w.repo_id AND s.commit_sha = w.commit_sha AND s.symbol_id = w.interface_member),
c AS (SELECT {K}, to_symbol_id, least(count(DISTINCT from_symbol_id), 50) AS n FROM ref
      WHERE ref_kind IN ('Call', 'Instantiate') AND to_symbol_id IS NOT NULL AND from_symbol_id IS NOT NULL GROUP BY {K}, to_symbol_id)
SELECT i.repo_id, i.commit_sha, i.symbol_id, count(*) AS n_interfaces, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_callers
FROM i LEFT JOIN c ON c.repo_id = i.repo_id AND c.commit_sha = i.commit_sha AND c.to_symbol_id = i.interface_member
GROUP BY i.repo_id, i.commit_sha, i.symbol_id""",
}
