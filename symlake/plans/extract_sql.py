"""SQL twins of the source text extractors, written from what they extract: patterns and lists are
stated here anew, for an engine whose regular expressions have neither lookaround nor recursion."""

from __future__ import annotations

from symlake.plans.index_sql import FILE, K

_CUT = r"\r\n|\r|\n"
LINES = f"""{FILE},
line AS (SELECT {K}, file_id, path, unnest(regexp_split_to_array(content, '{_CUT}')) AS line,
         unnest(range(1, len(regexp_split_to_array(content, '{_CUT}')) + 1)) AS n
         FROM file WHERE content IS NOT NULL)"""
DOCUMENT_LINES = f"""line AS (
  SELECT 'documents' AS repo_id, '' AS commit_sha, CAST(doc_id AS VARCHAR) AS file_id,
         CAST(doc_id AS VARCHAR) || '.' || CASE lower(lang) WHEN 'csharp' THEN 'cs' WHEN 'vb' THEN 'vb' WHEN 'fsharp' THEN 'fs' WHEN 'sql' THEN 'sql' ELSE 'txt' END AS path,
         unnest(regexp_split_to_array(text, '{_CUT}')) AS line,
         unnest(range(1, len(regexp_split_to_array(text, '{_CUT}')) + 1)) AS n
  FROM documents WHERE text IS NOT NULL)"""

#: a string literal whose text may hold escaped signs
_STR = r'"([^"\\]*(?:\\.[^"\\]*){0,64})"'
_GENERIC = r"[A-Za-z0-9_.]+(?:<[^<>]*>)?"
_VERB = "Get|Post|Put|Delete|Patch"

#: kind, pattern, value in terms of groups {1}, {2} ..., confidence
RULES = [
    ("Route", rf'\.Map({_VERB})\(\s*"([^"]*)"', "upper({1}) || ' /' || ltrim({2}, '/')", "High"),
    ("Route", r'^\s*@page\s+"([^"]*)"', "'PAGE /' || ltrim({1}, '/')", "High"),
    ("Config", r'\b\w*(?:C|c)onfig(?:uration)?\s*\[\s*"([^"]+)"\s*\]', "{1} || '|IConfiguration indexer'", "High"),
    ("Config", r'\.GetValue(?:<[^<>]*>)?\(\s*"([^"]+)"', "{1} || '|GetValue'", "High"),
    ("Config", r'\.Configure<[^<>]*>\([^;"]*GetSection\(\s*"([^"]+)"', "{1} || '|Options Configure'", "High"),
    ("DbTable", r"\bDbSet<\s*([A-Za-z0-9_.]+)\s*>\s+(\w+)", "{2} || '|DbSet<' || {1} || '>'", "High"),
    ("DbTable", r"\b(\w+)\s+As\s+DbSet\(Of\s+([A-Za-z0-9_.]+)\s*\)", "{1} || '|DbSet<' || {2} || '>'", "High"),
    ("DbTable", r'(?:\[|<)Table\(\s*"([^"]+)"(?:\s*,\s*Schema\s*:?=\s*"([^"]+)")?\s*\)',
     "CASE WHEN {2} <> '' THEN {2} || '.' ELSE '' END || {1} || '|[Table]'", "High"),
    ("DiRegistration",
     rf"\.(?:Try)?Add(Singleton|Scoped|Transient|HostedService)\s*(?:<\s*({_GENERIC})\s*(?:,\s*({_GENERIC})\s*)?>)?\s*\(\s*"
     r"(?:(\(?\w+\)?\s*=>)\s*(?:new\s+([A-Za-z0-9_.]+))?|new\s+([A-Za-z0-9_.]+))?",
     "CASE WHEN {2} <> '' THEN {2} WHEN {4} <> '' AND {5} <> '' THEN {5} WHEN {4} <> '' THEN 'unknown' END || ' → ' || "
     "CASE WHEN {3} <> '' THEN {3} WHEN {4} <> '' THEN 'factory' WHEN {6} <> '' THEN {6} ELSE {2} END || '|' || "
     "CASE {1} WHEN 'HostedService' THEN 'Singleton|HostedService' ELSE {1} END", "High"),
    ("DiRegistration", r"\.(?:Try)?Add(Singleton|Scoped|Transient|HostedService)\(Of\s+([A-Za-z0-9_.]+)\s*(?:,\s*([A-Za-z0-9_.]+)\s*)?\)",
     "{2} || ' → ' || CASE WHEN {3} <> '' THEN {3} ELSE {2} END || '|' || CASE {1} WHEN 'HostedService' THEN 'Singleton|HostedService' ELSE {1} END", "High"),
    ("Exception", r"(?:(\?\?|=>|\?|:)\s*)?\b(?:T|t)hrow\s+(?:N|n)ew\s+([A-Za-z0-9_.]+)(?:<[^<>]*>)?\s*\(([^;()]*(?:\([^()]*\)[^;()]*){0,8})",
     "split_part({2}, '.', -1) || '|' || CASE WHEN contains({3}, 'nameof(') THEN 'throw new (nameof guard)' WHEN {1} <> '' THEN 'throw expression' ELSE 'throw new' END", "High"),
    ("Log", rf"\.Log(?:(Trace|Debug|Information|Warning)\(\s*|(Error|Critical)\(\s*(?:\w+\s*,\s*)?)(\$)?{_STR}",
     "CASE WHEN {3} = '$' THEN '$\"' || {4} || '\"' ELSE {4} END || '|' || {1} || {2}", "High"),
    ("Log", rf"\.Log\(\s*LogLevel\.(\w+)\s*,\s*(\$)?{_STR}", "CASE WHEN {2} = '$' THEN '$\"' || {3} || '\"' ELSE {3} END || '|' || {1}", "High"),
    ("RetryPolicy", r"\.(RetryAsync|WaitAndRetryAsync)\s*(?:<[^<>]*>)?\(\s*(?:\w+\s*:\s*)?(\d*)",
     "{1} || CASE WHEN {2} <> '' THEN '(' || {2} || ')' ELSE '' END || '|Polly'", "Medium"),
    ("RetryPolicy", r"\.(CircuitBreakerAsync|AddCircuitBreaker)\s*(?:<[^<>]*>)?\(",
     "'CircuitBreaker|' || CASE {1} WHEN 'AddCircuitBreaker' THEN 'Resilience' ELSE 'Polly' END", "Medium"),
    ("RetryPolicy", r"\.(AddRetry|AddResilienceHandler|AddTransientHttpErrorPolicy)\s*(?:<[^<>]*>)?\(",
     "CASE {1} WHEN 'AddRetry' THEN 'AddRetry|Resilience' WHEN 'AddResilienceHandler' THEN 'ResilienceHandler|Resilience' ELSE 'TransientHttpErrorPolicy|Polly' END", "Medium"),
    ("RazorInject", r"^\s*@inject\s+([A-Za-z0-9_.<>]+)\s+(\w+)", "{2} || ': ' || {1}", "High"),
    ("RazorParameter", r"\[Parameter\]\s*public\s+([^\s{]+)\s+(\w+)\s*\{", "{2} || ': ' || {1}", "High"),
]

_CONFIGURED = r'\.Configure<[^<>]*>\([^;"]*GetSection\(\s*"[^"]+"'
_SECTION = r'\.GetSection\(\s*"([^"]+)"'
_ACTION = r'(?:\[|<|,)\s*Http(Get|Post|Put|Delete|Patch|Head|Options)\s*(?:\(\s*(?:"([^"]*)")?[^)]*\))?\s*(?:\]|>|,)'
_PREFIX = r'(?:\[|<|,)\s*Route\(\s*"([^"]*)"'
_CLASS = r"^\s*(?:[A-Za-z]+\s+)*(?:C|c)lass\s+(\w+)"
_CATCH = r"\bcatch\b(?:\s*\(\s*([A-Za-z0-9_.<>]+))?|^\s*Catch\b(?:\s+\w+\s+As\s+([A-Za-z0-9_.]+))?"
_AGAIN = r"\bthrow\s*;|^\s*Throw\s*$"
_PIPE = r"\b(?:A|a)pp\w*\.((?:Use|Map)\w+)\s*(?:\(|<)"
_TABLE = r"(?i)\b(?:FROM|INTO|UPDATE|JOIN)\s+((?:\[?\w+\]?\.)?\[?\w+\]?)"
_NO_TABLE = "'select','where','set','table','database','view','index','inner','outer','left','right','cross','full','on'"
_META = "'sys','information_schema','pg_catalog','mysql','performance_schema'"


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _has(pattern: str, x: str = "line") -> str:
    return f"regexp_matches({x}, '{q(pattern)}')"


def _part(pattern: str, i: int, x: str = "line") -> str:
    return f"regexp_extract({x}, '{q(pattern)}', {i})"


def _rule(kind: str, pattern: str, value: str, confidence: str, line: str = "line") -> str:
    for i in range(1, 7):
        value = value.replace(f"{{{i}}}", _part(pattern, i, "m"))
    return f"""SELECT {K}, file_id, CAST(n AS INT) AS line, '{kind}' AS fact_kind, {value} AS value, '{confidence}' AS confidence
FROM (SELECT *, unnest(regexp_extract_all({line}, '{q(pattern)}')) AS m FROM code)"""


def _table_names(text: str) -> str:
    """Names in a text's SQL, the first spelling of each."""
    found = f"list_transform(regexp_extract_all(regexp_replace({text}, '\\s+', ' ', 'g'), '{q(_TABLE)}', 1), lambda t: replace(replace(t, '[', ''), ']', ''))"
    kept = (
        f"list_filter({found}, lambda t: t <> '' AND lower(t) NOT IN ({_NO_TABLE}) AND NOT starts_with(lower(t), 'sqlite_') "
        f"AND NOT (contains(t, '.') AND lower(split_part(t, '.', 1)) IN ({_META})))"
    )
    return f"list_filter({kept}, lambda t, i: list_position(list_transform({kept}, lambda u: lower(u)), lower(t)) = i)"


def facts(lines: str = LINES) -> str:
    plain = " UNION ALL ".join(_rule(*r) for r in RULES)
    section = _rule("Config", _SECTION, "{1} || '|GetSection'", "High", f"regexp_replace(line, '{q(_CONFIGURED)}', '', 'g')")
    strings = "array_to_string(regexp_extract_all(line, '\"([^\"]*)\"', 1), ' ')"
    w = f"PARTITION BY {K}, file_id ORDER BY n"
    own = f"ltrim({_part(_ACTION, 2, 'm')}, '/')"
    joined = f"CASE WHEN owner IS NULL OR owner.prefix IS NULL THEN {own} WHEN {own} = '' THEN rtrim(owner.prefix, '/') ELSE rtrim(owner.prefix, '/') || '/' || {own} END"
    controller = "lower(regexp_replace(coalesce(owner.name, ''), 'Controller$', ''))"
    return f"""WITH {lines},
code AS (SELECT * FROM line WHERE NOT regexp_matches(line, '^\\s*(?://|\\*|/\\*|'')')),
raw AS (SELECT {K}, file_id, CAST(n AS INT) AS line, unnest({_table_names(strings)}) AS t FROM code),
pipe AS (
  SELECT {K}, file_id, n, i, name, row_number() OVER (PARTITION BY {K}, file_id ORDER BY n, i) AS pos FROM (
    SELECT {K}, file_id, n, unnest(regexp_extract_all(line, '{q(_PIPE)}', 1)) AS name, generate_subscripts(regexp_extract_all(line, '{q(_PIPE)}', 1), 1) AS i FROM code)
  WHERE name NOT IN ('MapGet', 'MapPost', 'MapPut', 'MapDelete', 'MapPatch')),
route1 AS (
  SELECT *, CASE WHEN {_has(_PREFIX)} AND NOT {_has(_ACTION)} THEN {_part(_PREFIX, 1)} END AS route FROM code
  WHERE {_has(_CLASS)} OR {_has(_PREFIX)} OR {_has(_ACTION)}),
route2 AS (SELECT *, lag(route) OVER ({w}) AS before FROM route1),
route3 AS (
  SELECT *, last_value(CASE WHEN {_has(_CLASS)} THEN {{'name': {_part(_CLASS, 1)}, 'prefix': coalesce(route, before)}} END IGNORE NULLS) OVER ({w}) AS owner FROM route2),
action AS (SELECT *, unnest(regexp_extract_all(line, '{q(_ACTION)}')) AS m FROM route3),
thrown AS (
  SELECT *, last_value(CASE WHEN {_has(_CATCH)} THEN coalesce(nullif({_part(_CATCH, 1)} || {_part(_CATCH, 2)}, ''), 'Exception') END IGNORE NULLS) OVER ({w}) AS type
  FROM code WHERE {_has(_CATCH)} OR {_has(_AGAIN)})
SELECT * FROM ({plain} UNION ALL {section}) WHERE value IS NOT NULL
UNION ALL SELECT {K}, file_id, line, 'DbTable', t || '|Raw SQL', 'Medium' FROM raw
UNION ALL SELECT {K}, file_id, CAST(n AS INT), 'Middleware', name || '|pos:' || CAST(pos AS VARCHAR) || CASE WHEN starts_with(name, 'Map') THEN '|terminal' ELSE '' END, 'High' FROM pipe
UNION ALL SELECT {K}, file_id, CAST(n AS INT), 'Route', upper({_part(_ACTION, 1, 'm')}) || ' ' ||
  regexp_replace('/' || ltrim({joined}, '/'), '(?i)\\[controller\\]', {controller}, 'g'), 'High' FROM action
UNION ALL SELECT {K}, file_id, CAST(n AS INT), 'Exception', coalesce(type, 'Exception') || '|re-throw', 'High' FROM thrown WHERE {_has(_AGAIN)}"""


#: declarations, in the order in which a line is tried: files, pattern, kind, group of the name
_CS_WORDS = "public|internal|private|protected|static|sealed|abstract|partial|readonly|file|ref"
_CS_TYPE = rf"^\s*(?:(?:{_CS_WORDS})\s+)*(class|struct|interface|record|enum)\s+(?:(?:class|struct)\s+)?([A-Za-z_]\w*)"
_CS_PROPERTY = r"^\s*(?:(?:public|internal|private|protected|static|virtual|override|abstract|required|new)\s+)+([A-Za-z0-9_.<>\[\],?]+)\s+([A-Za-z_]\w*)\s*\{\s*(?:get|set|init)\b"
_CS_METHOD = (
    r"^\s*(?:(?:public|internal|private|protected|static|sealed|abstract|virtual|override|async|extern|partial|new|unsafe)\s+)+"
    r"(?:[A-Za-z0-9_.<>\[\],?]+\s+)?([A-Za-z_]\w*)\s*(?:<[^>(]*>)?\(([^)]*)\)\s*(?:where .*|:.*)?(?:\{|=>.*)?\s*$"
)
_VB_TYPE = r"(?i)^\s*(?:(?:Public|Friend|Private|Protected|MustInherit|NotInheritable|Partial|Shadows)\s+)*(Class|Structure|Interface|Module|Enum)\s+(\w+)"
_VB_METHOD = r"(?i)^\s*(?:(?:Public|Friend|Private|Protected|Shared|Overrides|Overridable|MustOverride|Async|Overloads)\s+)+(?:Sub|Function)\s+(\w+)\s*\("
_ATTRIBUTES = r"^\s*(?:\[<[^>]*>\]\s*)*"
_HIDDEN = r"(?:(?:private|internal|public)\s+)?"
_FS = [
    (rf"{_ATTRIBUTES}module\s+(?:rec\s+)?{_HIDDEN}(?:\w+\.)*(\w+)", "'class'", 1),
    (rf"{_ATTRIBUTES}(?:type\s+{_HIDDEN}(\w+)|and\s+{_HIDDEN}([A-Z]\w*))",
     r"CASE WHEN regexp_matches(line, '\[<\s*(?:\w+\s*;\s*)*Struct\b|=\s*(?i:struct)\b') THEN 'struct' "
     r"WHEN regexp_matches(line, '\[<\s*(?:\w+\s*;\s*)*Interface\b|=\s*(?i:interface)\b') THEN 'interface' ELSE 'class' END", 0),
    (rf"{_ATTRIBUTES}(?:static\s+)?(?:member|override|default|abstract)\s+(?:(?:member|inline|private|internal|public)\s+)*(?:\w+\.)?(\w+)", "'method'", 1),
    (rf"{_ATTRIBUTES}(?:let|and)\s+(?:(?:rec|inline|mutable|private|internal|public)\s+)*(\w+)", "'method'", 1),
]
_NAMESPACE = r"(?i)^\s*namespace\s+([A-Za-z0-9_.]+)"
_CS, _VB, _FSX = "lower(path) LIKE '%.cs'", "lower(path) LIKE '%.vb'", "(lower(path) LIKE '%.fs' OR lower(path) LIKE '%.fsx')"
DECLARATIONS = [
    (_CS, _CS_TYPE, f"lower({_part(_CS_TYPE, 1)})", _part(_CS_TYPE, 2)),
    (_CS, _CS_PROPERTY, "'property'", _part(_CS_PROPERTY, 2)),
    (_CS, _CS_METHOD, "'method'", _part(_CS_METHOD, 1)),
    (_VB, _VB_TYPE, f"CASE lower({_part(_VB_TYPE, 1)}) WHEN 'structure' THEN 'struct' WHEN 'module' THEN 'class' ELSE lower({_part(_VB_TYPE, 1)}) END", _part(_VB_TYPE, 2)),
    (_VB, _VB_METHOD, "'method'", _part(_VB_METHOD, 1)),
    *((_FSX, p, kind, _part(p, i) if i else f"({_part(p, 1)} || {_part(p, 2)})") for p, kind, i in _FS),
]


def _declared(columns: str, lines: str) -> str:
    case = lambda at: "CASE " + " ".join(f"WHEN {d[0]} AND {_has(d[1])} THEN {d[at]}" for d in DECLARATIONS) + " END"
    return f"""WITH {lines},
found AS (
  SELECT *, {case(2)} AS kind, {case(3)} AS name,
         last_value(CASE WHEN {_has(_NAMESPACE)} THEN {_part(_NAMESPACE, 1)} END IGNORE NULLS) OVER (PARTITION BY {K}, file_id ORDER BY n) AS namespace
  FROM line)
SELECT {columns} FROM found WHERE kind IS NOT NULL"""


_CALL = r"((?:new\s+)?(?:[A-Za-z_]\w*\??\.)?[A-Za-z_]\w*)(?:<[^<>()]*>)?\("
_NO_CALL = (
    "'if','for','foreach','while','switch','catch','using','lock','return','new','throw','await','nameof','typeof','sizeof','when','fixed','base','this'"
)
_BASES = r"\b(?:class|struct|interface|record)\s+[A-Za-z_]\w*(?:<[^>]*>)?(?:\([^)]*\))?\s*:\s*([^{]+)"

SQL = {
    "extract_document_facts": f"SELECT fact_kind, count(*) AS n_facts, count(DISTINCT file_id) AS n_documents FROM ({facts(DOCUMENT_LINES)}) GROUP BY fact_kind",
    "extract_facts": facts(),
    "extract_symbols": _declared(f"{K}, file_id, CAST(n AS INT) AS line, kind, name, namespace, 'Low' AS confidence", LINES),
    "extract_document_symbols": _declared("file_id, CAST(n AS INT) AS line, kind, name, namespace", DOCUMENT_LINES),
    "extract_relations": f"""WITH {LINES},
h AS (SELECT {K}, file_id, {_part(_CS_TYPE, 2)} AS type_name,
      regexp_split_to_array(regexp_replace({_part(_BASES, 1)}, '\\s*where\\b.*$|<[^>]*>|\\([^)]*\\)', '', 'g'), '\\s*,\\s*') AS names
      FROM line WHERE {_has(_CS_TYPE)} AND {_has(_BASES)}),
r AS (SELECT {K}, file_id, type_name, unnest(names) AS related, unnest(range(0, len(names))) AS place FROM h)
SELECT {K}, file_id, type_name, trim(related) AS related_name,
       CASE WHEN place > 0 OR regexp_matches(trim(related), '^(?:\\w+\\.)*I[A-Z]') THEN 'Interface' ELSE 'BaseType' END AS relation_kind
FROM r WHERE trim(related) <> ''""",
    "extract_calls": f"""WITH {LINES},
c AS (SELECT {K}, file_id, n, unnest(regexp_extract_all(regexp_replace(line, '"(?:[^"\\\\]|\\\\.)*"', '""', 'g'), '{q(_CALL)}', 1)) AS call
      FROM line WHERE regexp_matches(path, '(?i)\\.cs$') AND NOT regexp_matches(line, '^\\s*(?://|\\*|/\\*|\\[)')
        AND NOT {_has(_CS_METHOD)} AND NOT {_has(_CS_TYPE)})
SELECT {K}, file_id, CAST(n AS INT) AS line, CASE WHEN regexp_matches(call, '^new\\s') THEN 'Instantiate' ELSE 'Call' END AS ref_kind,
       regexp_extract(call, '(\\w+)$', 1) AS to_name,
       CASE WHEN contains(call, '.') THEN regexp_extract(call, '(\\w+)\\??\\.\\w+$', 1) END AS to_container_hint,
       'unresolved' AS resolution_state
FROM c WHERE regexp_extract(call, '(\\w+)$', 1) NOT IN ({_NO_CALL})""",
    "extract_sql_tables": f"SELECT doc_id, unnest({_table_names('text')}) AS table_name FROM documents WHERE lower(lang) = 'sql'",
}
