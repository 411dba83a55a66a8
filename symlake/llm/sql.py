"""SQL twins of the text queries that SQL can express: patterns and limits are stated anew."""

from __future__ import annotations


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


_PATHS = {
    "decompiled": r"(?i)^decompiled/",
    "generated": (
        r"(?i)\.(?:g|g\.i|generated|designer|pb|grpc)\.(?:cs|vb|fs)$|(?:^|/)(?:obj|generated)/"
        r"|(?:^|/)connected services/.*/reference\.(?:cs|vb)$|_pb2(?:_grpc)?\.py$"
    ),
    "vendored": (
        r"(?i)^(?:vendor|third_party|thirdparty|packages|external)/"
        r"|(?:^|/)(?:node_modules|bower_components|thirdparty|third_party|site-packages)/|(?:^|/)wwwroot/lib/"
    ),
    "minified": r"(?i)\.min\.(?:js|css|mjs)$|\.bundle\.(?:js|css)$|(?:^|/)dist/[^/]*\.[0-9a-f]{6,}\.(?:js|css)$",
}
_MARKS = {
    "generated": (
        r"(?im)^[ \t]*(?:(?://+|'|/\*+|\*|#|--|<!--|rem )[ \t]*)?(?:</?auto-?generated[ \t]*/?>[ \t]*(?:\*/|-->)?[ \t]*\r?$"
        r"|@generated\b|(?:this )?(?:code|file) (?:was|is) (?:auto(?:matically)?[- ])?generated by\b|code emitted by\b"
        r"|do not modify\b.*\boutput of\b|do not edit\b.*\bgenerated\b|machine-written by\b|source: .*\(template output\)"
        r"|automatisch erzeugt|(?:fichier )?(?:produit|g[eé]n[eé]r[eé]) automatiquement|auto-?generated (?:by|from)\b"
        r"|generado autom[aá]ticamente)"
    ),
    "vendored": (
        r"(?im)permission to use, copy|third[- ]party component\b.*:|report bugs upstream|upstream copy, |taken unchanged from\b"
        r"|\(c\) the \w+ contributors"
    ),
}
_DECLARES = (
    r"(?:(?:public|internal|private|protected|friend|static|sealed|abstract|partial|export|default|async|readonly|notinheritable)\s+)*"
    r"(?:class|struct|structure|interface|enum|record|delegate|function|def|const|let|var|type)\b"
)
_HEAD = (
    f"CASE WHEN regexp_matches(content, '(?im)^[ \\t]*{_DECLARES}') "
    f"THEN regexp_extract(content, '(?is)\\A(.*?(?:^|[\\r\\n]))[ \\t]*{_DECLARES}', 1) ELSE content END"
)
#: longest line, mean line, white space at most, letters and digits at least, numbers, encoded runs
_LIMITS = """(VALUES ('js', 500, 200, 0.10, 0.50, 0.5, 0.4), ('mjs', 500, 200, 0.10, 0.50, 0.5, 0.4), ('ts', 500, 200, 0.10, 0.50, 0.5, 0.4),
  ('css', 300, 120, 0.10, 0.60, 0.5, 0.4), ('cs', 1000, 400, 0.08, 0.45, 0.6, 0.4)) limits(ext, l_max, l_mean, l_space, l_alnum, l_numeric, l_encoded)"""

VERDICTS = f"""
rows AS (
  SELECT DISTINCT file_id, content, is_virtual, project_name,
         regexp_replace(replace(coalesce(path, ''), '\\', '/'), '^(?:\\./)+', '') AS p
  FROM files WHERE file_id IS NOT NULL),
cut AS (
  SELECT *, lower(regexp_extract(p, '\\.([^./]*)$', 1)) AS own, regexp_split_to_array(content, '\\r\\n|\\r|\\n') AS lines,
         len(list_filter(regexp_extract_all(content, '[\\w.]+'), lambda w: regexp_full_match(w, '(?:0[xX][0-9A-Fa-f]+|\\d+(?:\\.\\d+)?)[uUlLfFdDmM]*'))) AS numbers,
         len(regexp_extract_all(content, '0[xX][0-9A-Fa-f]+|\\d+(?:\\.\\d+)?|[A-Za-z_]\\w*')) AS tokens,
         greatest(length(content), 1) AS chars
  FROM rows),
measured AS (
  SELECT *, list_max(list_transform(lines, lambda x: length(x))) AS longest, list_sum(list_transform(lines, lambda x: length(x))) AS total,
         greatest(len(list_filter(lines, lambda x: trim(x) <> '')), 1) AS n,
         1 - length(regexp_replace(content, '\\s+', '', 'g')) / chars AS space,
         1 - length(regexp_replace(content, '[A-Za-z0-9]+', '', 'g')) / chars AS alnum,
         1 - length(regexp_replace(content, '[A-Za-z0-9+/=_-]{{40,}}', '', 'g')) / chars AS encoded,
         numbers / greatest(tokens, 1) AS numeric_share
  FROM cut),
laid AS (
  SELECT m.*, CASE
    WHEN length(content) >= 400 AND (numeric_share >= coalesce(l_numeric, 0.6) OR encoded >= coalesce(l_encoded, 0.4)) THEN 'data'
    WHEN longest >= coalesce(l_max, 1000) AND (longest >= 0.5 * total OR total >= coalesce(l_mean, 400) * n)
     AND space <= coalesce(l_space, 0.08) AND alnum >= coalesce(l_alnum, 0.45) THEN 'minified' END AS layout_verdict
  FROM measured m LEFT JOIN {_LIMITS} ON ext = own),
judged AS (
  SELECT file_id, layout_verdict, CASE
    WHEN is_virtual = 1 OR regexp_matches(p, '{q(_PATHS['decompiled'])}') THEN 'decompiled'
    WHEN regexp_matches(p, '{q(_PATHS['generated'])}') THEN 'generated'
    WHEN regexp_matches(p, '{q(_PATHS['vendored'])}') THEN 'vendored'
    WHEN regexp_matches(p, '(?i)^(?:src|tests)/') AND project_name <> '' AND NOT starts_with(lower(split_part(p, '/', 2)), lower(trim(project_name))) THEN 'vendored'
    WHEN regexp_matches(p, '{q(_PATHS['minified'])}') THEN 'minified'
    WHEN content IS NULL THEN NULL
    WHEN regexp_matches({_HEAD}, '{q(_MARKS['generated'])}') THEN 'generated'
    WHEN regexp_matches({_HEAD}, '{q(_MARKS['vendored'])}') THEN 'vendored'
    ELSE layout_verdict END AS verdict
  FROM laid)"""

SQL: dict[str, str] = {
    "p7_found": f"WITH {VERDICTS} SELECT DISTINCT file_id FROM judged WHERE verdict IS NOT NULL",
    "p7_verdicts": f"""WITH {VERDICTS}
SELECT verdict, count(DISTINCT file_id) AS n_files, count(DISTINCT CASE WHEN layout_verdict IS NOT NULL THEN file_id END) AS n_by_layout
FROM judged WHERE verdict IS NOT NULL GROUP BY verdict""",
}
