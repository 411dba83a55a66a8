"""Functions paired with their documentation, without empty or trivial documentation.

Two inputs: rows of ``symbols`` that already carry signature and documentation, and source
files, from which :func:`source_functions` reads them: signatures by regular expressions,
bodies by a stack of braces, indentation or end keywords, and the adjacent comment by its
distance in lines. A symbol whose file has content gets what is read at its place there; the
stored documentation speaks for the others. All go through :func:`tells_something`, which keeps
documentation that has at least one word beyond name, signature, markup and stock phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.functions.text import fold, squeeze

#: Kinds of symbols that are functions.
FUNCTION_KINDS = ["method", "constructor", "operator"]

#: Words of filler and placeholder documentation, which say nothing alone.
STOCK = """
the a an this that these those of to for in on by with and or is are be been will from as it its at
method methods function procedure operator constructor ctor property member class struct interface
record type object instance new create initialize initialise get set return perform do does
did use used using helper utility operation operate implementation implement implicit explicit
default value parameter param argument result summary remark description describe documentation
document docs doc todo fixme tbd tba wip xxx na none null nothing placeholder comment missing
write add fill see above below here go goes inherit inheritdoc auto automatically generate stub no
not available yet later pending under construction to come soon empty text goes lorem ipsum
represent provide handle execute run call invoke simple wrapper override overload base
der die das den dem ein eine einen und oder von zu für ist wird kommentar fehlt fehlen beschreibung
dokumentation noch keine kein folgt siehe oben methode funktion konstruktor
le la les un une des du de et ou pour est à documenter compléter commentaire manquant description
documentation absente aucune voir ci dessus méthode fonction constructeur
el los las una uno del para es documentar comentario falta descripción documentación sin pendiente
ver arriba método función constructor
""".split()

CAMEL = r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def stems(text: Column) -> Column:
    """Distinct stems of a text's words: parts of compound names apart, in lower case."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), CAMEL, " "))
    t = F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}]+", " ")
    t = F.regexp_replace(t, r"(\p{L}{2,})(?:ies|ied)(?= |$)", "$1y")
    t = F.regexp_replace(t, r"(\p{L}{3,})(?:ing|ed)(?= |$)", "$1")
    t = F.regexp_replace(t, r"(\p{L}{3,}?)[es]+(?= |$)", "$1")
    return F.array_distinct(F.split(F.trim(t), " "))


def without_markup(doc: Column) -> Column:
    """The text of a documentation, plain or XML; whatever element holds it."""
    t = F.regexp_replace(doc, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<!\[CDATA\[|\]\]>", " ")
    t = F.regexp_replace(t, r"</?[A-Za-z][^<>]*>", " ")
    return F.regexp_replace(t, r"&#?\w{1,12};", " ")


def tells_something(doc: Column, name: Column, signature: Column, owner: Column) -> Column:
    """Whether ``doc`` has a word that name, signature, owner and stock phrases have not.

    Null, empty and blank documentation, bare markup, placeholders and restated names give
    false. Text in any element and any language or script counts, and so does an order of
    growth like O(n); numbers alone do not.
    """
    named = F.array_join(F.regexp_extract_all(doc, F.lit(r"""name\s*=\s*["']([^"']*)"""), 1), " ")
    known = stems(F.concat_ws(" ", name, signature, owner, named))
    stock = stems(F.lit(" ".join(STOCK)))
    said = F.filter(
        stems(without_markup(doc)),
        lambda w: w.rlike(r"\p{L}") & (~w.rlike("^[a-z]$")),
    )
    order = without_markup(doc).rlike(r"\bO\([^)]+\)")
    return F.coalesce((F.size(F.array_except(F.array_except(said, stock), known)) > 0) | order, F.lit(False))


def last_name(symbol_id: Column) -> Column:
    """Simple name in a documentation-comment id: without prefix, owner, parameters."""
    return F.regexp_extract(F.regexp_replace(symbol_id, r"[({].*$", ""), r"([^.:]*)$", 1)


PLACE = ["repo_id", "commit_sha", "file_id"]


def function_rows(symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The functions among ``symbols``: ``symbol_id, kind, signature, documentation, owner, origin``.

    With ``files`` (repo_id, commit_sha, file_id, path, content) a symbol whose file has content
    in its snapshot takes the comment that :func:`source_functions` attaches to the function in
    its first line (``origin`` is ``source``); where that has none, or the file has no content,
    the stored documentation holds (``stored``). Rows with a null symbol_id are left out.
    """
    rows = symbols.where(fold(F.col("kind")).isin(FUNCTION_KINDS) & F.col("symbol_id").isNotNull()).select(
        *(PLACE if files is not None else []),
        *(["span_start"] if files is not None else []),
        "symbol_id",
        fold(F.col("kind")).alias("kind"),
        squeeze(F.col("signature")).alias("signature"),
        squeeze(F.col("documentation")).alias("documentation"),
        F.regexp_extract(F.coalesce("containing_type", F.lit("")), r"([^.:]*)$", 1).alias("owner"),
    )
    if files is None:
        return rows.withColumn("origin", F.lit("stored"))
    #: of functions that begin in one line the last comment by its letters
    comments = (
        _read_functions(files, PLACE)
        .where("documentation <> ''")
        .groupBy(*PLACE, F.col("first_line").alias("span_start"))
        .agg(F.max("documentation").alias("comment"))
    )
    joined = rows.join(comments, [*PLACE, "span_start"], "left")
    return joined.select(
        "symbol_id",
        "kind",
        "signature",
        F.coalesce(squeeze(F.col("comment")), "documentation").alias("documentation"),
        "owner",
        F.when(F.col("comment").isNull(), "stored").otherwise("source").alias("origin"),
    )


def _judged(rows: DataFrame, *by: str) -> DataFrame:
    """Groups of :func:`function_rows` of which a row tells something. Rows that repeat, as from
    snapshot to snapshot, are judged once."""
    once = rows.where(F.col("documentation").rlike(r"\p{L}")).distinct()
    tells = tells_something(F.col("documentation"), last_name(F.col("symbol_id")), F.col("signature"), F.col("owner"))
    return once.groupBy(*by).agg(F.max(tells).alias("tells")).where("tells").drop("tells")


def symbol_pairs(symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Pairs of the functions among ``symbols``: ``symbol_id, kind, signature, documentation``.

    Kinds in any spelling; one row per distinct pair, white space evened out; a null signature
    counts as empty. Inputs as for :func:`function_rows`.
    """
    rows = function_rows(symbols, files).drop("origin")
    return _judged(rows, "symbol_id", "kind", "signature", "documentation")


def documented_symbols(symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``symbol_id`` of the functions with a pair in :func:`symbol_pairs`, each once."""
    return _judged(function_rows(symbols, files).drop("kind", "origin"), "symbol_id")


def pair_origins(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Documented symbols by where their documentation was read: ``origin, n_symbols``; a symbol
    counts in both if its snapshots differ."""
    both = _judged(function_rows(symbols, files).drop("kind"), "symbol_id", "origin")
    return both.groupBy("origin").agg(F.count("*").alias("n_symbols"))


# --- functions read from source files -------------------------------------------------------

#: Lines between a comment's end and the signature it still belongs to (attributes not counted).
NEAR = 1

MODIFIERS = (
    r"(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|extern|partial|new|"
    r"readonly|unsafe|final|synchronized|export|default)\s+)*"
)
BRACED = re.compile(
    rf"^\s*{MODIFIERS}(?:(?P<js>function)\s+|(?P<type>[A-Za-z_][\w.<>\[\],?\s]*?)\s+)?"
    r"(?P<name>(?:operator\s*\S{1,3}|[A-Za-z_]\w*))\s*(?:<[\w,\s]+>)?\s*\((?P<params>[^;{}]*)\)\s*"
    r"(?:where\b[^{;]*|throws\b[^{;]*|:\s*(?:base|this)\s*\([^{]*\))?\s*(?P<open>\{|=>|;)?\s*"
)
#: The same with a type after the parameters.
SCRIPT = re.compile(BRACED.pattern.replace(r"(?:where\b", r"(?::[^{;=]*|where\b"))
ARROW = re.compile(
    r"^\s*(?:export\s+)?(?:(?:const|let|var|public|private|protected|static|readonly)\s+)*(?P<name>[A-Za-z_$][\w$]*)\s*"
    r"(?::[^=]*)?=\s*(?:async\s+)?(?:<[\w,\s]+>\s*)?(?:\((?P<params>.*?)\)\s*(?::[^={]*)?|[A-Za-z_$][\w$]*\s*)=>\s*(?P<open>\{)?"
)
#: How far a signature's first line goes at least, for those that close their parenthesis later.
WRAPPED = {
    "braced": re.compile(rf"^\s*{MODIFIERS}(?:[A-Za-z_][\w.<>\[\],?\s]*?\s+)?[A-Za-z_]\w*\s*(?:<[\w,\s]+>)?\s*\("),
    "arrow": re.compile(r"^[^(]*=\s*(?:async\s+)?\("),
    "indented": re.compile(r"^\s*(?:async\s+)?def\s+\w+\s*\("),
    "keyword": re.compile(r"^[\w\s]*\b(?:Function|Sub|Operator)\s+\S+\s*\(", re.I),
    "ruby": re.compile(r"^\s*def\s+\S+\s*\(|^\s*def\s+\S+\("),
    "sql": re.compile(r"^\s*(?:CREATE|ALTER)\b", re.I),
}
#: What is no code in a line, for counting parentheses.
BARE = {
    "braced": r"//.*$", "script": r"//.*$", "indented": r"#.*$", "keyword": r"'.*$", "ruby": r"#.*$", "sql": r"--.*$",
}
RUBY = re.compile(r"^\s*def\s+(?:self\.|\w+\.)?(?P<name>\w+[?!=]?|[^\w\s(]{1,3})(?P<rest>.*)$")
RUBY_OPENS = re.compile(r"^\s*(?:if|unless|while|until|case|for|begin|class|module|def)\b|\bdo\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|unless|case|begin)\b")
SQL_FUNCTION = re.compile(
    r"^\s*(?:CREATE(?:\s+OR\s+(?:REPLACE|ALTER))?|ALTER)\s+(?:FUNCTION|PROCEDURE)\s+(?:IF\s+NOT\s+EXISTS\s+)?"
    r"(?:[\w\"\[\]`]+\.)*[\"\[`]?(?P<name>\w+)",
    re.I,
)
INDENTED = re.compile(
    r"^(?P<indent>\s*)(?:async\s+)?(?:def\s+(?P<name>\w+)\s*\((?P<params>.*)|"
    r"(?:let|member)\s+(?:rec\s+|inline\s+|private\s+|(?:\w+|_)\.)*(?P<fname>\w+)\s+(?P<fparams>[^=]+)=)"
)
KEYWORD = re.compile(
    r"^\s*(?:(?:Public|Private|Protected|Friend|Shared|Overrides|Overridable|Async|Overloads)\s+)*"
    r"(?P<open>Function|Sub|Operator)\s+(?P<name>\w+|\S{1,2})\s*\((?P<params>[^)]*)\)",
    re.I,
)
#: Words before a parenthesis that open statements, not functions.
STATEMENTS = frozenset(
    "if for foreach while switch catch using lock return new throw await fixed when nameof typeof sizeof else do "
    "assert yield in is as base this case".split()
)
COMMENT = {
    "braced": ("//", "*", "/*"), "script": ("//", "*", "/*"), "indented": ("#", "//", "(*"), "keyword": ("'", "REM "),
    "ruby": ("#",), "sql": ("--", "*", "/*"),
}
ATTRIBUTE = re.compile(r"^\s*(?:\[.*\]|@\w.*|<\w.*>)\s*$")
STYLES = {
    "cs": "braced", "java": "braced", "js": "script", "ts": "script", "mjs": "script", "jsx": "script", "tsx": "script", "c": "braced", "cpp": "braced", "go": "braced",
    "py": "indented", "fs": "indented", "vb": "keyword", "rb": "ruby", "sql": "sql",
}


def _comment_above(lines: list[str], at: int, style: str) -> str:
    """The comment that ends at most ``NEAR`` blank lines above line ``at``, marks taken off."""
    up, blank, taken = at - 1, 0, []
    while up >= 0:
        line = lines[up].strip()
        if not line:
            blank += 1
            if taken or blank > NEAR:
                break
        elif not taken and ATTRIBUTE.match(lines[up]):
            pass
        elif line.startswith(COMMENT[style]) or (style in ("braced", "script", "sql") and line.endswith("*/")):
            taken.append(re.sub(r"^(?:///?|/\*\*?|\*/|\*|#+|--+|'{1,3}|\(\*)\s?|\s*\*/$", "", line))
        else:
            break
        up -= 1
    return "\n".join(reversed(taken)).strip()


def _docstring(lines: list[str], at: int) -> str:
    """The string literal that opens an indented body, to its end."""
    while at < len(lines) and not lines[at].strip():
        at += 1
    m = re.match(r"\s*[rRuU]?(\"{3}|'{3})", lines[at]) if at < len(lines) else None
    if not m:
        return ""
    taken, rest = [], lines[at][m.end() :]
    while m[1] not in rest:
        taken.append(rest)
        at += 1
        if at == len(lines):
            return ""
        rest = lines[at]
    return "\n".join([*taken, rest.partition(m[1])[0]]).strip()


def _code(line: str, style: str) -> str:
    """A line without comments and what its strings hold."""
    strings = r'"(?:""|[^"])*"' if style == "keyword" else r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\''
    return re.sub(BARE[style], "", re.sub(strings, '""', line))


def _joined(lines: list[str], at: int, style: str, head: str) -> tuple[str, int]:
    """The signature that begins in line ``at`` with the lines up to the one that closes its
    parenthesis, and that line; the line alone if it begins none or none closes."""
    line = lines[at]
    if "(" not in line or not WRAPPED[head].match(line):
        return line, at
    code = _code(line, style)
    opens = code.count("(") - code.count(")")
    if opens <= 0:
        return line, at
    taken = [line]
    for i in range(at + 1, len(lines)):
        code = _code(lines[i], style)
        if style == "braced" and re.match(r"[^)]*[;{}]", code) or style == "indented" and WRAPPED[head].match(code):
            break
        opens += code.count("(") - code.count(")")
        taken.append(lines[i].strip())
        if opens <= 0:
            if style in ("indented", "keyword"):
                taken = [re.sub(r"\s_$", "", x.rstrip()) for x in taken]
            return " ".join(x for x in (*taken[:1], *(re.sub(r"\s*//.*$", "", x) if style in ("braced", "script") else x for x in taken[1:])) if x), i
    return line, at


def _ruby_functions(lines: list[str]) -> Iterator[tuple[int, int, str, str, str]]:
    """Ruby methods, each to the ``end`` of its ``def``."""
    stack: list[tuple[int, str, str, str] | None] = []
    past = -1
    for i, line in enumerate(lines):
        if i <= past:
            continue
        code = _code(line, "ruby").rstrip()
        whole, past = _joined(lines, i, "ruby", "ruby")
        m = RUBY.match(whole)
        if m:
            found = (i, m["name"], re.sub(r"\s+", " ", whole).strip(), _comment_above(lines, i, "ruby"))
            if re.match(r"\s*(?:\(.*\))?\s*=\s", m["rest"]) or re.search(r";\s*end\s*$", code):
                yield i + 1, past + 1, *found[1:]
            else:
                stack.append(found)
        elif re.match(r"\s*end\b", code):
            if stack and (found := stack.pop()):
                yield found[0] + 1, i + 1, *found[1:]
        elif RUBY_OPENS.search(code) and not re.search(r"\bend\s*$", code):
            stack.append(None)
    for found in reversed(stack):
        if found:
            yield found[0] + 1, len(lines), *found[1:]


def _sql_functions(lines: list[str]) -> Iterator[tuple[int, int, str, str, str]]:
    """SQL functions and procedures, to the end of their quoted body, of their block or of the
    statement."""
    past = -1
    for i in range(len(lines)):
        if i <= past:
            continue
        m = SQL_FUNCTION.match(lines[i])
        if not m:
            continue
        first = i
        if "(" not in lines[i] and i + 1 < len(lines) and lines[i + 1].lstrip().startswith("("):
            lines = [*lines[:i], "", f"{lines[i].rstrip()} {lines[i + 1].lstrip()}", *lines[i + 2 :]]
            i += 1
        signature, past = _joined(lines, i, "sql", "sql")
        depth, quote, begun = 0, "", False
        for k in range(past, len(lines)):
            code = _code(lines[k], "sql")
            if k > past and not quote and depth <= 0 and SQL_FUNCTION.match(code):
                past = k - 1
                break
            for word in re.findall(r"\$\w*\$|\b(?:BEGIN|CASE|END(?:\s+(?:IF|LOOP|WHILE|REPEAT|FOR))?)\b|;", code, re.I):
                low = word.lower()
                if low.startswith("$"):
                    quote = "" if quote == low else quote or low
                elif quote:
                    continue
                elif low in ("begin", "case"):
                    depth, begun = depth + 1, True
                elif low == "end":
                    depth -= 1
            if not quote and depth <= 0 and code.rstrip().endswith(";") or (begun and depth <= 0 and re.match(r"\s*(?:GO|/)\s*$", code, re.I)):
                past = k
                break
        else:
            past = len(lines) - 1
        yield first + 1, past + 1, m["name"], re.sub(r"\s+", " ", signature).strip(), _comment_above(lines, first, "sql")


def source_functions(text: str | None, style: str) -> Iterator[tuple[int, int, str, str, str]]:
    """``(first line, last line, name, signature, documentation)`` of each function of a file.

    ``style`` says how bodies end: ``braced`` by the brace that closes theirs, ``indented`` by a
    line that is not deeper than the signature, ``keyword`` by the matching End; ``script`` is
    braced with arrow functions, ``ruby`` and ``sql`` have rules of their own. A signature goes on
    to the line that closes its parenthesis. Lines count from 1. A null or empty text has none; an unclosed body ends with the file.
    """
    lines = re.split(r"\r\n|\r|\n", text) if text else []
    if style in ("ruby", "sql"):
        yield from (_ruby_functions if style == "ruby" else _sql_functions)(lines)
        return
    stack: list[tuple[int, str, str, str, int]] = []
    depth = 0
    past = -1
    for i, line in enumerate(lines):
        bare = line.strip()
        if style in ("braced", "script"):
            code = re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'', '""', line)
            code = re.sub(r"//.*$", "", code)
            m, arrow, last, whole = None, None, i, line
            if i > past and not bare.startswith(("//", "*", "/*", "[", "#")):
                whole, last = _joined(lines, i, "braced", "braced")
                m = (SCRIPT if style == "script" else BRACED).match(code if last == i else re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'', '""', whole))
                if style == "script" and not m and "=" in code:
                    whole, last = _joined(lines, i, "script", "arrow")
                    arrow = ARROW.match(whole)
                past = last if m or arrow else past
            if arrow:
                signature = re.sub(r"\s+", " ", whole.split("=>")[0]).strip()
                rest = whole[arrow.end() :].strip()
                follows = arrow["open"] or rest or next((x.strip()[0] for x in lines[last + 1 : last + 3] if x.strip()), "")
                if follows == "{":
                    stack.append((i, arrow["name"], signature, _comment_above(lines, i, style), depth))
                else:
                    yield i + 1, last + 1, arrow["name"], signature, _comment_above(lines, i, style)
            opened = m and m["name"] not in STATEMENTS and (m["js"] or m["type"] or m["open"] == "{" or m["open"] is None)
            if opened and (m["type"] or "").split(" ")[0] not in STATEMENTS and not re.search(r"[=.]\s*$|\s\?\s*$", m["type"] or ""):
                signature = re.sub(r"\s+", " ", whole.split("{")[0].split("=>")[0]).strip(" ;")
                follows = m["open"] or next((x.strip()[0] for x in lines[last + 1 : last + 3] if x.strip()), "")
                if follows in ("=>", ";"):
                    if m["type"]:
                        yield i + 1, last + 1, m["name"], signature, _comment_above(lines, i, style)
                elif follows == "{":
                    stack.append((i, m["name"], signature, _comment_above(lines, i, style), depth))
            for ch in code:
                if ch == "{":
                    depth += 1
                elif ch == "}":
                    depth -= 1
                    while stack and depth <= stack[-1][4]:
                        at, name, signature, doc, _ = stack.pop()
                        yield at + 1, i + 1, name, signature, doc
        elif style == "indented":
            indent = len(line) - len(line.lstrip())
            if i > past and bare and not bare.startswith(("#", "//")):
                while stack and indent <= stack[-1][4]:
                    at, name, signature, doc, _ = stack.pop()
                    yield at + 1, i, name, signature, doc
            m = INDENTED.match(line) if i > past else None
            if m:
                whole, past = _joined(lines, i, style, style)
                doc = _comment_above(lines, i, style) or _docstring(lines, past + 1)
                stack.append((i, m["name"] or m["fname"], whole.strip().rstrip(":= "), doc, indent))
        else:
            whole, last = _joined(lines, i, style, style) if i > past else (line, past)
            m = KEYWORD.match(whole) if i > past else None
            if m:
                past = last
                stack.append((i, m["name"], whole.strip(), _comment_above(lines, i, style), 0))
            elif stack and re.match(r"^\s*End\s+(?:Function|Sub|Operator)\b|^\s*end\b\s*;?\s*$", line, re.I):
                at, name, signature, doc, _ = stack.pop()
                yield at + 1, i + 1, name, signature, doc
    for at, name, signature, doc, _ in reversed(stack):
        yield at + 1, len(lines), name, signature, doc


def _read_functions(files: DataFrame, ids: list[str]) -> DataFrame:
    """:func:`source_functions` of every file: ``ids, first_line, last_line, name, signature,
    documentation``. ``files`` has the string columns ``ids``, path and content; the style goes
    by the path's extension, unknown ones count as braced. Files are read whole, one by one."""
    names = [*ids, "first_line", "last_line", "name", "signature", "documentation"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *own, path, content in batch[[*ids, "path", "content"]].itertuples(index=False, name=None):
                style = STYLES.get((path or "").rpartition(".")[2].lower(), "braced")
                rows.extend((*own, *f) for f in source_functions(content, style))
            yield pd.DataFrame(rows, columns=names)

    return (
        files.where(F.col("content").isNotNull())
        .select(*ids, "path", "content")
        .mapInPandas(
            read,
            ", ".join(f"{i} string" for i in ids)
            + ", first_line int, last_line int, name string, signature string, documentation string",
        )
    )


def pairs_from_sources(sources: DataFrame) -> DataFrame:
    """Functions of source files with telling documentation.

    ``sources`` has source_id (string), path, content. Output: ``source_id, first_line,
    last_line, name, signature, documentation``, one row per function and file; repeated rows of
    a file give their pairs once. A narrow operator, then one distinct.
    """
    found = _read_functions(sources, ["source_id"])
    return found.where(
        tells_something(F.col("documentation"), F.col("name"), F.col("signature"), F.lit(""))
    ).distinct()
