"""Names in an index: documentation-comment ids, compound words, paths. JVM expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: borders inside a compound word, aB, ABc, a1 and 1a.
CAMEL = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-zA-Z])(?=[0-9])|(?<=[0-9])(?=[a-zA-Z])"


def doc_name(symbol_id: Column) -> Column:
    """A documentation-comment id without kind letter, parameters and generic arity."""
    bare = F.regexp_replace(symbol_id, r"^[A-Z]:", "")
    bare = F.regexp_replace(bare, r"\(.*$", "")
    return F.regexp_replace(bare, r"`+\d+", "")


def display_name(symbol_id: Column) -> Column:
    """The last dotted part of :func:`doc_name`; constructors show their type's name."""
    name = doc_name(symbol_id)
    last = F.substring_index(name, ".", -1)
    owner = F.substring_index(F.substring_index(name, ".", -2), ".", 1)
    return F.when(last.isin("#ctor", "#cctor"), owner).otherwise(last)


def short_name(fqname: Column, parts: int = 2) -> Column:
    """The last dotted parts of a name without parameters."""
    return F.substring_index(F.regexp_replace(fqname, r"\(.*$", ""), ".", -parts)


def parent_name(fqname: Column) -> Column:
    """The name up to its last dot; null at the top."""
    bare = F.regexp_replace(fqname, r"[(<].*$", "")
    return F.when(bare.contains("."), F.regexp_replace(bare, r"\.[^.]*$", ""))


#: Fixed value: what separates the words of a text.
NO_WORD = r"[^a-zA-Z0-9]+"


def words(text: Column) -> Column:
    """Lower-case parts of the words of a text, whole and split at compound borders, of two
    letters at least, each once."""
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), NO_WORD), lambda w: F.length(w) > 1)
    parts = F.flatten(F.transform(raw, lambda w: F.split(w, CAMEL)))
    both = F.transform(F.concat(raw, parts), F.lower)
    return F.array_distinct(F.filter(both, lambda w: F.length(w) > 1))


def index_tokens(symbol_id: Column, namespace: Column, signature: Column, documentation: Column) -> Column:
    """All search tokens of a symbol, each once: the tokens of its name, its full name, the parts
    of its namespace, and the words of its signature and documentation."""
    spaces = F.filter(F.split(F.lower(F.coalesce(namespace, F.lit(""))), r"\."), lambda w: F.length(w) > 1)
    full = F.array(F.lower(doc_name(symbol_id)))
    return F.array_distinct(F.concat(name_tokens(symbol_id), full, spaces, words(F.concat_ws(" ", signature, documentation))))


def name_tokens(symbol_id: Column) -> Column:
    """Tokens of the display name alone: whole and in parts."""
    display = display_name(symbol_id)
    return F.array_distinct(
        F.concat(F.array(F.lower(display)), F.filter(F.transform(F.split(display, CAMEL), F.lower), lambda w: F.length(w) > 1))
    )


def sanitize_query(text: str) -> str:
    """A search text without a leading ``^`` and, if quotes are odd, without quotes; may be ''."""
    out = (text or "").strip().lstrip("^")
    if out.count('"') % 2:
        out = out.replace('"', "")
    return out.strip()


def query_tokens(text: str) -> list[str]:
    """Tokens of a search text: lower case, split at separators and letter-digit borders."""
    out: list[str] = []
    for part in re.split(r"[._\-/\\ \t\"]+", text.strip().rstrip("*").lower()):
        if part:
            for token in [part, *re.split(r"(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", part)]:
                if token and token not in out and (token == part or len(token) > 1):
                    out.append(token)
    return out


#: File name endings and their language.
LANGUAGES = {"cs": "csharp", "vb": "vb", "fs": "fsharp", "fsx": "fsharp", "razor": "razor", "cshtml": "razor"}


def language_of(path: Column) -> Column:
    """Language by the path's ending; null for others."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    out = F.lit(None).cast("string")
    for end, name in LANGUAGES.items():
        out = F.when(ending == end, name).otherwise(out)
    return out


def display_fqname(symbol_id: Column, language: Column) -> Column:
    """A documentation-comment id as a full name from the global namespace, in the spelling of the
    file's language."""
    body = F.regexp_replace(symbol_id, r"^[A-Z]:", "")
    return F.when(symbol_id == "", "").otherwise(F.concat(F.when(language == "vb", "Global.").otherwise("global::"), body))


def is_test_path(path: Column) -> Column:
    """Whether a path lies in a test, benchmark or test utility project."""
    return path.rlike(r"\.(?:Tests|Benchmarks|TestUtilities)/")


def glob_regex(glob: str) -> str:
    """A regular expression for a file glob: ``**`` any depth, ``*`` one level, ``?`` one sign."""
    out = ""
    i = 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"(?i)^{out}$"
