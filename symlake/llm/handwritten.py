"""Generated, minified, vendored and decompiled files, and data saved as code.

A file is told by its layout, with thresholds per language on maximum and mean line length,
share of white space and alphanumerics, density of numeric literals and long encoded runs; and,
as a generated or vendored file may look like any other, by its path, its virtual flag, the
project it names, and marks above its first declaration. Mentions of such things in names or
comments do not count: marks must have the form that tools write. All conditions are JVM
expressions over the whole content; nothing is shuffled but the flagged ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Paths that tools write to, with forward slashes and in any case.
GENERATED_PATH = (
    r"(?i)\.(?:g|g\.i|generated|designer|pb|grpc)\.(?:cs|vb|fs)$|(?:^|/)(?:obj|generated)/"
    r"|(?:^|/)connected services/.*/reference\.(?:cs|vb)$|_pb2(?:_grpc)?\.py$"
)
VENDORED_PATH = (
    r"(?i)^(?:vendor|third_party|thirdparty|packages|external)/"
    r"|(?:^|/)(?:node_modules|bower_components|thirdparty|third_party|site-packages)/|(?:^|/)wwwroot/lib/"
)
MINIFIED_PATH = r"(?i)\.min\.(?:js|css|mjs)$|\.bundle\.(?:js|css)$|(?:^|/)dist/[^/]*\.[0-9a-f]{6,}\.(?:js|css)$"
DECOMPILED_PATH = r"(?i)^decompiled/"

#: Marks of generators, alone on a comment line above the first declaration.
GENERATED_MARK = (
    r"(?im)^[ \t]*(?:(?://+|'|/\*+|\*|#|--|<!--|rem )[ \t]*)?(?:</?auto-?generated[ \t]*/?>[ \t]*(?:\*/|-->)?[ \t]*\r?$"
    r"|@generated\b|(?:this )?(?:code|file) (?:was|is) (?:auto(?:matically)?[- ])?generated by\b|code emitted by\b"
    r"|do not modify\b.*\boutput of\b|do not edit\b.*\bgenerated\b|machine-written by\b|source: .*\(template output\)"
    r"|automatisch erzeugt|(?:fichier )?(?:produit|g[eé]n[eé]r[eé]) automatiquement|auto-?generated (?:by|from)\b"
    r"|generado autom[aá]ticamente)"
)
#: Marks of copies from elsewhere above the first declaration.
VENDORED_MARK = (
    r"(?im)permission to use, copy|third[- ]party component\b.*:|report bugs upstream|upstream copy, "
    r"|taken unchanged from\b|\(c\) the \w+ contributors"
)

#: How the first declaration of a file begins; marks count above it only.
DECLARATION = (
    r"(?:(?:public|internal|private|protected|friend|static|sealed|abstract|partial|export|default|async|readonly|notinheritable)\s+)*"
    r"(?:class|struct|structure|interface|enum|record|delegate|function|def|const|let|var|type)\b"
)


@dataclass(frozen=True)
class Limits:
    """Layout of text that no hand writes. Minified: a line of at least ``max_line`` that holds
    half of the characters, or lines of ``mean_line`` on average beside it, with at most ``space``
    white space and at least ``alnum`` letters and digits. Data: at least ``chars`` characters
    with ``numeric`` of the tokens numbers or ``encoded`` of the characters in encoded runs."""

    max_line: int
    mean_line: int
    space: float
    alnum: float
    numeric: float
    encoded: float
    chars: int = 400


#: Per language, set between what hands and tools write in it: scripts and style sheets by hand
#: keep lines below 110 and 25 characters and 15 and 20 % white space, packed ones are single
#: lines above 1,500 with below 3 %; C# by hand has lines up to 250 and 13 % at least.
LIMITS = {
    "js": Limits(500, 200, 0.10, 0.50, 0.5, 0.4),
    "mjs": Limits(500, 200, 0.10, 0.50, 0.5, 0.4),
    "ts": Limits(500, 200, 0.10, 0.50, 0.5, 0.4),
    "css": Limits(300, 120, 0.10, 0.60, 0.5, 0.4),
    "cs": Limits(1_000, 400, 0.08, 0.45, 0.6, 0.4),
}
OTHER = Limits(1_000, 400, 0.08, 0.45, 0.6, 0.4)
#: Share of a file's characters in its longest line with which that line is the file.
ONE_LINE = 0.5
ENCODED_RUN = r"[A-Za-z0-9+/=_-]{40,}"


def clean_path(path: Column) -> Column:
    """Forward slashes, no leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(?:\./)+", "")


def layout(content: Column) -> dict[str, Column]:
    """Layout statistics of a content; null for null, zero for empty."""
    zero = F.struct(F.lit(0).alias("longest"), F.lit(0).alias("sum"), F.lit(0).alias("n"))
    lines = F.aggregate(
        F.split(content, r"\r\n|\r|\n"),
        zero,
        lambda a, x: F.struct(
            F.greatest(a["longest"], F.length(x)).alias("longest"),
            (a["sum"] + F.length(x)).alias("sum"),
            (a["n"] + (F.trim(x) != "").cast("int")).alias("n"),
        ),
    )
    chars = F.length(content)
    part = lambda rest: 1 - F.length(F.regexp_replace(content, rest, "")) / F.greatest(chars, F.lit(1))
    numbers = F.regexp_count(content, F.lit(r"(?<![\w.])(?:0[xX][0-9A-Fa-f]+|\d+(?:\.\d+)?)[uUlLfFdDmM]*(?!\w)"))
    tokens = F.regexp_count(content, F.lit(r"0[xX][0-9A-Fa-f]+|\d+(?:\.\d+)?|[A-Za-z_]\w*"))
    return {
        "chars": chars,
        "lines": lines,
        "space": part(r"\s+"),
        "alnum": part(r"[A-Za-z0-9]+"),
        "numeric": numbers / F.greatest(tokens, F.lit(1)),
        "encoded": part(ENCODED_RUN),
    }


def by_layout(path: Column, content: Column) -> Column:
    """``minified`` or ``data`` by the layout of a content alone, else null; null for null."""
    name = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    stats = layout(content)

    def at(limit: str) -> Column:
        out = F.lit(getattr(OTHER, limit))
        for language, limits in LIMITS.items():
            out = F.when(name == language, getattr(limits, limit)).otherwise(out)
        return out

    longest, total, n = (stats["lines"][f] for f in ("longest", "sum", "n"))
    packed = (
        (longest >= at("max_line"))
        & ((longest >= ONE_LINE * total) | (total >= at("mean_line") * F.greatest(n, F.lit(1))))
        & (stats["space"] <= at("space"))
        & (stats["alnum"] >= at("alnum"))
    )
    data = (stats["chars"] >= at("chars")) & ((stats["numeric"] >= at("numeric")) | (stats["encoded"] >= at("encoded")))
    return F.when(data, "data").when(packed, "minified")


def above_declarations(content: Column) -> Column:
    """The content up to its first declaration; all of it where there is none."""
    head = F.regexp_extract(content, rf"(?is)\A(.*?(?:^|[\r\n]))[ \t]*{DECLARATION}", 1)
    return F.when(content.rlike(rf"(?im)^[ \t]*{DECLARATION}"), head).otherwise(content)


def verdicts(files: DataFrame) -> DataFrame:
    """``files`` with ``verdict``: why a row is not hand-written, or null if it is; and
    ``layout_verdict``, what its layout alone says.

    Verdicts: decompiled, generated, vendored, minified, data. ``files`` has path, is_virtual,
    project_name and content; nulls in any of them, empty and very long contents are fine: a
    missing content leaves path, flag and project to judge by. Columns of those names are
    replaced.
    """
    path = clean_path(F.coalesce("path", F.lit("")))
    head = above_declarations(F.col("content"))
    folder = F.lower(F.split_part(path, F.lit("/"), F.lit(2)))
    foreign = (
        path.rlike(VENDORED_PATH)
        | (
            path.rlike(r"(?i)^(?:src|tests)/")
            & (F.col("project_name") != "")
            & ~folder.startswith(F.lower(F.trim("project_name")))
        )
    )
    told = by_layout(path, F.col("content"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return files.withColumn(
        "verdict",
        F.when(yes((F.col("is_virtual") == 1) | path.rlike(DECOMPILED_PATH)), "decompiled")
        .when(yes(path.rlike(GENERATED_PATH)), "generated")
        .when(yes(foreign), "vendored")
        .when(yes(path.rlike(MINIFIED_PATH)), "minified")
        .when(F.col("content").isNull(), None)
        .when(yes(head.rlike(GENERATED_MARK)), "generated")
        .when(yes(head.rlike(VENDORED_MARK)), "vendored")
        .otherwise(told),
    ).withColumn("layout_verdict", told)


def not_handwritten(files: DataFrame) -> DataFrame:
    """``file_id`` of the files with a verdict in any of their rows, each once."""
    judged = verdicts(files.where("file_id is not null")).groupBy("file_id")
    return judged.agg(F.max(F.col("verdict").isNotNull()).alias("told")).where("told").select("file_id")
