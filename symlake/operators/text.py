"""Source text: line search by regular expression, spans, definition spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlake.functions.names import glob_regex
from symlake.operators.references import excerpt
from symlake.schemas import InvalidArgument
from symlake.sources.relations import KEY

#: Matches of a search and lines of a span at most.
MAX_MATCHES, MAX_LINES = 100, 400


def search_text(
    files: DataFrame,
    pattern: str,
    limit: int = MAX_MATCHES,
    path_prefix: str | None = None,
    glob: str | None = None,
    ignore_case: bool = False,
) -> DataFrame:
    """Lines that match, in path order, the first ``limit`` of each snapshot: ``repo_id,
    commit_sha, path, line, excerpt, rank, truncated``.

    Whole contents are searched. A file is tested as a whole before it is split into lines.
    """
    if not pattern:
        raise InvalidArgument("a pattern is required")
    rows = files.where(F.col("content").isNotNull())
    if path_prefix:
        rows = rows.where(F.lower("path").startswith(path_prefix.lower()))
    if glob:
        rows = rows.where(F.col("path").rlike(glob_regex(glob)))
    flags = "(?i)" if ignore_case else ""
    hit = rows.where(F.col("content").rlike(f"(?m){flags}{pattern}"))
    lines = hit.select(*KEY, "path", F.posexplode(F.split("content", "\n")).alias("n", "text"))
    found = lines.where(F.col("text").rlike(flags + pattern))
    per = Window.partitionBy(*KEY)
    order = per.orderBy(F.lower("path"), "path", "n")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit + 1)
    text = F.trim(F.regexp_replace("text", r"[\r\t]", " "))
    return (
        ranked.withColumn("truncated", F.max("rank").over(per) > limit)
        .where(F.col("rank") <= limit)
        .select(
            *KEY,
            "path",
            (F.col("n") + 1).alias("line"),
            F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 197), F.lit("..."))).otherwise(text).alias("excerpt"),
            "rank",
            "truncated",
        )
    )


def spans(
    requests: DataFrame, files: DataFrame, context: int = 0, max_lines: int = 120, max_chars: int | None = None
) -> DataFrame:
    """Numbered source lines of requested places: ``requests`` with keys, file_id, span_start and
    span_end; adds first_line, last_line, n_lines, truncated and code.

    Lines count from 1, ``context`` more on both sides, at most ``max_lines`` (capped at 400) and
    ``max_chars`` characters of the numbered text; a cut by either sets truncated.
    """
    max_lines = min(max_lines, MAX_LINES)
    texts = files.where(F.col("content").isNotNull()).select(*KEY, "file_id", "path", "content")
    lines = F.split("content", "\n")
    total = F.size(lines)
    first = F.greatest(F.col("span_start") - context, F.lit(1))
    last = F.least(F.col("span_end") + context, total)
    count = F.least(F.greatest(last - first + 1, F.lit(0)), F.lit(max_lines))
    numbered = F.transform(
        F.slice(lines, first, count),
        lambda x, i: F.concat(F.lpad((first + i).cast("string"), 5, " "), F.lit(" | "), F.rtrim(F.regexp_replace(x, "\r", ""))),
    )
    code = F.array_join(numbered, "\n")
    long_ = F.length(code) > max_chars if max_chars is not None else F.lit(False)
    return requests.join(texts, [*KEY, "file_id"]).select(
        *(c for c in requests.columns),
        "path",
        first.alias("first_line"),
        (first + count - 1).alias("last_line"),
        total.alias("n_lines"),
        ((last - first + 1 > max_lines) | long_).alias("truncated"),
        (code if max_chars is None else F.substring(code, 1, max_chars)).alias("code"),
    )


def definitions(
    symbols: DataFrame, files: DataFrame, context: int = 2, max_lines: int = 120, max_chars: int | None = None
) -> DataFrame:
    """Definition span of every symbol whose file has content."""
    asked = symbols.select(*KEY, "symbol_id", "file_id", "span_start", "span_end").where(
        "span_start is not null and span_end >= span_start and span_start > 0"
    )
    return spans(asked, files, context, max_lines, max_chars)


def line_of(rows: DataFrame, files: DataFrame, line: str) -> DataFrame:
    """``rows`` (with keys and file_id) with the text of their ``line`` column's line."""
    texts = files.where(F.col("content").isNotNull()).select(*KEY, "file_id", "content")
    return rows.join(texts, [*KEY, "file_id"]).withColumn("excerpt", excerpt(F.col("content"), F.col(line))).drop("content")
