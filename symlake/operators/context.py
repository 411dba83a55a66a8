"""Context of symbols: card, code and callees with code; interface hints; answers as sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlake.operators import graph, text
from symlake.sources.relations import KEY

#: Lines of code of a symbol and of each of its callees, and callees at most.
CODE_LINES, CALLEE_LINES, MAX_CALLEES = 200, 50, 25
#: Callers counted per interface member at most.
CALLER_PROBE = 50
#: Lines of one part of a rendered difference, and its sections in order: kinds of facts, symbols as "".
PART_LINES, SECTIONS = 1000, ["Route", "", "Config", "DbTable", "DiRegistration"]


def contexts(
    roots: DataFrame,
    symbols: DataFrame,
    refs: DataFrame,
    files: DataFrame,
    depth: int = 1,
    limit: int = 10,
    lookup: bool = False,
) -> DataFrame:
    """Each root with its code and the code of what it calls: ``repo_id, commit_sha, root, depth,
    symbol_id, kind, signature, n_lines, truncated, code``.

    The root has depth 0 and up to 200 lines, callees up to 50; symbols without stored source
    have no code.
    """
    nodes, _ = graph.traverse(roots, refs, min(depth, 2), min(limit, MAX_CALLEES), callers=False, lookup=lookup)
    cards = symbols.select(*KEY, "symbol_id", "kind", "signature", "file_id", "span_start", "span_end")
    known = nodes.select(*KEY, "root", "symbol_id", "depth").join(cards, [*KEY, "symbol_id"], "left")
    lines = F.when(F.col("depth") == 0, CODE_LINES).otherwise(CALLEE_LINES)
    texts = files.where(F.col("content").isNotNull()).select(*KEY, "file_id", "content")
    whole = F.col("span_end") - F.col("span_start") + 1
    placed = known.join(texts, [*KEY, "file_id"], "left")
    code = F.array_join(F.slice(F.split("content", "\r?\n"), F.greatest("span_start", F.lit(1)), F.greatest(F.least(whole, lines), F.lit(0))), "\n")
    return placed.select(
        *KEY,
        "root",
        "depth",
        "symbol_id",
        F.coalesce("kind", F.lit("method")).alias("kind"),
        "signature",
        whole.alias("n_lines"),
        (whole > lines).alias("truncated"),
        F.when(F.col("content").isNotNull() & F.col("span_start").isNotNull(), code).alias("code"),
    )


def interface_callers(symbols: DataFrame, refs: DataFrame, type_relations: DataFrame) -> DataFrame:
    """Callers that reach a member only through the interfaces it implements: ``symbol_id,
    n_interfaces, n_callers``, at most 50 counted per interface member."""
    stands = graph.interface_members(symbols, type_relations)
    calls = refs.where(F.col("ref_kind").isin(graph.CALLS) & F.col("to_symbol_id").isNotNull() & F.col("from_symbol_id").isNotNull())
    per = (
        calls.groupBy(*KEY, F.col("to_symbol_id").alias("interface_member"))
        .agg(F.count_distinct("from_symbol_id").alias("n"))
        .withColumn("n", F.least("n", F.lit(CALLER_PROBE)))
    )
    return (
        stands.join(per, [*KEY, "interface_member"], "left")
        .groupBy(*KEY, "symbol_id")
        .agg(F.count("*").alias("n_interfaces"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_callers"))
    )


def interface_aliases(roots: DataFrame, symbols: DataFrame, type_relations: DataFrame) -> DataFrame:
    """Interface members to start from beside each root: ``repo_id, commit_sha, root, symbol_id``."""
    stands = graph.interface_members(symbols, type_relations)
    return roots.join(stands.withColumnRenamed("symbol_id", "root"), [*KEY, "root"]).select(
        *KEY, "root", F.col("interface_member").alias("symbol_id")
    )


def sentence(n: Column, what: str, query: Column, truncated: Column) -> Column:
    """An answer in a sentence, as a column."""
    count = F.when(n == 0, F.lit(f"No {what}s")).when(n == 1, F.lit(f"1 {what}")).otherwise(
        F.concat(n.cast("string"), F.lit(f" {what}s"))
    )
    return F.concat(count, F.lit(" for '"), query, F.lit("'"), F.when(truncated, F.lit(", more exist.")).otherwise("."))


def search_answers(hits: DataFrame) -> DataFrame:
    """One sentence per query and snapshot of search hits, naming the best hit."""
    per = hits.groupBy("query", *KEY).agg(
        F.count("*").alias("n"), F.max("truncated").alias("truncated"), F.min_by("symbol_id", "rank").alias("best")
    )
    text_ = F.concat(sentence(F.col("n"), "symbol", F.col("query"), F.col("truncated")), F.lit(" Best: "), F.col("best"))
    return per.select("query", *KEY, text_.alias("answer"))


def render_changes(changes: DataFrame, fact_changes: DataFrame | None = None) -> DataFrame:
    """Changes of symbols and facts rendered as text per pair of snapshots: ``repo_id, ord, part,
    n_changes, body``, all lines.

    Endpoints come first, then symbols by kind of change and id, then configuration, tables and
    registrations. A body holds ``PART_LINES`` lines; what is longer goes on in the next part.
    """
    symbol = F.concat(
        F.lit("- "),
        F.col("change_kind"),
        F.lit(": "),
        F.coalesce(F.concat("from_id", F.when(F.col("to_id") != F.col("from_id"), F.concat(F.lit(" -> "), F.col("to_id"))).otherwise("")), "to_id"),
    )
    shown = changes.select("repo_id", "ord", F.lit(SECTIONS.index("")).alias("section"), symbol.alias("line"))
    if fact_changes is not None:
        value = F.coalesce("to_value", "from_value")
        bare = F.when(F.col("fact_kind").isin("Config", "DbTable"), F.substring_index(value, "|", 1)).otherwise(value)
        fact = F.concat(F.lit("- "), F.col("change_kind"), F.lit(" "), F.col("fact_kind"), F.lit(": "), bare)
        section = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("fact_kind")).cast("int") - 1
        told = fact_changes.where(F.col("fact_kind").isin([s for s in SECTIONS if s]))
        shown = shown.unionByName(told.select("repo_id", "ord", section.alias("section"), fact.alias("line")))
    ranked = shown.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id", "ord").orderBy("section", "line")))
    total = shown.groupBy("repo_id", "ord").agg(F.count("*").alias("n_changes"))
    part = (F.floor((F.col("rank") - 1) / PART_LINES) + 1).cast("int").alias("part")
    body = ranked.groupBy("repo_id", "ord", part).agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("all"))
    return body.join(total, ["repo_id", "ord"]).select(
        "repo_id", "ord", "part", "n_changes", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("body")
    )


def symbols_by_file(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Outline of every file: ``path, n_symbols, outline`` with symbols in order of place."""
    rows = symbols.join(files.select(*KEY, "file_id", "path"), [*KEY, "file_id"])
    return rows.groupBy(*KEY, "path").agg(
        F.count("*").alias("n_symbols"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("span_start", "symbol_id"))), lambda x: x["symbol_id"]), "\n"
        ).alias("outline"),
    )


def with_virtual_files(files: DataFrame, virtual: DataFrame) -> DataFrame:
    """Files with unsaved contents of ``virtual(path, content)`` in place of the stored ones.

    Of a path given twice the greatest content holds. New paths are not added.
    """
    new = virtual.groupBy("path").agg(F.max("content").alias("unsaved"))
    return files.join(new, "path", "left").withColumn("content", F.coalesce("unsaved", "content")).select(files.columns)


def code_of(symbols: DataFrame, files: DataFrame, max_lines: int = 100) -> DataFrame:
    """Definition code of symbols without context lines, numbered."""
    return text.definitions(symbols, files, context=0, max_lines=max_lines)
