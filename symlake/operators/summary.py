"""Summaries and exports of a codebase: sections with limits, statistics, a token budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlake.functions import facts as parse
from symlake.functions.names import is_test_path, short_name
from symlake.schemas import SEMANTIC_LEVELS
from symlake.sources.relations import KEY

#: Title and order of the sections of a summary, by kind of fact.
SECTIONS = {
    "Route": "Endpoints", "DbTable": "Data", "Config": "Configuration", "DiRegistration": "Services",
    "Middleware": "Pipeline", "RetryPolicy": "Resilience", "Exception": "Errors", "Log": "Logging",
}
#: Name endings of services.
SERVICE_ENDINGS = ["Service", "Controller", "Handler", "Repository", "Manager", "Processor"]
#: Names of types that a compiler makes for top-level statements.
COMPILER_GENERATED = ["AutoGeneratedProgram", "<Program>$"]
#: Characters that count as one token.
TOKEN_CHARS = 4


def statistics(symbols: DataFrame, refs: DataFrame, facts: DataFrame, files: DataFrame) -> DataFrame:
    """Sizes of each snapshot: ``n_symbols, n_types, n_files, n_projects, n_refs, n_unresolved,
    n_facts``; snapshots that have any row."""
    types = F.count_if(F.col("kind").isin("class", "struct", "interface", "record", "enum", "delegate"))
    parts = [
        symbols.groupBy(*KEY).agg(F.count("*").alias("n_symbols"), types.alias("n_types")),
        files.groupBy(*KEY).agg(F.count("*").alias("n_files"), F.count_distinct("project_name").alias("n_projects")),
        refs.groupBy(*KEY).agg(
            F.count("*").alias("n_refs"), F.count_if(F.col("resolution_state") == "unresolved").alias("n_unresolved")
        ),
        facts.groupBy(*KEY).agg(F.count("*").alias("n_facts")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, KEY, "full")
    names = [c for c in out.columns if c not in KEY]
    return out.select(*KEY, *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def semantic_levels(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Level of each snapshot from its projects: ``Full`` if every project has resolved
    references, ``SyntaxOnly`` if none has, else ``Partial``."""
    state = (
        refs.join(files.select(*KEY, "file_id", "project_name"), [*KEY, "file_id"])
        .where("project_name is not null")
        .groupBy(*KEY, "project_name")
        .agg(F.max(F.col("resolution_state") == "resolved").alias("compiled"))
    )
    n, c = F.count("*"), F.count_if("compiled")
    return state.groupBy(*KEY).agg(
        n.alias("n_projects"),
        c.alias("n_compiled"),
        F.when(c == n, "Full").when(c == 0, "SyntaxOnly").otherwise("Partial").alias("semantic_level"),
    )


def worst_level(*levels: Column) -> Column:
    """The worst of some semantic levels; nulls do not count."""
    known = F.array(*(F.lit(x) for x in SEMANTIC_LEVELS))
    places = [F.when(F.array_position(known, x) > 0, F.array_position(known, x)) for x in levels]
    worst = F.greatest(*places) if len(places) > 1 else places[0]
    return F.try_element_at(known, worst.cast("int"))


def data_tables(facts: DataFrame) -> DataFrame:
    """Tables of the data section of each snapshot, names in any case once: ``table_name, value``, the
    first by value."""
    name = F.trim(F.substring_index("value", "|", 1))
    rows = facts.where("fact_kind = 'DbTable'").withColumn("name", name)
    return rows.groupBy(*KEY, F.lower("name").alias("key")).agg(
        F.min_by("name", F.struct("value", "fact_seq")).alias("table_name"), F.min("value").alias("value")
    ).drop("key")


def public_types(symbols: DataFrame, files: DataFrame, members: bool = True) -> DataFrame:
    """The written surface of each snapshot: public types outside test projects, and with
    ``members`` their public methods and properties: ``repo_id, commit_sha, type_name, symbol_id,
    kind, signature``; rows of a type itself have its own id. Types made by a compiler are left
    out."""
    own = files.where(~is_test_path(F.col("path"))).select(*KEY, "file_id")
    open_ = symbols.where(F.col("visibility") == "public").join(own, [*KEY, "file_id"], "left_semi")
    types = open_.where(
        F.col("kind").isin("class", "struct", "interface", "record", "enum", "delegate") & ~compiler_generated(F.col("fqname"))
    ).select(*KEY, F.col("fqname").alias("type_name"), "symbol_id", "kind", "signature")
    if not members:
        return types
    below = open_.where(F.col("kind").isin("method", "property")).select(
        *KEY, F.col("containing_type").alias("type_name"), "symbol_id", "kind", "signature"
    )
    return types.unionByName(below.join(types.select(*KEY, "type_name").distinct(), [*KEY, "type_name"], "left_semi"))


def sections(facts: DataFrame, limit: int = 50) -> DataFrame:
    """Items of each section of each snapshot by value, the first ``limit``: ``section, rank, item,
    symbol_name, n_items`` with n_items counting all."""
    title = F.create_map(*(x for k, v in SECTIONS.items() for x in (F.lit(k), F.lit(v))))
    rows = facts.where(F.col("fact_kind").isin(list(SECTIONS))).select(
        *KEY,
        F.element_at(title, F.col("fact_kind")).alias("section"),
        "value",
        "fact_seq",
        F.when(F.col("fact_kind") == "Route", F.col("value")).otherwise(parse.before_pipe(F.col("value"))).alias("item"),
        short_name(F.substring("symbol_id", 3, 1_000_000)).alias("symbol_name"),
    )
    totals = rows.groupBy(*KEY, "section").agg(F.count("*").alias("n_items"))
    order = Window.partitionBy(*KEY, "section").orderBy("value", "fact_seq")
    kept = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return kept.join(totals, [*KEY, "section"]).select(*KEY, "section", "rank", "item", "symbol_name", "n_items")


def error_and_log_counts(facts: DataFrame) -> DataFrame:
    """Distinct exception types and log templates of each snapshot."""
    left = parse.before_pipe(F.col("value"))
    return facts.where("fact_kind in ('Exception', 'Log')").groupBy(*KEY).agg(
        F.count_distinct(F.when(F.col("fact_kind") == "Exception", left)).alias("n_exception_types"),
        F.count_distinct(F.when(F.col("fact_kind") == "Log", left)).alias("n_log_templates"),
    )


def compiler_generated(fqname: Column) -> Column:
    """Whether a type was made by a compiler and is no part of the written surface."""
    return reduce(lambda a, b: a | b, [F.coalesce(fqname.endswith(e), F.lit(False)) for e in COMPILER_GENERATED])


def services(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Public service types outside test projects with their members: ``symbol_id, fqname, n_members,
    members``, member names joined in order."""
    own = files.where(~is_test_path(F.col("path"))).select(*KEY, "file_id")
    types = symbols.where(
        F.col("kind").isin("class", "interface", "record")
        & (F.col("visibility") == "public")
        & F.regexp_replace("fqname", "<.*$", "").rlike(f"(?i)(?:{'|'.join(SERVICE_ENDINGS)})$")
        & ~compiler_generated(F.col("fqname"))
    ).join(own, [*KEY, "file_id"], "left_semi")
    members = (
        symbols.where(F.col("containing_type").isNotNull() & F.col("kind").isin("method", "property"))
        .groupBy(*KEY, F.col("containing_type").alias("fqname"))
        .agg(
            F.count("*").alias("n_members"),
            F.array_join(F.array_sort(F.collect_set(F.regexp_extract("fqname", r"([^.]*)$", 1))), ", ").alias("members"),
        )
    )
    return types.select(*KEY, "symbol_id", "fqname").join(members, [*KEY, "fqname"], "left").select(
        *KEY, "symbol_id", "fqname", F.coalesce("n_members", F.lit(0)).alias("n_members"), F.coalesce("members", F.lit("")).alias("members")
    )


def tokens_of(text: Column) -> Column:
    """Tokens a text counts as."""
    return F.floor(F.length(text) / TOKEN_CHARS).cast("long")


def export(facts: DataFrame, max_tokens: int = 4_000, limit: int = 50, titles: list[str] | None = None) -> DataFrame:
    """Sections rendered as text within a token budget per snapshot: ``section, position, tokens,
    running_tokens, fits, body``.

    Sections come in the order of :data:`SECTIONS`; one fits while the running sum stays in
    the budget, the first that does not is cut at its last line, later ones are left out. Only
    ``titles`` if given.
    """
    items = sections(facts, limit)
    if titles:
        items = items.where(F.col("section").isin(titles))
    place = F.array_position(F.array(*(F.lit(t) for t in SECTIONS.values())), F.col("section")).cast("int")
    body = (
        items.groupBy(*KEY, "section")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "item", "symbol_name"))).alias("rows"))
        .withColumn("position", place)
        .withColumn(
            "body",
            F.concat(
                F.lit("## "),
                F.col("section"),
                F.lit("\n"),
                F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), r["item"], F.lit(" - "), r["symbol_name"])), "\n"),
            ),
        )
        .withColumn("tokens", tokens_of(F.col("body")))
    )
    run = Window.partitionBy(*KEY).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    total = body.withColumn("running_tokens", F.sum("tokens").over(run))
    left = (F.lit(max_tokens) - (F.col("running_tokens") - F.col("tokens"))) * TOKEN_CHARS
    cut = F.regexp_replace(F.substring("body", F.lit(1), left.cast("int")), r"\n[^\n]*$", "\n...")
    return (
        total.where(F.col("running_tokens") - F.col("tokens") < max_tokens)
        .withColumn("fits", F.col("running_tokens") <= max_tokens)
        .withColumn("body", F.when(F.col("fits"), F.col("body")).otherwise(cut))
        .select(*KEY, "section", "position", "tokens", "running_tokens", "fits", "body")
    )


def cards(symbols: DataFrame, facts: DataFrame, files: DataFrame) -> DataFrame:
    """Symbol cards: every symbol with its path, documentation and facts in order."""
    notes = facts.groupBy(*KEY, "symbol_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.concat("fact_kind", F.lit("="), "value"))), "; ").alias("facts"),
        F.count("*").alias("n_facts"),
    )
    place = files.select(*KEY, "file_id", "path")
    return (
        symbols.join(place, [*KEY, "file_id"], "left")
        .join(notes, [*KEY, "symbol_id"], "left")
        .select(
            *KEY,
            "symbol_id",
            "kind",
            "signature",
            "visibility",
            F.when(F.col("path").isNull(), "Low").otherwise(F.col("confidence")).alias("confidence"),
            "path",
            "span_start",
            F.coalesce("n_facts", F.lit(0)).alias("n_facts"),
            "facts",
        )
    )
