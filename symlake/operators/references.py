"""References to and from symbols, with the source line, in stable order and with limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlake.sources.relations import KEY


def excerpt(content: Column, line: Column) -> Column:
    """A line of a content, trimmed, cut to 197 characters and dots beyond 200."""
    text = F.trim(F.regexp_replace(F.try_element_at(F.split(content, "\n"), line), r"[\r\t]", " "))
    return F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 197), F.lit("..."))).otherwise(text)


def find(
    refs: DataFrame,
    files: DataFrame,
    limit: int = 50,
    kind: str | None = None,
    state: str | None = None,
    outgoing: bool = False,
) -> DataFrame:
    """References of every symbol of every snapshot, the first ``limit`` by path and place.

    Output: ``repo_id, commit_sha, symbol_id, edge_seq, other_id, ref_kind, path, loc_start,
    rank, truncated``. The limit of hub symbols is applied map-side before the shuffle.
    """
    mine, other = ("from_symbol_id", "to_symbol_id") if outgoing else ("to_symbol_id", "from_symbol_id")
    rows = refs.where(F.col(mine).isNotNull())
    if kind:
        rows = rows.where(F.col("ref_kind") == kind)
    if state:
        rows = rows.where(F.col("resolution_state") == state.lower())
    rows = rows.join(files.select(*KEY, "file_id", "path"), [*KEY, "file_id"])
    per = Window.partitionBy(*KEY, mine)
    order = per.orderBy("path", "loc_start", "edge_seq")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit + 1)
    return (
        ranked.withColumn("truncated", F.max("rank").over(per) > limit)
        .where(F.col("rank") <= limit)
        .select(
            *KEY,
            F.col(mine).alias("symbol_id"),
            "edge_seq",
            F.col(other).alias("other_id"),
            "ref_kind",
            "path",
            "loc_start",
            "rank",
            "truncated",
        )
    )


def with_excerpt(found: DataFrame, files: DataFrame) -> DataFrame:
    """References of :func:`find` with their source line, null where the file has no stored content."""
    texts = files.where(F.col("content").isNotNull()).select(*KEY, "path", "content")
    return (
        found.join(texts, [*KEY, "path"], "left")
        .withColumn("excerpt", excerpt(F.col("content"), F.col("loc_start")))
        .drop("content")
    )


def counts(refs: DataFrame) -> DataFrame:
    """References per snapshot, kind and state: ``n_refs, n_sources, n_targets``."""
    return refs.groupBy(*KEY, "ref_kind", "resolution_state").agg(
        F.count("*").alias("n_refs"),
        F.count_distinct("from_symbol_id").alias("n_sources"),
        F.count_distinct("to_symbol_id").alias("n_targets"),
    )


def unresolved_in_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Unresolved references with the path of their file: what a resolver has to work on."""
    return (
        refs.where("resolution_state = 'unresolved'")
        .join(files.select(*KEY, "file_id", "path"), [*KEY, "file_id"])
        .select(*KEY, "edge_seq", "from_symbol_id", "to_name", "to_container_hint", "path", "loc_start")
    )


def resolve(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Targets for unresolved references: ``edge_seq, to_symbol_id``.

    The symbol of the same snapshot whose simple name equals ``to_name``, if there is one
    alone; else the only one of them in the type that ``to_container_hint`` names.
    Candidates are counted by aggregation, never listed per edge.
    """
    name = F.regexp_extract(F.regexp_replace("symbol_id", r"\(.*$", ""), r"([^.:`]+)(?:`+\d+)?$", 1)
    named = symbols.select(
        *KEY,
        name.alias("to_name"),
        F.regexp_extract("containing_type", r"([^.<]+)(?:<.*>)?$", 1).alias("owner"),
        "symbol_id",
    )
    one = lambda d, by: (
        d.groupBy(*KEY, *by)
        .agg(F.count("*").alias("n"), F.min("symbol_id").alias("target"))
        .where("n = 1")
        .drop("n")
    )
    by_name = one(named, ["to_name"]).withColumnRenamed("target", "by_name")
    by_owner = one(named.where("owner <> ''"), ["to_name", "owner"]).withColumnRenamed("target", "by_owner")
    open_ = refs.where("resolution_state = 'unresolved' and to_name is not null").select(
        *KEY, "edge_seq", "to_name", F.regexp_extract("to_container_hint", r"([^.<]+)(?:<.*>)?$", 1).alias("owner")
    )
    return (
        open_.join(by_name, [*KEY, "to_name"], "left")
        .join(by_owner, [*KEY, "to_name", "owner"], "left")
        .select("edge_seq", F.coalesce("by_name", "by_owner").alias("to_symbol_id"))
        .where("to_symbol_id is not null")
    )


def upgraded(refs: DataFrame, found: DataFrame) -> DataFrame:
    """``refs`` with the targets of :func:`resolve` filled in and marked resolved."""
    new = found.select("edge_seq", F.col("to_symbol_id").alias("new_target"))
    return (
        refs.join(new, "edge_seq", "left")
        .withColumn("to_symbol_id", F.coalesce("new_target", "to_symbol_id"))
        .withColumn(
            "resolution_state", F.when(F.col("new_target").isNotNull(), "resolved").otherwise(F.col("resolution_state"))
        )
        .drop("new_target")
    )
