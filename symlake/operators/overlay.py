"""Workspaces: a delta over a baseline, and the rules by which the two are read as one.

A delta has upserted files with all rows of these files, and tombstones. Merging is two
anti-joins and a union; it never rewrites the baseline.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlake.sources.relations import KEY


@dataclass(frozen=True)
class Overlay:
    """Rows of a workspace's changed files and what it deletes, keyed like the baseline."""

    files: DataFrame
    symbols: DataFrame
    refs: DataFrame
    facts: DataFrame
    type_relations: DataFrame
    deleted: DataFrame


def deleted_symbols(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """Ids that a refresh deletes: symbols of the changed files before, without those after."""
    old = before.join(changed.select(*KEY, "file_id").distinct(), [*KEY, "file_id"], "left_semi")
    return old.select(*KEY, "symbol_id").join(after.select(*KEY, "symbol_id"), [*KEY, "symbol_id"], "left_anti")


def merged_symbols(base: DataFrame, over: Overlay) -> DataFrame:
    """Overlay symbols, then baseline symbols that are neither deleted nor in a changed file;
    an id on both sides is the overlay's. ``side`` tells where a row comes from."""
    kept = (
        base.join(over.deleted.select(*KEY, "symbol_id"), [*KEY, "symbol_id"], "left_anti")
        .join(over.files.select(*KEY, "file_id"), [*KEY, "file_id"], "left_anti")
        .join(over.symbols.select(*KEY, "symbol_id"), [*KEY, "symbol_id"], "left_anti")
    )
    return over.symbols.withColumn("side", F.lit("overlay")).unionByName(kept.withColumn("side", F.lit("baseline")))


def merged_refs(base: DataFrame, over: Overlay) -> DataFrame:
    """Overlay references, then baseline references outside changed files whose target lives."""
    kept = base.join(over.files.select(*KEY, "file_id"), [*KEY, "file_id"], "left_anti")
    gone = over.deleted.select(*KEY, F.col("symbol_id").alias("to_symbol_id"))
    kept = kept.join(gone, [*KEY, "to_symbol_id"], "left_anti")
    return over.refs.withColumn("side", F.lit("overlay")).unionByName(kept.withColumn("side", F.lit("baseline")))


def merged_facts(base: DataFrame, over: Overlay) -> DataFrame:
    """Overlay facts, then baseline facts outside changed files."""
    kept = base.join(over.files.select(*KEY, "file_id"), [*KEY, "file_id"], "left_anti")
    return over.facts.withColumn("side", F.lit("overlay")).unionByName(kept.withColumn("side", F.lit("baseline")))


def merged_type_relations(base: DataFrame, over: Overlay) -> DataFrame:
    """Relations of types in changed files from the overlay, of the others from the baseline,
    without relations of deleted types."""
    mine = over.symbols.select(*KEY, F.col("symbol_id").alias("type_symbol_id"))
    gone = over.deleted.select(*KEY, F.col("symbol_id").alias("type_symbol_id"))
    kept = base.join(mine.union(gone).distinct(), [*KEY, "type_symbol_id"], "left_anti")
    return over.type_relations.withColumn("side", F.lit("overlay")).unionByName(
        kept.withColumn("side", F.lit("baseline"))
    )


def merged_callees(base: DataFrame, over: Overlay) -> DataFrame:
    """References to follow downwards in a workspace: its own, and those of the baseline only in
    snapshots of which it changes no file at all, whose targets live. The cautious rule: what a
    changed file calls now is not known from what it called before."""
    touched = over.files.select(*KEY).distinct()
    gone = over.deleted.select(*KEY, F.col("symbol_id").alias("to_symbol_id"))
    own = over.refs.withColumn("side", F.lit("overlay"))
    kept = base.join(touched, KEY, "left_anti").withColumn("side", F.lit("baseline"))
    return own.unionByName(kept).join(gone, [*KEY, "to_symbol_id"], "left_anti").select(own.columns)


def merged_card_facts(base: DataFrame, over: Overlay) -> DataFrame:
    """Facts shown on cards: of a symbol with facts in the overlay those alone, else the baseline's."""
    mine = over.facts.select(*KEY, "symbol_id").distinct()
    kept = base.join(mine, [*KEY, "symbol_id"], "left_anti")
    return over.facts.withColumn("side", F.lit("overlay")).unionByName(kept.withColumn("side", F.lit("baseline")))


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of files between two states keyed alike: ``file_id, change_kind`` of Added,
    Deleted, Renamed (another path, whatever the content) and Modified (the same path with other
    content)."""
    side = lambda df, p: df.select(
        *KEY, "file_id", F.lit(True).alias(p), F.col("path").alias(f"{p}_path"), F.col("sha256").alias(f"{p}_sha256")
    )
    moved = ~F.col("a_path").eqNullSafe(F.col("b_path"))
    written = ~F.col("a_sha256").eqNullSafe(F.col("b_sha256"))
    kind = (
        F.when(F.col("a").isNull(), "Added")
        .when(F.col("b").isNull(), "Deleted")
        .when(moved, "Renamed")
        .when(written, "Modified")
    )
    return (
        side(before, "a")
        .join(side(after, "b"), [*KEY, "file_id"], "full")
        .withColumn("change_kind", kind)
        .where("change_kind is not null")
        .select(*KEY, "file_id", "change_kind")
    )


def latest_state(log: DataFrame) -> DataFrame:
    """Live rows of an append log of upserts and deletes by revision: the last operation of a key
    wins, so a symbol added again after its deletion lives. ``log`` has workspace_id, symbol_id,
    revision, op (``upsert`` or ``delete``); ties of a revision go to the upsert."""
    last = log.groupBy("workspace_id", "symbol_id").agg(
        F.max_by("op", F.struct("revision", F.col("op") == "upsert")).alias("op"), F.max("revision").alias("revision")
    )
    return last.where("op = 'upsert'").drop("op")


def latest_rows(log: DataFrame, key: list[str]) -> DataFrame:
    """Live rows of an append log of any relation by revision: of each workspace and ``key`` the row
    of the last revision, unless that was a ``delete``; ties of a revision go to the upsert."""
    own = ["workspace_id", *key]
    rest = [c for c in log.columns if c not in own]
    last = log.groupBy(*own).agg(F.max_by(F.struct(*rest), F.struct("revision", F.col("op") == "upsert")).alias("row"))
    return last.where("row.op = 'upsert'").select(*own, *(F.col(f"row.{c}") for c in rest if c != "op"))


def phased_changes(changes: DataFrame) -> DataFrame:
    """One change per path from (path, change_kind, phase): the later phase overrides."""
    order = Window.partitionBy(*KEY, "path").orderBy(F.desc("phase"), "change_kind")
    return changes.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "phase")
