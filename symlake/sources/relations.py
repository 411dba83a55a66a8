"""The relations of an index in even spelling, each record once.

Stored tables repeat rows and spell kinds, states and paths unevenly; these views undo that
with one map-side combined aggregation per relation on its key. A record is always a row that
was stored: of several that differ, of references the one indexed last, else the least by its
columns. Columns that all rows of a record share are part of the aggregation's key, so that
filters on them move below it, down to the scan.

``columns`` names what a query needs besides the key; the rest is neither read nor moved (a row
has to be compared as a whole, so unused columns cannot be pruned later). ``where`` narrows the
stored rows first, in even spelling; it should be on what the rows of a record share. Relations
published in a catalog were folded when they were written and are read as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.functions.text import definition_id, fold, squeeze, strip_global

KEY = ["repo_id", "commit_sha"]

#: What the rows of a record have in common, by relation: the key of its fold.
SHARED = {
    "symbols": [*KEY, "symbol_id"],
    "refs": ["edge_seq", *KEY, "from_symbol_id", "ref_kind"],
    "facts": ["fact_seq", *KEY, "fact_kind"],
    "files": [*KEY, "file_id"],
    "type_relations": [*KEY, "type_symbol_id", "related_symbol_id", "relation_kind"],
}


def _once(
    even: DataFrame, name: str, columns: list[str] | None, where: Column | str | None, latest: str | None = None, order: list[Column] = []
) -> DataFrame:
    """One row per record of ``name`` with its key and ``columns`` (all where None).

    ``order`` ranks differing rows before their columns do; ``latest`` names a column whose
    greatest value ranks first.
    """
    if where is not None:
        even = even.where(where)
    key = SHARED[name]
    rest = [c for c in even.columns if c not in key and (columns is None or c in columns)]
    if not rest:
        return even.select(*key).distinct()
    row = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)), *rest)
    best = F.max_by(row, F.struct(F.col(latest), row)) if latest else F.min(row)
    picked = even.groupBy(*key).agg(best.alias("_row"))
    return picked.select(*(c if c in key else F.col(f"_row.{c}") for c in even.columns if c in key or c in rest))


def symbols(raw: DataFrame, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Symbols with kind and visibility in lower case, even signature, bare containing type."""
    even = raw.where(F.col("symbol_id").isNotNull()).select(
        *KEY,
        "symbol_id",
        "fqname",
        fold(F.col("kind")).alias("kind"),
        "file_id",
        "span_start",
        "span_end",
        squeeze(F.col("signature")).alias("signature"),
        "documentation",
        "namespace",
        strip_global(F.col("containing_type")).alias("containing_type"),
        fold(F.col("visibility")).alias("visibility"),
        "confidence",
        "stable_id",
        "name_tokens",
        "is_decompiled",
    )
    return _once(even, "symbols", columns, where)


def refs(raw: DataFrame, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """References by edge_seq; empty targets are null, states ``resolved`` or ``unresolved``; of
    a row delivered again the one indexed last."""
    none = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    even = raw.where(F.col("edge_seq").isNotNull()).select(
        "edge_seq",
        *KEY,
        none("from_symbol_id"),
        none("to_symbol_id"),
        "ref_kind",
        "file_id",
        "loc_start",
        "loc_end",
        F.coalesce(fold(F.col("resolution_state")), F.lit("resolved")).alias("resolution_state"),
        none("to_name"),
        none("to_container_hint"),
        "stable_from_id",
        "stable_to_id",
        "is_decompiled",
        "indexed_at",
    )
    return _once(even, "refs", columns, where, latest="indexed_at")


def facts(raw: DataFrame, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Facts by fact_seq; empty file ids are null."""
    even = raw.where(F.col("fact_seq").isNotNull()).withColumn(
        "file_id", F.when(F.col("file_id") != "", F.col("file_id"))
    )
    return _once(even, "facts", columns, where)


def files(raw: DataFrame, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Files with forward slashes, no leading ``./``, lower-case hash, null virtual flag as 0; a
    row with content before one without."""
    even = raw.where(F.col("file_id").isNotNull()).select(
        *KEY,
        "file_id",
        F.regexp_replace(F.translate("path", "\\", "/"), r"^(?:\./)+", "").alias("path"),
        F.lower(F.trim("sha256")).alias("sha256"),
        "project_name",
        F.coalesce("is_virtual", F.lit(0)).alias("is_virtual"),
        "content",
    )
    first = [F.col("content").isNull()] if columns is None or "content" in columns else []
    return _once(even, "files", columns, where, order=first)


def type_relations(raw: DataFrame, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Type relations with ids in definition form and kinds in lower case."""
    even = raw.select(
        *KEY,
        "type_symbol_id",
        definition_id(F.col("related_symbol_id")).alias("related_symbol_id"),
        fold(F.col("relation_kind")).alias("relation_kind"),
        "display_name",
        "stable_type_id",
        "stable_related_id",
    )
    return _once(even, "type_relations", columns, where)


def baselines(raw: DataFrame, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Baselines, one row per commit; flags hold if any of the repeats has them."""
    rows = raw if where is None else raw.where(where)
    return rows.groupBy(*KEY).agg(
        F.min("created_at").alias("created_at"),
        F.max("size_bytes").alias("size_bytes"),
        F.max("is_current_head").alias("is_current_head"),
        F.max("is_active_workspace_base").alias("is_active_workspace_base"),
    )
