"""Semantic difference of consecutive snapshots: symbols, facts, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symlake.functions.facts import diff_key
from symlake.sources.relations import KEY

#: Fixed value: facts of a kind and snapshot that a requested difference looks at.
FACTS_PER_KIND = 500


def _ordered(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    return rows.join(snapshots.select(*KEY, "ord"), KEY)


def _pairs(rows: DataFrame, snapshots: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows as the later (``to``) and as the earlier (``from``) side of each pair, by ``ord`` of
    the later snapshot; the first and last snapshots have one side only."""
    ends = snapshots.groupBy("repo_id").agg(F.max("ord").alias("last"))
    placed = _ordered(rows, snapshots)
    later = placed.where("ord > 1").select("repo_id", "ord", *cols)
    earlier = (
        placed.join(ends, "repo_id")
        .where("ord < last")
        .select("repo_id", (F.col("ord") + 1).alias("ord"), *cols)
    )
    return earlier, later


def symbol_diff(symbols: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Changes of symbols between consecutive snapshots: ``repo_id, ord, change_kind, kind,
    from_id, to_id``.

    First by stable id: another id is Renamed, else another signature SignatureChanged, else
    another visibility VisibilityChanged. What is left is matched by id: another signature is
    SignatureChanged; the rest is Removed and Added. One full join per pass.
    """
    cols = ["symbol_id", "stable_id", "kind", "signature", "visibility"]
    old, new = _pairs(symbols, snapshots, cols)
    keys = ["repo_id", "ord", "stable_id"]
    a = old.select(*keys, *(F.col(c).alias(f"a_{c}") for c in cols if c != "stable_id"))
    b = new.select(*keys, *(F.col(c).alias(f"b_{c}") for c in cols if c != "stable_id"))
    joined = a.join(b, keys, "full")
    #: both halves of the second pass come from one shuffle of what the first left over, by id
    both = joined.where("a_symbol_id is not null and b_symbol_id is not null").select(
        "repo_id",
        "ord",
        F.when(F.col("a_symbol_id") != F.col("b_symbol_id"), "Renamed")
        .when(~F.col("a_signature").eqNullSafe(F.col("b_signature")), "SignatureChanged")
        .when(~F.col("a_visibility").eqNullSafe(F.col("b_visibility")), "VisibilityChanged")
        .alias("change_kind"),
        F.col("a_kind").alias("kind"),
        F.col("a_symbol_id").alias("from_id"),
        F.col("b_symbol_id").alias("to_id"),
    )
    rest = (
        joined.where("a_symbol_id is null or b_symbol_id is null")
        .groupBy("repo_id", "ord", F.coalesce("a_symbol_id", "b_symbol_id").alias("symbol_id"))
        .agg(
            F.max("a_symbol_id").alias("a"),
            F.max("b_symbol_id").alias("b"),
            F.coalesce(F.max("a_kind"), F.max("b_kind")).alias("kind"),
            F.max("a_signature").alias("a_signature"),
            F.max("b_signature").alias("b_signature"),
        )
        .select(
            "repo_id",
            "ord",
            F.when(F.col("b").isNull(), "Removed")
            .when(F.col("a").isNull(), "Added")
            .when(~F.col("a_signature").eqNullSafe(F.col("b_signature")), "SignatureChanged")
            .alias("change_kind"),
            "kind",
            F.col("a").alias("from_id"),
            F.col("b").alias("to_id"),
        )
    )
    return both.unionByName(rest).where("change_kind is not null")


def between(spark: SparkSession, repo_id: str, from_sha: str, to_sha: str) -> DataFrame:
    """Two commits of a repository as its only snapshots, for a difference of any two of them."""
    return spark.createDataFrame([(repo_id, from_sha, 1), (repo_id, to_sha, 2)], "repo_id string, commit_sha string, ord int")


def require_unique(symbols: DataFrame) -> DataFrame:
    """``symbols``, of which no two of a snapshot share a stable id; a job over others fails."""
    alone = F.count("*").over(Window.partitionBy(*KEY, "stable_id")) == 1
    clash = F.concat(F.lit("stable id twice in a snapshot: "), F.col("stable_id"))
    return symbols.withColumn("_ok", F.when(F.col("stable_id").isNull() | alone, True).otherwise(F.raise_error(clash))).where("_ok").drop("_ok")


def of_kinds(changes: DataFrame, kinds: list[str] | None) -> DataFrame:
    """Changes of symbols of some kinds, in any case; all without any."""
    return changes.where(F.col("kind").isin([k.lower() for k in kinds])) if kinds else changes


def fact_diff(facts: DataFrame, snapshots: DataFrame, per_kind: int | None = None) -> DataFrame:
    """Changes of facts by their key: ``repo_id, ord, fact_kind, fact_key, change_kind, from_value,
    to_value``; of facts with one key the least value counts. ``per_kind`` is how many facts of a
    kind and snapshot are looked at, by value; all without it."""
    if per_kind is not None:
        place = F.row_number().over(Window.partitionBy(*KEY, "fact_kind").orderBy("value", "fact_seq"))
        facts = facts.withColumn("_rank", place).where(F.col("_rank") <= per_kind)
    keyed = facts.select(*KEY, "fact_kind", diff_key(F.col("fact_kind"), F.col("value")).alias("fact_key"), "value")
    once = keyed.groupBy(*KEY, "fact_kind", "fact_key").agg(F.min("value").alias("value"))
    old, new = _pairs(once, snapshots, ["fact_kind", "fact_key", "value"])
    a = old.withColumnRenamed("value", "from_value")
    b = new.withColumnRenamed("value", "to_value")
    joined = a.join(b, ["repo_id", "ord", "fact_kind", "fact_key"], "full")
    return joined.withColumn(
        "change_kind",
        F.when(F.col("to_value").isNull(), "Removed")
        .when(F.col("from_value").isNull(), "Added")
        .when(F.col("from_value") != F.col("to_value"), "Changed"),
    ).where("change_kind is not null")


def diff_statistics(symbols: DataFrame, snapshots: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Changes per pair and kind of change, one column each; with ``facts`` also those of routes,
    config keys, tables and registrations as ``n_<kind>_<change>``."""
    found = symbol_diff(symbols, snapshots)
    kinds = ["Added", "Removed", "Renamed", "SignatureChanged", "VisibilityChanged"]
    counted = found.groupBy("repo_id", "ord").agg(
        *(F.count_if(F.col("change_kind") == k).alias(f"n_{k.lower()}") for k in kinds)
    )
    if facts is None:
        return counted
    told = fact_diff(facts, snapshots).groupBy("repo_id", "ord").agg(
        *(
            F.count_if((F.col("fact_kind") == kind) & (F.col("change_kind") == change)).alias(f"n_{kind.lower()}_{change.lower()}")
            for kind in ("Route", "Config", "DbTable", "DiRegistration")
            for change in ("Added", "Removed", "Changed")
        )
    )
    both = counted.join(told, ["repo_id", "ord"], "full")
    names = [c for c in both.columns if c not in ("repo_id", "ord")]
    return both.select("repo_id", "ord", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
