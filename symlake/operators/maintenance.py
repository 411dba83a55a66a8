"""Upkeep of snapshots and symbols: retention, staleness, structural ids, savings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from symlake.sources.relations import KEY

#: Tokens a reader is spared per hit, card, line and symbol, and their price.
SAVED_PER_HIT, SAVED_PER_CARD, SAVED_PER_LINE, SAVED_PER_CONTEXT = 750, 1650, 10, 1500
PRICE_PER_THOUSAND = 0.003


def retention(baselines: DataFrame, keep: int = 5, older_than: str | None = None) -> DataFrame:
    """What a cleanup would do with each baseline: ``repo_id, commit_sha, age_rank, verdict``.

    ``protected`` for heads and bases of active workspaces, ``kept`` for the ``keep`` newest of
    a repository and those not before ``older_than`` (a timestamp), else ``removed``.
    """
    order = Window.partitionBy("repo_id").orderBy(F.desc("created_at"), "commit_sha")
    young = F.col("created_at") >= F.lit(older_than).cast("timestamp") if older_than else F.lit(False)
    return baselines.withColumn("age_rank", F.row_number().over(order)).select(
        *KEY,
        "age_rank",
        "size_bytes",
        F.when(F.col("is_current_head") | F.col("is_active_workspace_base"), "protected")
        .when((F.col("age_rank") <= keep) | young, "kept")
        .otherwise("removed")
        .alias("verdict"),
    )


def by_age() -> WindowSpec:
    """The order of a repository's baselines, the oldest first."""
    return Window.partitionBy("repo_id").orderBy("created_at", "commit_sha")


def reclaimed(baselines: DataFrame, keep: int = 5) -> DataFrame:
    """Baselines and bytes per repository and verdict of :func:`retention`."""
    return retention(baselines, keep).groupBy("repo_id", "verdict").agg(
        F.count("*").alias("n_baselines"), F.sum("size_bytes").alias("bytes")
    )


def catalog(baselines: DataFrame, snapshots: DataFrame) -> DataFrame:
    """All baselines with their order, whether they were built, and whether they are behind the
    head of their repository."""
    head = baselines.where("is_current_head").groupBy("repo_id").agg(F.max("created_at").alias("head_at"))
    built = snapshots.select(*KEY, "ord")
    return (
        baselines.join(built, KEY, "left")
        .join(head, "repo_id", "left")
        .select(
            *KEY,
            "created_at",
            "size_bytes",
            "ord",
            F.col("ord").isNotNull().alias("is_built"),
            F.coalesce(F.col("created_at") < F.col("head_at"), F.lit(False)).alias("is_stale"),
        )
    )


def structural_ids(symbols: DataFrame) -> DataFrame:
    """Ids that survive renames: ``repo_id, commit_sha, symbol_id, structural_id``.

    ``sym_`` and 16 hexadecimal digits of SHA-256 over kind, container, namespace and the types
    of the signature, without names; of equal ones in a container the later by place carry
    their number.
    """
    params = F.regexp_extract("symbol_id", r"\((.*)\)$", 1)
    returns = F.regexp_extract(F.coalesce("signature", F.lit("")), r"^(?:static )?([^ (]+) ", 1)
    shape = F.concat_ws("|", "kind", F.coalesce("containing_type", F.lit("")), F.coalesce("namespace", F.lit("")), returns, params)
    order = Window.partitionBy(*KEY, "shape").orderBy("span_start", "symbol_id")
    return (
        symbols.withColumn("shape", shape)
        .withColumn("n", F.row_number().over(order) - 1)
        .select(
            *KEY,
            "symbol_id",
            F.concat(
                F.lit("sym_"),
                F.substring(
                    F.sha2(F.when(F.col("n") > 0, F.concat("shape", F.lit("#"), F.col("n").cast("string"))).otherwise(F.col("shape")), 256),
                    1,
                    16,
                ),
            ).alias("structural_id"),
        )
    )


def plain_ids(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Ids and content hashes by value: ``symbol_id, plain_id, content_hash``.

    ``plain_id`` hashes kind, full name and project (a rename changes it), ``content_hash`` all
    that a card shows, to tell whether a symbol changed between two states.
    """
    own = files.select(*KEY, "file_id", "project_name")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = symbols.join(own, [*KEY, "file_id"], "left")
    named = F.concat(text("kind"), F.lit("\0"), text("fqname"), F.lit("\0"), text("project_name"))
    shown = F.concat_ws(
        "|", text("kind"), text("signature"), text("documentation"), F.concat(text("span_start"), F.lit("-"), text("span_end")), text("visibility")
    )
    return rows.select(
        *KEY,
        "symbol_id",
        F.concat(F.lit("sym_"), F.substring(F.sha2(named, 256), 1, 16)).alias("plain_id"),
        F.substring(F.sha2(shown, 256), 1, 16).alias("content_hash"),
    )


def savings(hits: DataFrame) -> DataFrame:
    """Tokens and money a search spares, per query: ``n_hits, tokens_saved, usd_saved``."""
    tokens = F.count("*") * SAVED_PER_HIT
    return hits.groupBy("query").agg(
        F.count("*").alias("n_hits"),
        tokens.alias("tokens_saved"),
        (tokens / 1000 * PRICE_PER_THOUSAND).cast("decimal(18,6)").cast("double").alias("usd_saved"),
    )


def project_statistics(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols and files per project of each snapshot."""
    own = files.where("project_name is not null").select(*KEY, "file_id", "project_name")
    return (
        own.join(symbols.select(*KEY, "file_id", "symbol_id"), [*KEY, "file_id"], "left")
        .groupBy(*KEY, "project_name")
        .agg(F.count_distinct("file_id").alias("n_files"), F.count("symbol_id").alias("n_symbols"))
    )
