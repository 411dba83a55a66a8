"""What a codebase shows to the outside: endpoints, configuration keys, tables, registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlake.functions import facts as parse
from symlake.sources.relations import KEY

#: Confidence from best to worst.
CONFIDENCE = ["High", "Medium", "Low"]


def worst(column: str = "confidence"):
    """Aggregate: the worst confidence."""
    at = F.array_position(F.array(*(F.lit(c) for c in CONFIDENCE)), F.col(column))
    return F.element_at(F.array(*(F.lit(c) for c in CONFIDENCE)), F.max(F.when(at > 0, at).otherwise(3)).cast("int"))


def of_kind(facts: DataFrame, kind: str, limit: int | None) -> DataFrame:
    """Facts of a kind in each snapshot by value, the first ``limit`` (all without one), with
    ``rank`` and whether there are more (``had_more``)."""
    rows = facts.where(F.col("fact_kind") == kind)
    per = Window.partitionBy(*KEY)
    if limit is None:
        return rows.withColumn("had_more", F.lit(False))
    order = per.orderBy("value", "symbol_id", "fact_seq")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit + 1)
    return ranked.withColumn("had_more", F.max("rank").over(per) > limit).where(F.col("rank") <= limit)


def endpoints(
    facts: DataFrame, limit: int = 50, method: str | None = None, path: str | None = None, filter_first: bool = False
) -> DataFrame:
    """Routes: ``repo_id, commit_sha, fact_seq, method, path, symbol_id``. The limit cuts before
    the filters, as the request's limit is one of facts looked at; ``filter_first`` turns it."""
    keep = F.lit(True)
    if method:
        keep = keep & (F.lower(parse.route_method(F.col("value"))) == method.lower())
    if path:
        keep = keep & F.lower(parse.route_path(F.col("value"))).startswith(path.lower())
    rows = of_kind(facts.where(keep) if filter_first else facts, "Route", limit)
    return rows.where(keep).select(
        *KEY,
        "fact_seq",
        parse.route_method(F.col("value")).alias("method"),
        parse.route_path(F.col("value")).alias("path"),
        "symbol_id",
    )


def config_keys(facts: DataFrame, limit: int = 50, prefix: str | None = None) -> DataFrame:
    """Configuration keys with the pattern of their use, ``unknown`` without one."""
    rows = of_kind(facts, "Config", limit).select(
        *KEY,
        "fact_seq",
        F.substring_index("value", "|", 1).alias("key"),
        parse.after_pipe(F.col("value"), "unknown").alias("pattern"),
        "symbol_id",
    )
    return rows.where(F.lower("key").startswith(prefix.lower())) if prefix else rows


def db_tables(facts: DataFrame, table: str | None = None, limit: int | None = None) -> DataFrame:
    """Tables of each snapshot, names in any case as one: ``schema_name, table_name, entity,
    n_referrers, confidence``.

    The first fact by value gives the spelling and whether the table is an entity set, whose
    first referrer is the entity; the worst confidence holds. ``limit`` keeps the first tables
    by name; ``table``, a prefix in any case of the table's name, then picks among them.
    """
    rows = facts.where("fact_kind = 'DbTable'").select(
        *KEY,
        F.substring_index("value", "|", 1).alias("name"),
        parse.after_pipe(F.col("value"), "").alias("origin"),
        "symbol_id",
        "confidence",
        F.struct("value", "symbol_id", "fact_seq").alias("order"),
    )
    grouped = rows.groupBy(*KEY, F.lower("name").alias("table_key")).agg(
        F.min_by("name", "order").alias("name"),
        F.min_by("origin", "order").alias("origin"),
        F.min_by("symbol_id", "order").alias("first_referrer"),
        F.count_distinct("symbol_id").alias("n_referrers"),
        worst().alias("confidence"),
    )
    if limit is not None:
        order = Window.partitionBy(*KEY).orderBy("table_key")
        grouped = grouped.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit)
    if table is not None:
        grouped = grouped.where(F.lower(parse.table_name(F.col("name"))).startswith(table.lower()))
    return grouped.select(
        *KEY,
        parse.table_schema(F.col("name")).alias("schema_name"),
        parse.table_name(F.col("name")).alias("table_name"),
        F.when(F.col("origin").startswith("DbSet"), F.col("first_referrer")).alias("entity"),
        "n_referrers",
        "confidence",
    )


def registrations(facts: DataFrame) -> DataFrame:
    """Dependency injection registrations."""
    parts = parse.registration(F.col("value"))
    return facts.where("fact_kind = 'DiRegistration'").select(
        *KEY, "fact_seq", *(c.alias(n) for n, c in parts.items())
    )


def middleware(facts: DataFrame) -> DataFrame:
    """Middleware in pipeline order within a snapshot."""
    return facts.where("fact_kind = 'Middleware'").select(
        *KEY,
        "fact_seq",
        parse.before_pipe(F.col("value")).alias("name"),
        parse.middleware_position(F.col("value")).alias("position"),
        F.col("value").endswith("|terminal").alias("terminal"),
    )


def by_top_prefix(facts: DataFrame) -> DataFrame:
    """Configuration keys per top-level section: ``section, n_keys``."""
    key = F.substring_index("value", "|", 1)
    return (
        facts.where("fact_kind = 'Config'")
        .groupBy(*KEY, F.substring_index(key, ":", 1).alias("section"))
        .agg(F.count_distinct(key).alias("n_keys"))
    )
