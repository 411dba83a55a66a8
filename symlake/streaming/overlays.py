"""Workspace deltas as a stream: an append log with revisions, and its live state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symlake.operators.overlay import latest_rows, latest_state
from symlake.sources.storage import Storage

#: Columns of the delta log.
LOG = "workspace_id string, symbol_id string, op string, changed_at timestamp"


def append_deltas(deltas: DataFrame, log_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream of (workspace_id, symbol_id, op, changed_at) to the log at ``log_path``.

    Each micro-batch is one revision, numbered by its batch id and written to a folder of its
    own: a batch that is run again after a failure replaces its folder, so every delta counts
    once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("revision", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{log_path}/revision={batch_id:012d}"
        )

    writer = deltas.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def replay(spark, log_path: str, up_to: int | None = None) -> DataFrame:
    """The log's live symbols per workspace, up to a revision if named."""
    log = spark.read.option("recursiveFileLookup", "true").parquet(log_path)
    if up_to is not None:
        log = log.where(F.col("revision") <= up_to)
    return latest_state(log)


def replay_rows(spark, log_path: str, key: list[str], up_to: int | None = None) -> DataFrame:
    """The live rows of a log of any relation, by workspace and ``key``; up to a revision if named.

    :func:`append_deltas` writes such logs as it does those of ids: whole rows of the relation with
    workspace_id and op beside them.
    """
    log = spark.read.option("recursiveFileLookup", "true").parquet(log_path)
    if up_to is not None:
        log = log.where(F.col("revision") <= up_to)
    return latest_rows(log, key)


def compaction_due(spark, log_path: str, max_bytes: int = 16 << 20, max_rows: int = 50_000) -> bool:
    """Whether a log has grown to where it should be compacted."""
    if Storage(spark).size(log_path) >= max_bytes:
        return True
    log = spark.read.option("recursiveFileLookup", "true").parquet(log_path)
    return log.limit(max_rows).count() >= max_rows


def compact(spark, log_path: str, to_path: str) -> None:
    """Writes the live state as one upsert per symbol: a log that replays to the same state."""
    state = replay(spark, log_path)
    state.withColumn("op", F.lit("upsert")).write.mode("overwrite").parquet(to_path)


def changes_per_window(deltas: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Deltas per workspace, operation and time window, with a watermark for late ones; for batch
    tables and streams alike."""
    timed = deltas.withWatermark("changed_at", delay) if deltas.isStreaming else deltas
    grouped = timed.groupBy(F.window("changed_at", window).alias("w"), "workspace_id", "op")
    return grouped.agg(F.count("*").alias("n_changes")).select(
        F.col("w.start").alias("window_start"), "workspace_id", "op", "n_changes"
    )
