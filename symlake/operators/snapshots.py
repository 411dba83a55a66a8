"""The built snapshots of each repository, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlake.session import cut


def built_snapshots(baselines: DataFrame, *tables: DataFrame) -> DataFrame:
    """Baselines with rows in any of ``tables``: ``repo_id, commit_sha, created_at, ord``.

    ``ord`` counts from 1 within the repository by (created_at, commit_sha). Repeated
    baselines count once (earliest created_at); rows with a null key are no snapshots. The
    table has one row per snapshot and is written out, so later joins know its true size.
    """
    held = None
    for t in tables:
        part = t.groupBy("repo_id", "commit_sha").agg(F.lit(1).alias("one")).drop("one")
        held = part if held is None else held.unionByName(part)
    base = baselines.groupBy("repo_id", "commit_sha").agg(F.min("created_at").alias("created_at"))
    order = Window.partitionBy("repo_id").orderBy("created_at", "commit_sha")
    return cut(
        base.join(held, ["repo_id", "commit_sha"], "left_semi").withColumn("ord", F.row_number().over(order))
    )
