"""Session helpers: reading tables, cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, as stored (Parquet file or folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can read: ``spark.checkpoint.dir`` of the session.

    Only where the cluster names none (single-process tests), a temporary folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        kept = spark.sparkContext.getCheckpointDir()
        if kept:
            return kept
        named = tempfile.mkdtemp(prefix="symlake-")
        spark.sparkContext.setCheckpointDir(named)
        return spark.sparkContext.getCheckpointDir() or named
    return named


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan, over all cores if it comes in fewer partitions than there are cores.

    For work that costs more per byte than a shuffle. A large input has more partitions than
    cores and is left as it is; what is moved is at most a scan partition per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut_with(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """:func:`cut` and aggregates of the rows, taken while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, *(c.alias(n) for n, c in measures.items())))
    return out, seen.get


#: Folders written since the innermost :func:`scratch` began.
_written: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that :func:`cut` writes inside, at its end: for long sessions, around a
    query and what reads its result."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a scan of that table.

    Ends the lineage: a lost executor re-reads files instead of recomputing, and the planner
    sees the true size of the table, so broadcast decisions rest on a measured bound. The
    folder is removed at the end of a :func:`scratch` around it, else with the driver's JVM.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/symlake-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)
