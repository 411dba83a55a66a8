"""Snapshots of an index as Parquet, and the metadata of workspaces over them.

Layout under the root: ``<relation>/repo_id=…/commit_sha=…``. Records are spelled evenly and
folded once, when a snapshot is published; reads take them as they are, prune partitions by
repository and commit, and push other predicates into files sorted for them. A snapshot is
published by a marker folder of its own in ``baselines``, written after all relations, so
readers never see a half-written one and removing one touches no other; writing a published
snapshot again is a no-op.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.operators import search
from symlake.operators.maintenance import retention
from symlake.schemas import BASELINES, RELATIONS, InvalidArgument, commit_sha
from symlake.sources import relations
from symlake.sources.storage import Storage, partition

#: Column each relation is sorted by within its files, for min/max pruning of lookups.
SORTED_BY = {
    "symbols": ["symbol_id"], "refs": ["to_symbol_id", "edge_seq"], "facts": ["fact_kind", "value"], "files": ["path"],
    "type_relations": ["type_symbol_id"], "postings": ["token"], "refs_by_source": ["from_symbol_id", "edge_seq"],
}
#: Copies of relations that a snapshot holds for one kind of lookup: the token index of its
#: symbols, and its references by where they come from.
DERIVED = {"postings": ("symbols", search.postings), "refs_by_source": ("refs", lambda df: df)}


class Corrupt(RuntimeError):
    """A copy that does not equal what it was made from."""


def digest(df: DataFrame) -> tuple[int, int, int]:
    """Number of rows and two sums over their codes: equal for equal rows in any order."""
    code = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)))
    got = df.agg(F.count("*").alias("n"), F.bit_xor(code).alias("x"), F.sum(F.shiftright(code, 16)).alias("s")).first()
    return got["n"], got["x"] or 0, got["s"] or 0


class IndexCatalog:
    """A folder of snapshots, on any file system Spark can write to."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.storage = spark, root.rstrip("/"), Storage(spark)

    def _path(self, relation: str) -> str:
        return f"{self.root}/{relation}"

    def _snapshot(self, relation: str, repo_id: str, sha: str) -> str:
        return f"{self._path(relation)}/{partition(repo_id=repo_id, commit_sha=sha)}"

    def baselines(self) -> DataFrame:
        """All published snapshots; an empty table for a new catalog."""
        if not self.storage.names(self._path("baselines")):
            return self.spark.createDataFrame([], BASELINES)
        return self.spark.read.schema(BASELINES).parquet(self._path("baselines")).select(BASELINES.fieldNames())

    def has(self, repo_id: str, sha: str) -> bool:
        """Whether a snapshot is published."""
        return any(n.startswith("part-") for n in self.storage.names(self._snapshot("baselines", repo_id, sha)))

    def write(
        self, repo_id: str, sha: str, rows: dict[str, DataFrame], created_at: str, is_head: bool = False, verify: bool = False
    ) -> bool:
        """Publishes a snapshot; False if it is there already.

        ``rows`` maps relation names to stored rows, whose repo_id and commit_sha are set here;
        they may repeat and be spelled unevenly. Rows left by a write that broke off are
        replaced. With ``verify`` what was written is read back and compared before the marker is
        set; a difference raises :class:`Corrupt` and nothing is published.
        """
        commit_sha(sha)
        unknown = set(rows) - set(RELATIONS)
        if unknown:
            raise InvalidArgument(f"no such relation: {sorted(unknown)}")
        if self.has(repo_id, sha):
            return False
        for name, df in rows.items():
            schema = RELATIONS[name]
            out = df.withColumn("repo_id", F.lit(repo_id)).withColumn("commit_sha", F.lit(sha))
            out = out.select(*(F.col(f.name).cast(f.dataType) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
            even = getattr(relations, name)(out).select(schema.fieldNames())
            self._store(name, even, repo_id, sha)
            if verify and digest(even) != digest(self._stored(name, repo_id, sha)):
                raise Corrupt(f"{name} of {repo_id} {sha}")
        for name, (source, derive) in DERIVED.items():
            if source in rows:
                self._store(name, derive(self._stored(source, repo_id, sha)), repo_id, sha)
        size = sum(self.storage.size(self._snapshot(n, repo_id, sha)) for n in rows)
        mark = self.spark.createDataFrame([(repo_id, sha, None, size, is_head, False)], BASELINES).drop("repo_id", "commit_sha")
        mark.withColumn("created_at", F.lit(created_at).cast("timestamp")).coalesce(1).write.mode("overwrite").parquet(
            self._snapshot("baselines", repo_id, sha)
        )
        return True

    def _store(self, name: str, rows: DataFrame, repo_id: str, sha: str) -> None:
        """Rows of one snapshot, sorted, in place of any that are there."""
        (
            rows.drop("repo_id", "commit_sha")
            .sortWithinPartitions(*SORTED_BY[name])
            .write.mode("overwrite")
            .parquet(self._snapshot(name, repo_id, sha))
        )

    def _stored(self, name: str, repo_id: str, sha: str) -> DataFrame:
        at = (F.col("repo_id") == repo_id) & (F.col("commit_sha") == sha)
        return self._scan(name).where(at)

    def _scan(self, name: str) -> DataFrame:
        """All stored rows of a relation or a derived copy, published or not."""
        schema = RELATIONS.get(name) or (search.POSTINGS if name == "postings" else RELATIONS["refs"])
        if not self.storage.names(self._path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name)).select(schema.fieldNames())

    def read(self, relation: str, repo_id: str | None = None, sha: str | None = None) -> DataFrame:
        """A relation's records in published snapshots, of one repository or snapshot if named.

        Filters on the result reach the scan: repository and commit prune folders, the columns of
        ``SORTED_BY`` prune row groups.
        """
        if relation not in RELATIONS and relation not in DERIVED:
            raise InvalidArgument(f"no such relation: {relation}")
        df = self._scan(relation)
        if repo_id is not None:
            df = df.where(F.col("repo_id") == repo_id)
        if sha is not None:
            df = df.where(F.col("commit_sha") == sha)
        if repo_id is not None and sha is not None:
            return df if self.has(repo_id, sha) else df.limit(0)
        published = self.baselines().select("repo_id", "commit_sha").distinct()
        return df.join(published, ["repo_id", "commit_sha"], "left_semi").select(df.columns)

    def cleanup(self, keep: int = 5, older_than: str | None = None, dry_run: bool = True) -> DataFrame:
        """What :func:`retention` removes; without ``dry_run`` it is removed.

        Markers go first, so a clean-up that breaks off leaves unpublished rows only; a snapshot
        published meanwhile is not touched.
        """
        doomed = retention(self.baselines(), keep, older_than).where("verdict = 'removed'")
        if not dry_run:
            gone = [(r["repo_id"], r["commit_sha"]) for r in doomed.toLocalIterator()]
            self._drop(gone)
            return self.spark.createDataFrame(gone, "repo_id string, commit_sha string")
        return doomed.select("repo_id", "commit_sha")

    def remove_repo(self, repo_id: str, dry_run: bool = True) -> int:
        """Number of a repository's snapshots; without ``dry_run`` they are removed."""
        mine = self.baselines().where(F.col("repo_id") == repo_id).select("repo_id", "commit_sha").distinct()
        gone = [(r["repo_id"], r["commit_sha"]) for r in mine.toLocalIterator()]
        if not dry_run:
            self._drop(gone)
        return len(gone)

    def _drop(self, gone: list[tuple[str, str]]) -> None:
        """Removes snapshots folder by folder: a folder per relation and snapshot, as many as are
        removed; no other snapshot's files are read or written."""
        self.storage.delete(*(self._snapshot("baselines", *key) for key in gone))
        self.storage.delete(*(self._snapshot(name, *key) for name in (*RELATIONS, *DERIVED) for key in gone))

    def push(self, other: "IndexCatalog", repo_id: str, sha: str) -> bool:
        """Copies a snapshot to a shared catalog; False if it is there already."""
        mark = self.baselines().where((F.col("repo_id") == repo_id) & (F.col("commit_sha") == sha))
        first = mark.select(F.min("created_at").cast("string"), F.max("is_current_head")).first()
        if first is None or first[0] is None:
            raise InvalidArgument("no such snapshot")
        rows = {n: self.read(n, repo_id, sha) for n in RELATIONS if self.storage.exists(self._snapshot(n, repo_id, sha))}
        return other.write(repo_id, sha, rows, first[0], bool(first[1]), verify=True)

    def pull(self, other: "IndexCatalog", repo_id: str, sha: str) -> bool:
        """Copies a snapshot from a shared catalog and compares the copy before it is published; False
        if it is here already or not there."""
        if self.has(repo_id, sha) or not other.has(repo_id, sha):
            return False
        return other.push(self, repo_id, sha)


def harvest(spark: SparkSession, folder: str, repo_id: str, sha: str, glob: str = "*.{cs,vb,fs,fsx,razor,cshtml}") -> DataFrame:
    """Source files of a folder as rows of ``files``: path below it, hash, project, whole content.

    The project is the first folder below ``src`` or ``tests``, else the first of the path.
    """
    base = PurePosixPath(folder).as_posix().rstrip("/")
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(base)
        .select("path", "content")
    )
    path = F.regexp_replace("path", r"^.*?\Q" + base.lstrip("/") + r"\E/", "")
    text = F.decode("content", "UTF-8")
    return raw.select(
        F.lit(repo_id).alias("repo_id"),
        F.lit(sha).alias("commit_sha"),
        F.concat(F.lit("f"), F.substring(F.sha2(path, 256), 1, 16)).alias("file_id"),
        path.alias("path"),
        F.sha2("content", 256).alias("sha256"),
        F.regexp_extract(path, r"^(?:(?:src|tests)/)?([^/]+)/", 1).alias("project_name"),
        F.lit(0).alias("is_virtual"),
        F.regexp_replace(text, "^﻿", "").alias("content"),
    )
