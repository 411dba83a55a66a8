"""Workspaces over baselines, discovery of solutions, and state of a checkout: driver-side."""

from __future__ import annotations

import hashlib
import re
from dataclasses import astuple, dataclass
from pathlib import Path
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.schemas import InvalidArgument, commit_sha, workspace_id
from symlake.sources.storage import Storage


@dataclass(frozen=True)
class Workspace:
    """A workspace over a base commit."""

    repo_id: str
    workspace_id: str
    base_commit_sha: str
    revision: int = 0


class Workspaces:
    """Workspaces of a catalog, on its file system, below ``root/workspaces``.

    The state of a workspace is the last name in its ``state`` folder, ``<revision>-<base>``; a
    new revision is an empty file that only one of several writers can create, so none is lost
    and none is half-written. Its deltas lie beside it.
    """

    def __init__(self, root: str, spark: SparkSession | None = None) -> None:
        self.root = f"{root.rstrip('/')}/workspaces"
        self.storage = Storage(spark or SparkSession.active())

    def _folder(self, repo_id: str, name: str) -> str:
        return f"{self.root}/{quote(repo_id, safe='')}/{quote(workspace_id(name), safe='')}"

    def deltas(self, repo_id: str, name: str, relation: str) -> str:
        """Folder of a workspace's append log of one relation."""
        return f"{self._folder(repo_id, name)}/deltas/{relation}"

    def _state(self, repo_id: str, name: str) -> Workspace | None:
        names = self.storage.names(f"{self._folder(repo_id, name)}/state")
        if not names:
            return None
        revision, _, base = names[-1].partition("-")
        return Workspace(repo_id, name, base, int(revision))

    def _claim(self, repo_id: str, name: str, base: str, revision: int) -> bool:
        return self.storage.create(f"{self._folder(repo_id, name)}/state/{revision:012}-{base}")

    def create(self, repo_id: str, name: str, base: str) -> Workspace:
        """A new workspace; the existing one if it has the same base."""
        commit_sha(base)
        old = self._state(repo_id, name)
        if old is None:
            self._claim(repo_id, name, base, 0)
            old = self._state(repo_id, name)
        if old.base_commit_sha != base:
            raise InvalidArgument("the workspace exists on another base")
        return old

    def advance(self, repo_id: str, name: str) -> Workspace:
        """The workspace at its next revision; of several callers each gets its own."""
        while True:
            now = self.get(repo_id, name)
            if self._claim(repo_id, name, now.base_commit_sha, now.revision + 1):
                return Workspace(repo_id, name, now.base_commit_sha, now.revision + 1)

    def reset(self, repo_id: str, name: str) -> Workspace:
        """The workspace at revision 0, without its deltas."""
        base = self.get(repo_id, name).base_commit_sha
        folder = self._folder(repo_id, name)
        self.storage.delete(f"{folder}/deltas")
        self._claim(repo_id, name, base, 0)
        first = f"{0:012}-{base}"
        self.storage.delete(*(f"{folder}/state/{n}" for n in self.storage.names(f"{folder}/state") if n != first))
        return self.get(repo_id, name)

    def get(self, repo_id: str, name: str) -> Workspace:
        found = self._state(repo_id, name)
        if found is None:
            raise InvalidArgument("no such workspace")
        return found

    def delete(self, repo_id: str, name: str) -> bool:
        """Whether there was one to remove; its deltas go with it."""
        if self._state(repo_id, name) is None:
            return False
        self.storage.delete(self._folder(repo_id, name))
        return True

    def list(self, spark: SparkSession, baselines: DataFrame) -> DataFrame:
        """All workspaces with ``is_stale`` (the base is not the head of its repository) and the
        relations that have deltas, joined in order."""
        rows = []
        for repo in self.storage.names(self.root):
            for name in self.storage.names(f"{self.root}/{repo}"):
                w = self._state(unquote(repo), unquote(name))
                if w:
                    changed = self.storage.names(f"{self._folder(w.repo_id, w.workspace_id)}/deltas")
                    rows.append((*astuple(w), ", ".join(changed)))
        mine = spark.createDataFrame(rows, "repo_id string, workspace_id string, base_commit_sha string, revision int, changed string")
        head = baselines.where("is_current_head").groupBy("repo_id").agg(F.max_by("commit_sha", "created_at").alias("head"))
        return mine.join(head, "repo_id", "left").withColumn(
            "is_stale", F.coalesce(F.col("head") != F.col("base_commit_sha"), F.lit(False))
        )


def find_solution(folder: str, wanted: str | None = None) -> Path | None:
    """The solution of a checkout: the named one or its other form, else one at the root, else the
    only project at the root or one folder below."""
    root = Path(folder)
    if wanted:
        for p in (root / wanted, (root / wanted).with_suffix({".sln": ".slnx", ".slnx": ".sln"}.get(Path(wanted).suffix, ".sln"))):
            if p.exists():
                return p
    for pattern in ("*.slnx", "*.sln"):
        found = sorted(root.glob(pattern))
        if found:
            return found[0]
    for depth in ("", "*/"):
        found = sorted(p for e in ("csproj", "vbproj", "fsproj") for p in root.glob(f"{depth}*.{e}"))
        if len(found) == 1:
            return found[0]
    return None


def repo_id_of(remote: str) -> str:
    """A repository id from its remote address: the same for all forms of the address."""
    bare = re.sub(r"^[a-z+]+://", "", remote.strip(), flags=re.I)
    bare = re.sub(r"^[^@/]+@", "", bare).replace(":", "/", 1)
    bare = re.sub(r"(?:\.git)?/*$", "", bare).lower()
    return hashlib.sha256(bare.encode()).hexdigest()[:16]


def checkout_state(folder: str) -> dict[str, str | None]:
    """Branch and head commit of a checkout, from its ``.git`` folder; nulls where unknown."""
    git = Path(folder) / ".git"
    head = (git / "HEAD").read_text().strip() if (git / "HEAD").exists() else ""
    if not head.startswith("ref: "):
        return {"branch": None, "head": head or None}
    ref = head[5:]
    if (git / ref).exists():
        sha = (git / ref).read_text().strip()
    else:
        packed = (git / "packed-refs").read_text() if (git / "packed-refs").exists() else ""
        sha = next((x.split()[0] for x in packed.splitlines() if x.endswith(" " + ref)), None)
    return {"branch": ref.rpartition("refs/heads/")[2], "head": sha}


def distance(a: str, b: str) -> int:
    """Edit distance of two names: signs put in, left out or replaced."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def closest(name: str, names: list[str]) -> str | None:
    """The known name next to a mistyped one, if it is near: within a third of its length, two
    signs at least and four at most."""
    best = min(names, key=lambda n: distance(name, n), default=None)
    return best if name and best is not None and distance(name, best) <= min(4, max(2, len(name) // 3)) else None


#: Target frameworks from most to least wanted.
TARGETS = [r"^net(?:[5-9]|\d\d)\.0", r"^netcoreapp", r"^netstandard2\.1", r"^netstandard", r"^net4"]


def best_targets(projects: DataFrame) -> DataFrame:
    """One row per project of (path, target): the best target framework, newest first."""
    rank = F.lit(len(TARGETS))
    for i, pattern in reversed(list(enumerate(TARGETS))):
        rank = F.when(F.col("target").rlike(pattern), i).otherwise(rank)
    number = F.coalesce(F.regexp_extract("target", r"(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))
    return projects.groupBy("path").agg(F.max_by("target", F.struct(-rank, number, F.col("target"))).alias("target"), F.count("*").alias("n_targets"))
