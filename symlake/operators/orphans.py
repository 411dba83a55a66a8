"""References to records that do not exist, by compressed bitmaps.

Keys become integers: 128-bit codes for the shuffle, then dense 16-bit numbers from a
dictionary of the key range at hand. Per key range and period (snapshot) two bitmaps are
built, of the keys referred to and of the keys present; reference AND-NOT parent leaves the
orphans, which are decoded through the range's dictionary. Ranges hold at most 65,536 keys
of one repository and end between two keys, so memory is bounded however many keys or rows
there are: a range may exceed that by the entries of one key, one per snapshot and side. Each
(key, period) is reduced to one entry before the shuffle, so a hot key costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.functions.text import code128, fold
from symlake.session import cut

#: Keys of one bitmap container, and the count from which it is a bitset instead of an array.
RANGE, DENSE = 65_536, 4_096
#: Slices of a repository's keys that may go to different tasks; how many keys a slice has does
#: not matter, as the slices that meet in a task are cut into ranges anew.
SLICES = 65_536


class Bitmap:
    """Set of 16-bit numbers: a sorted array while sparse, a bitset when dense."""

    def __init__(self, values: np.ndarray) -> None:
        self.array = self.bits = None
        if len(values) > DENSE:
            self.bits = np.zeros(RANGE // 8, np.uint8)
            np.bitwise_or.at(self.bits, values >> 3, (1 << (values & 7)).astype(np.uint8))
        else:
            self.array = values

    def and_not(self, other: "Bitmap") -> np.ndarray:
        """The numbers of this set that ``other`` lacks, ascending."""
        if self.bits is not None and other.bits is not None:
            left = np.bitwise_and(self.bits, np.bitwise_not(other.bits))
            return np.flatnonzero(np.unpackbits(left, bitorder="little"))
        mine = self.values()
        if other.bits is not None:
            return mine[(other.bits[mine >> 3] >> (mine & 7)) & 1 == 0]
        return np.setdiff1d(mine, other.array, assume_unique=True)

    def values(self) -> np.ndarray:
        if self.bits is not None:
            return np.flatnonzero(np.unpackbits(self.bits, bitorder="little"))
        return self.array


def _range_orphans(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Orphans among the entries of one repository's key range."""
    keys = pd.MultiIndex.from_arrays([rows["k1"], rows["k2"]])
    number, dictionary = pd.factorize(keys, sort=False)
    for low in range(0, len(dictionary), RANGE):
        inside = (number >= low) & (number < low + RANGE)
        part = rows if inside.all() else rows[inside]
        local = number[inside] - low
        frame = pd.DataFrame({"period": part["period"].to_numpy(), "n": local, "side": part["side"].to_numpy()})
        frame = frame.sort_values(["period", "side", "n"], kind="stable")
        bounds = np.flatnonzero(np.diff(frame["period"].to_numpy())) + 1
        for one in np.split(np.arange(len(frame)), bounds):
            if not len(one):
                continue
            side, n = frame["side"].to_numpy()[one], frame["n"].to_numpy()[one]
            left = Bitmap(n[side == 0]).and_not(Bitmap(n[side == 1]))
            if len(left):
                codes = dictionary[left + low]
                yield pd.DataFrame(
                    {
                        "period": frame["period"].to_numpy()[one[0]],
                        "k1": codes.get_level_values(0).to_numpy(),
                        "k2": codes.get_level_values(1).to_numpy(),
                    }
                )


def _orphans_of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cuts a partition sorted by (repo, k1) into ranges that end between two keys."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        while len(batch):
            if held and batch["repo"].iloc[0] != held[-1]["repo"].iloc[-1]:
                yield from _range_orphans(pd.concat(held))
                held, size = [], 0
            repo = batch["repo"].to_numpy()
            end = int(np.searchsorted(repo != repo[0], True)) if (repo != repo[0]).any() else len(batch)
            part, batch = batch.iloc[:end], batch.iloc[end:]
            if size >= 4 * RANGE and held:
                last = held[-1]["k1"].iloc[-1]
                fresh = np.flatnonzero(part["k1"].to_numpy() != last)
                at = int(fresh[0]) if len(fresh) else len(part)
                held.append(part.iloc[:at])
                if at < len(part):
                    yield from _range_orphans(pd.concat(held))
                    held, size = [part.iloc[at:]], len(part) - at
                continue
            held.append(part)
            size += len(part)
    if held:
        yield from _range_orphans(pd.concat(held))


def orphan_rows(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Rows of ``child`` whose key ``parent`` lacks in the same snapshot: the column ``row_key``.

    ``child`` has row_key, repo_id, commit_sha, key; ``parent`` repo_id, commit_sha, key. A
    null or empty child key refers to nothing and gives no row; null parent keys are ignored.
    Repeated child rows give their row_key once. A null repo or commit is a period of its own.
    The orphans are written out, so that the join back broadcasts them while they are few; beyond
    that the rows of a hot orphan key are split by the engine's handling of skewed joins.
    """
    k1, k2 = code128(F.col("key"))
    codes = {
        "repo": F.xxhash64(F.coalesce("repo_id", F.lit("\0"))),
        "period": F.xxhash64(F.coalesce("repo_id", F.lit("\0")), F.coalesce("commit_sha", F.lit("\0"))),
        "k1": k1,
        "k2": k2,
    }
    child = child.where(F.coalesce(F.col("key") != "", F.lit(False))).select(
        "row_key", *(c.alias(n) for n, c in codes.items())
    )
    parent = parent.where(F.col("key").isNotNull()).select(*(c.alias(n) for n, c in codes.items()))
    entries = (
        child.drop("row_key").withColumn("side", F.lit(0)).unionByName(parent.withColumn("side", F.lit(1)))
    )
    ranged = (
        entries.distinct()
        .repartition("repo", F.pmod("k1", F.lit(SLICES)))
        .sortWithinPartitions("repo", "k1")
    )
    left = cut(ranged.mapInPandas(_orphans_of_partition, "period long, k1 long, k2 long"))
    return child.join(left, ["period", "k1", "k2"], "left_semi").select("row_key").distinct()


def resolved_references(refs: DataFrame, stubs: DataFrame) -> DataFrame:
    """Rows of ``refs`` that claim a target inside the index, as child rows.

    Any spelling of ``unresolved`` is left out, a null state is resolved. Targets among the
    library symbols exist everywhere; whether these are broadcast is left to the planner, which
    knows the size of their file.
    """
    outside = stubs.select(F.col("symbol_id").alias("key")).distinct()
    return (
        refs.where(F.coalesce(fold(F.col("resolution_state")), F.lit("resolved")) != "unresolved")
        .select(F.col("edge_seq").alias("row_key"), "repo_id", "commit_sha", F.col("to_symbol_id").alias("key"))
        .join(outside, "key", "left_anti")
    )


def orphan_references(
    refs: DataFrame, facts: DataFrame, symbols: DataFrame, files: DataFrame, stubs: DataFrame
) -> DataFrame:
    """Orphans of both relations: ``source_table, row_key``."""
    of_refs = orphan_rows(
        resolved_references(refs, stubs), symbols.select("repo_id", "commit_sha", F.col("symbol_id").alias("key"))
    )
    of_facts = orphan_rows(
        facts.select(F.col("fact_seq").alias("row_key"), "repo_id", "commit_sha", F.col("file_id").alias("key")),
        files.select("repo_id", "commit_sha", F.col("file_id").alias("key")),
    )
    return of_refs.select(F.lit("refs").alias("source_table"), "row_key").unionByName(
        of_facts.select(F.lit("facts").alias("source_table"), "row_key")
    )


def orphan_report(
    refs: DataFrame,
    facts: DataFrame,
    symbols: DataFrame,
    files: DataFrame,
    stubs: DataFrame,
    baselines: DataFrame,
) -> DataFrame:
    """Orphans counted per table and month of the baseline: ``source_table, month, n_orphans``.

    Rows of snapshots without a baseline have a null month.
    """
    found = cut(orphan_references(refs, facts, symbols, files, stubs))
    base = baselines.groupBy("repo_id", "commit_sha").agg(
        F.date_format(F.min("created_at"), "yyyy-MM").alias("month")
    )
    out = None
    for name, rows, key in (("refs", refs, "edge_seq"), ("facts", facts, "fact_seq")):
        where = rows.groupBy(F.col(key).alias("row_key")).agg(
            F.min(F.struct("repo_id", "commit_sha")).alias("at")
        )
        part = (
            found.where(F.col("source_table") == name)
            .join(where, "row_key")
            .select("source_table", "row_key", "at.repo_id", "at.commit_sha")
        )
        out = part if out is None else out.unionByName(part)
    return (
        out.join(base, ["repo_id", "commit_sha"], "left")
        .groupBy("source_table", "month")
        .agg(F.count("*").alias("n_orphans"))
    )
