"""History of changing attributes: versions with validity periods from full snapshots.

The snapshots are co-partitioned by entity and each partition is sorted by (entity, time), so
that the runs of all snapshots come out of the external sort as one merged stream. An iterator
walks that stream batch by batch and emits a version as soon as it is closed: by another
payload, by a snapshot without the entity, or by the next entity. It holds one batch and the
one open version, whatever the number of entities, snapshots or rows of an entity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.functions.text import fold, squeeze


def _equal(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Whether values are equal, nulls being equal to nulls."""
    known = pc.fill_null(pc.equal(left, right), False)
    return pc.or_(known, pc.and_(pc.is_null(left), pc.is_null(right))).to_numpy(zero_copy_only=False)


def closed_versions(keys: list[str], payload: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The iterator over one merged stream of (keys, ord, payload), sorted by all of them.

    Emits ``keys, version, first_ord, last_ord, n_snapshots, payload`` per version. Of several
    rows of an entity and snapshot the first, that is the least payload, counts.
    """
    names = [*keys, "version", "first_ord", "last_ord", "n_snapshots", *payload]

    def emit(rows: pa.Table, at: np.ndarray, version, first, last, n) -> pa.RecordBatch:
        got = rows.take(pa.array(at)).combine_chunks()
        cols = {"version": version, "first_ord": first, "last_ord": last, "n_snapshots": n}
        types = {"version": pa.int64(), "first_ord": pa.int32(), "last_ord": pa.int32(), "n_snapshots": pa.int64()}
        arrays = [pa.array(cols[c], types[c]) if c in cols else got.column(c).combine_chunks() for c in names]
        return pa.RecordBatch.from_arrays([a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        #: the open version's last row, and its number, first ord and snapshots so far
        last_row, number, first_ord, seen = None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            carried = last_row is not None
            if carried:
                rows = pa.concat_tables([last_row, rows])
            rows = rows.combine_chunks()
            size = rows.num_rows
            before, after = rows.slice(0, size - 1), rows.slice(1)
            col = lambda t, c: t.column(c).combine_chunks()
            kin = np.ones(size - 1, bool)
            for c in keys:
                kin &= _equal(col(before, c), col(after, c))
            order = rows.column("ord").to_numpy()
            step = order[1:] - order[:-1]
            #: repeats of an entity in a snapshot go, then neighbours are compared again
            keep = np.concatenate([[True], ~(kin & (step == 0))])
            if not keep.all():
                rows = rows.filter(pa.array(keep)).combine_chunks()
                size = rows.num_rows
                before, after = rows.slice(0, size - 1), rows.slice(1)
                order = rows.column("ord").to_numpy()
                step = order[1:] - order[:-1]
                kin = np.ones(size - 1, bool)
                for c in keys:
                    kin &= _equal(col(before, c), col(after, c))
            same = kin & (step == 1)
            for c in payload:
                same &= _equal(col(before, c), col(after, c))
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            fresh = np.concatenate([[True], ~kin])[starts]
            #: numbers count from the start of the entity, whose first version may be the carried one
            place = np.arange(len(starts))
            base = np.maximum.accumulate(np.where(fresh, place, 0))
            version = place - base + 1
            ends = np.concatenate([starts[1:], [size]]) - 1
            first, last, n = order[starts].copy(), order[ends], ends - starts + 1
            if carried:
                version = np.where(base == 0, version + number - 1, version)
                first[0] = first_ord
                n[0] += seen - 1
            if len(starts) > 1:
                yield emit(rows, starts[:-1], version[:-1], first[:-1], last[:-1], n[:-1])
            last_row, number, first_ord, seen = rows.slice(size - 1), int(version[-1]), int(first[-1]), int(n[-1])
            #: a copy, so that the batch it is a slice of can go
            last_row = last_row.take(pa.array([0]))
        if last_row is not None:
            order = last_row.column("ord").to_numpy()
            yield emit(last_row, np.array([0]), [number], [first_ord], order, [seen])

    return run


def versions(rows: DataFrame, snapshots: DataFrame, entity: str, payload: list[str]) -> DataFrame:
    """Every version: ``repo_id, entity, version, first_ord, last_ord, n_snapshots, payload``.

    ``rows`` has repo_id, commit_sha, the entity and the payload columns (strings); other
    columns are not read. Rows with a null entity or of no known snapshot are left out; of
    conflicting rows of a snapshot the least payload holds; null payloads are values of their
    own. Repeated rows are folded map-side before they are moved, so an entity reaches its
    partition with a row per snapshot and payload.
    """
    keyed = rows.where(F.col(entity).isNotNull()).select("repo_id", "commit_sha", entity, *payload).join(
        snapshots.select("repo_id", "commit_sha", "ord"), ["repo_id", "commit_sha"]
    )
    once = keyed.select("repo_id", entity, "ord", *payload).distinct()
    merged = once.repartition("repo_id", entity).sortWithinPartitions("repo_id", entity, "ord", *payload)
    text = ", ".join(f"`{c}` string" for c in payload)
    return merged.mapInArrow(
        closed_versions(["repo_id", entity], payload),
        f"repo_id string, `{entity}` string, version long, first_ord int, last_ord int, n_snapshots long, {text}",
    )


def symbol_payload(symbols: DataFrame) -> DataFrame:
    """Signature with even white space and visibility in lower case, per symbol row."""
    return symbols.select(
        "repo_id",
        "commit_sha",
        "stable_id",
        squeeze(F.col("signature")).alias("signature"),
        fold(F.col("visibility")).alias("visibility"),
    )


def _symbol_versions(symbols: DataFrame, snapshots: DataFrame) -> DataFrame:
    return versions(symbol_payload(symbols), snapshots, "stable_id", ["signature", "visibility"])


def symbol_versions(symbols: DataFrame, snapshots: DataFrame) -> DataFrame:
    """First snapshot of each version of each stable id: ``repo_id, stable_id, valid_from_sha``."""
    start = snapshots.select("repo_id", F.col("ord").alias("first_ord"), F.col("commit_sha").alias("valid_from_sha"))
    return _symbol_versions(symbols, snapshots).join(start, ["repo_id", "first_ord"]).select("repo_id", "stable_id", "valid_from_sha")


def symbol_history(symbols: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every version with its period: from created_at of its first snapshot until created_at of
    the first later snapshot that no longer has it (null while it is current).

    Output: ``repo_id, stable_id, version, signature, visibility, valid_from, valid_to,
    valid_from_sha, n_snapshots``. An empty table gives no rows.
    """
    start = snapshots.select(
        "repo_id",
        F.col("ord").alias("first_ord"),
        F.col("created_at").alias("valid_from"),
        F.col("commit_sha").alias("valid_from_sha"),
    )
    stop = snapshots.select(
        "repo_id", (F.col("ord") - 1).alias("last_ord"), F.col("created_at").alias("valid_to")
    )
    return (
        _symbol_versions(symbols, snapshots)
        .join(start, ["repo_id", "first_ord"])
        .join(stop, ["repo_id", "last_ord"], "left")
        .select(
            "repo_id", "stable_id", "version", "signature", "visibility", "valid_from", "valid_to", "valid_from_sha", "n_snapshots"
        )
    )
