"""What changed between consecutive full snapshots, by invertible Bloom lookup tables.

Each snapshot's records fall into hash buckets of about ``BUCKET_ROWS`` records; a bucket is
an invertible Bloom lookup table of cells holding a count and XORs of key words, payload
codes and check codes. Tables of consecutive snapshots are subtracted cell by cell: equal
records cancel and the cells left over hold the differences. Peeling them gives the differing
(key, payload) pairs; keys of up to 32 bytes come out themselves, longer ones as their SHA-256,
which only the few that differ are decoded from. Buckets that cannot be peeled are built again
with ``GROWTH`` times the cells and other hash functions until none is left: two records that
share all their cells can block a table of any size, so it is the fresh functions of each round
that end the loop, with probability 1 and with the exact result. The sizes of cells and buckets
are fixed: neither a hot repository nor a large change makes an unbounded group.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.functions.text import fold, squeeze
from symlake.session import cut, cut_with

#: Hash functions of a table, records aimed at per bucket, cells per hash function at first,
#: and the growth of a failed bucket's cells.
HASHES, BUCKET_ROWS, CELLS, GROWTH = 3, 4_096, 128, 4
#: 64-bit words of a key in a cell, and the length that marks the words as a SHA-256.
WORDS, DIGEST = 4, -1


def _words(key: Column) -> list[Column]:
    """The key's length and its bytes as words padded with zeros; of a longer key its digest."""
    long_ = F.octet_length(key) > 8 * WORDS
    digits = F.when(long_, F.sha2(key, 256)).otherwise(F.rpad(F.hex(F.encode(key, "UTF-8")), 16 * WORDS, "0"))
    words = [F.conv(F.substring(digits, 16 * i + 1, 16), 16, -10).cast("long") for i in range(WORDS)]
    return [F.when(long_, DIGEST).otherwise(F.octet_length(key)).cast("long"), *words]


def _key_of(length: int, words: tuple[int, ...]) -> tuple[str, bool]:
    """The key that words stand for and whether it is a digest."""
    raw = b"".join(struct.pack(">q", w) for w in words)
    return (raw.hex(), True) if length == DIGEST else (raw[:length].decode("utf-8"), False)


def _mix(seed: int, values: tuple[int, ...]) -> int:
    """The engine's xxhash64 over 64-bit columns, carried on from ``seed``."""
    h = seed
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h


def _signed64(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


@lru_cache(maxsize=64)
def _starts(turn: int) -> list[int]:
    """xxhash64(int i) of the engine, the start of each hash function's chain in a round."""
    return [xxhash.xxh64_intdigest(struct.pack("<i", HASHES * turn + i), 42) for i in range(HASHES)]


def _spots(record: tuple[int, ...], cells: int, turn: int = 0) -> list[int]:
    return [i * cells + _signed64(_mix(s, record)) % cells for i, s in enumerate(_starts(turn))]


def peel(cells: pd.DataFrame, n_cells: int, turn: int = 0) -> tuple[list[tuple[int, tuple[int, ...]]], bool]:
    """Peels one subtracted table: the signed records, and whether every cell came out empty.

    ``cells`` has cell, count, the record's words and check. The digest of each peeled cell
    is verified against its record before it counts.
    """
    names = [c for c in cells.columns if c not in ("cell", "count", "check")]
    table = {
        row[0]: list(row[1:]) for row in cells[["cell", "count", *names, "check"]].itertuples(index=False, name=None)
    }
    out: list[tuple[int, tuple[int, ...]]] = []
    queue = [c for c, v in table.items() if v[0] in (1, -1)]
    while queue:
        v = table.get(queue.pop())
        if v is None or v[0] not in (1, -1):
            continue
        sign, record, check = v[0], tuple(v[1:-1]), v[-1]
        if _signed64(_mix(42, record)) != check:
            continue
        out.append((sign, record))
        for s in _spots(record, n_cells, turn):
            w = table.setdefault(s, [0] * len(v))
            w[0] -= sign
            for i, x in enumerate(record, 1):
                w[i] ^= x
            w[-1] ^= check
            if w[0] in (1, -1):
                queue.append(s)
            elif not any(w):
                del table[s]
    return out, not table


FOUND = "repo_id string, ord int, bucket long, record_key string, digest boolean, change_kind string"
KINDS = {1: "added", 2: "removed", 3: "changed"}


def _classify(frame: pd.DataFrame) -> pd.DataFrame:
    """Changes of one bucket between two snapshots; one row of kind ``failed`` if not peeled."""
    repo, order, bucket, n_cells, turn = (frame[c].iloc[0] for c in ("repo_id", "ord", "bucket", "cells", "turn"))
    found, whole = peel(frame.drop(columns=["repo_id", "ord", "bucket", "cells", "turn"]), int(n_cells), int(turn))
    if whole:
        signs: dict[tuple[int, ...], int] = {}
        for sign, record in found:
            signs[record[:-1]] = signs.get(record[:-1], 0) | (1 if sign > 0 else 2)
        rows = [(repo, order, bucket, *_key_of(k[0], k[1:]), KINDS[s]) for k, s in signs.items()]
    else:
        rows = [(repo, order, bucket, "", False, "failed")]
    return pd.DataFrame(rows, columns=["repo_id", "ord", "bucket", "record_key", "digest", "change_kind"])


def _round(records: DataFrame, cells: int, turn: int) -> DataFrame:
    """One pass over (repo_id, ord, last_ord, bucket, key, pay) records.

    The records are moved once, to their bucket; the sums of cells, the subtraction and the
    peeling all stay in that partitioning.
    """
    names = ["w_len", *(f"w{i}" for i in range(WORDS)), "pay"]
    rows = records.select(
        "repo_id", "ord", "last_ord", "bucket", *(w.alias(n) for w, n in zip(_words(F.col("key")), names)), "pay"
    ).repartition("repo_id", "bucket")
    spots = F.array(
        *(F.lit(i * cells) + F.pmod(F.xxhash64(F.lit(HASHES * turn + i), *names), F.lit(cells)) for i in range(HASHES))
    )
    xors = [F.bit_xor(n).alias(n) for n in [*names, "check"]]
    place = ["repo_id", "bucket"]
    of_snapshot = (
        rows.withColumn("check", F.xxhash64(*names))
        .withColumn("cell", F.explode(spots))
        .groupBy(*place, "ord", "last_ord", "cell")
        .agg(F.count("*").alias("count"), *xors)
    )
    #: +1 in the pair that ends with the snapshot, -1 in the pair that starts with it
    sides = F.array(
        F.struct(F.col("ord").alias("pair"), F.lit(1).alias("sign")),
        F.struct((F.col("ord") + 1).alias("pair"), F.lit(-1).alias("sign")),
    )
    pairs = (
        of_snapshot.withColumn("side", F.explode(sides))
        .where("side.pair > 1 and side.pair <= last_ord")
        .groupBy(*place, F.col("side.pair").alias("ord"), "cell")
        .agg(F.sum(F.col("count") * F.col("side.sign")).alias("count"), *xors)
        .where(" or ".join(f"{n} <> 0" for n in ["count", *names, "check"]))
        .withColumn("cells", F.lit(cells).cast("long"))
        .withColumn("turn", F.lit(turn))
    )
    return pairs.groupBy(*place, "ord").applyInPandas(_classify, FOUND)


def snapshot_changes(rows: DataFrame, snapshots: DataFrame, cells: int = CELLS) -> DataFrame:
    """Changes between consecutive snapshots: ``repo_id, commit_sha, record_key, change_kind``.

    ``rows`` has repo_id, commit_sha, key and payload (a string or null; null is a value of
    its own). ``commit_sha`` of the result is the later snapshot's; the first one gives no
    rows, snapshots that have no rows of this table count as empty. Rows with a null key or
    of no known snapshot are left out; repeated rows count once, of conflicting ones the one
    with the least payload code. Keys may have any length.

    The rows are scanned once: they are folded by (repository, snapshot, key) with map-side
    combine, payloads already as codes, so that copies of a row do not meet in one task, and
    written out; sizes, rounds and long keys are read from that table.
    """
    #: snapshot counts per repository: one row each, joined by whatever way its size allows
    last = snapshots.groupBy("repo_id").agg(F.max("ord").alias("last_ord"))
    known = snapshots.join(last, "repo_id").select("repo_id", "commit_sha", "ord", "last_ord")
    folded, seen = cut_with(
        rows.where(F.col("key").isNotNull())
        .select(
            "repo_id", "commit_sha", "key", F.xxhash64(F.col("payload").isNull(), F.coalesce("payload", F.lit(""))).alias("pay")
        )
        .join(known, ["repo_id", "commit_sha"])
        .groupBy("repo_id", "ord", "last_ord", "key")
        .agg(F.min("pay").alias("pay")),
        longest=F.max(F.octet_length("key")),
    )
    sizes = folded.groupBy("repo_id", "ord").agg(F.count("*").alias("n"))
    shape = sizes.groupBy("repo_id").agg(F.ceil(F.max("n") / BUCKET_ROWS).alias("buckets"))
    placed = folded.join(shape, "repo_id").withColumn("bucket", F.pmod(F.xxhash64("key"), F.col("buckets"))).drop("buckets")
    found = cut(_round(placed, cells, 0))
    out = found.where("change_kind <> 'failed'")
    failed = found.where("change_kind = 'failed'").select("repo_id", "bucket", "ord")
    if not failed.isEmpty():
        ends = failed.union(failed.withColumn("ord", F.col("ord") - 1)).distinct()
        again = placed.join(ends, ["repo_id", "bucket", "ord"], "left_semi")
        for more in _retry(again, failed, cells):
            out = out.unionByName(more)
    if (seen["longest"] or 0) > 8 * WORDS:
        out = _decoded(out, folded)
    return out.join(snapshots.select("repo_id", "ord", "commit_sha"), ["repo_id", "ord"]).select(
        "repo_id", "commit_sha", "record_key", "change_kind"
    )


def _decoded(found: DataFrame, folded: DataFrame) -> DataFrame:
    """``found`` with the keys themselves where it has digests."""
    long_ = folded.where(F.octet_length("key") > 8 * WORDS).select(
        "repo_id", F.sha2("key", 256).alias("record_key"), F.lit(True).alias("digest"), "key"
    )
    sought = found.where("digest").select("repo_id", "record_key").distinct()
    names = long_.join(sought, ["repo_id", "record_key"], "left_semi").distinct()
    return found.join(names, ["repo_id", "record_key", "digest"], "left").withColumn(
        "record_key", F.coalesce("key", "record_key")
    ).drop("key")


def _retry(todo: DataFrame, pairs: DataFrame, n_cells: int) -> list[DataFrame]:
    """Rounds over the failed pairs only, with growing tables and fresh hashes, until none fails."""
    done = []
    todo = cut(todo)
    turn = 0
    while True:
        n_cells, turn = n_cells * GROWTH, turn + 1
        found = cut(_round(todo, n_cells, turn).join(pairs, ["repo_id", "bucket", "ord"], "left_semi"))
        done.append(found.where("change_kind <> 'failed'"))
        pairs = found.where("change_kind = 'failed'").select("repo_id", "bucket", "ord")
        if pairs.isEmpty():
            return done


def symbol_and_file_changes(symbols: DataFrame, files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Changes of symbols and files: ``repo_id, commit_sha, entity, record_key, change_kind``.

    One pass per table: together they would share buckets, of which more would then fail.
    """
    of_symbols = snapshot_changes(
        symbols.select(
            "repo_id", "commit_sha", F.col("stable_id").alias("key"), squeeze(F.col("signature")).alias("payload")
        ),
        snapshots,
    )
    of_files = snapshot_changes(
        files.select("repo_id", "commit_sha", F.col("file_id").alias("key"), fold(F.col("sha256")).alias("payload")),
        snapshots,
    )
    cols = ["repo_id", "commit_sha", "entity", "record_key", "change_kind"]
    return (
        of_symbols.withColumn("entity", F.lit("symbol"))
        .select(cols)
        .unionByName(of_files.withColumn("entity", F.lit("file")).select(cols))
    )
