"""Per-key results when a few keys hold most rows.

Heavy keys are found by a mergeable frequent-items sketch (``approx_top_k``), processed by
joins with broadcast tables bounded by the sketch, all other keys by ordinary shuffles; the
two parts are united. Every row counts: nothing is sampled or dropped.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlake.session import cut

#: Rows a heavy key's distinct peers are spread over before they are counted.
SALTS = 64
#: Rows of a table on the small side of a join up to which it is broadcast.
NEAR_ROWS = 100_000


def named(c: Column) -> Column:
    """The key, with empty strings (no symbol) as null."""
    return F.when(c != "", c)


def _sketch(key: str, min_share: float) -> Column:
    """The frequent-items sketch of a column as an aggregate. It tracks ten times as many items as
    can reach ``min_share``, so that its error is far below the share and no such key is missed."""
    if not 0 < min_share <= 1:
        raise ValueError("min_share must be in (0, 1]")
    k = ceil(1 / min_share)
    return F.expr(f"approx_top_k(`{key}`, {k}, {10 * k}) FILTER (WHERE `{key}` IS NOT NULL)")


def heavy_keys(df: DataFrame, keys: list[str], min_share: float) -> tuple[int, dict[str, list]]:
    """The number of rows and the candidate heavy keys of some columns, in one scan of ``df``.

    Of each column every key with at least ``min_share`` of all rows: a superset of at most
    ``ceil(1 / min_share)`` keys, whatever the input. Null keys are never heavy. An empty table
    gives no keys.
    """
    tops = {k: _sketch(k, min_share).alias(f"top_{k}") for k in keys}
    got = df.agg(F.count("*").alias("n"), *tops.values()).first()
    return got["n"], {k: [t["item"] for t in got[f"top_{k}"] or []] for k in keys}


def _listed(df: DataFrame, key: str, keys: list) -> DataFrame:
    """A list of :func:`heavy_keys` as a table to broadcast: at most ``ceil(1 / min_share)`` rows."""
    return F.broadcast(df.sparkSession.createDataFrame([(k,) for k in keys], df.select(key).schema))


def split_by_weight(df: DataFrame, key: str, keys: list) -> tuple[DataFrame, DataFrame]:
    """``(rows of heavy keys, all other rows)``; rows with a null key are others."""
    hot = _listed(df, key, keys)
    return df.join(hot, key, "left_semi"), df.join(hot, key, "left_anti")


def usage_by_key(df: DataFrame, key: str, peer: str, keys: list) -> DataFrame:
    """Per key its rows, distinct peers, first and last time, whatever the skew; ``keys`` are the
    heavy ones.

    Input columns: ``key``, ``peer`` and ``seen_at``; null keys give no row, null peers count
    as rows but not as peers. Output: ``key, n_rows, n_peers, first_seen, last_seen``. Heavy
    keys are aggregated in two levels, first by (key, salt of the peer), so that no task
    holds all rows or all peers of one of them.
    """
    df = df.where(F.col(key).isNotNull())
    heavy, rest = split_by_weight(df, key, keys)
    salted = heavy.withColumn("salt", F.pmod(F.xxhash64(peer), F.lit(SALTS)))
    level1 = salted.groupBy(key, "salt", peer).agg(
        F.count("*").alias("n_rows"),
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
    )
    level2 = level1.groupBy(key, "salt").agg(
        F.sum("n_rows").alias("n_rows"),
        F.count(peer).alias("n_peers"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    of_heavy = level2.groupBy(key).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_peers").alias("n_peers"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    of_rest = rest.groupBy(key).agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(peer).alias("n_peers"),
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
    )
    return of_heavy.unionByName(of_rest)


def join_by_weight(facts: DataFrame, dim: DataFrame, key: str, min_share: float = 0.005) -> DataFrame:
    """Left join of ``facts`` with ``dim``, without a task for a heavy key.

    Rows of heavy keys meet their ``dim`` rows by broadcast while these are at most
    ``NEAR_ROWS``; more of them (``dim`` with many rows of a key) are copied once per salt and
    meet a salted part of the rows each. All other rows, also those with a null key, are
    shuffled. Clashing column names: ``dim`` must share only the key.
    """
    _, heavy_of = heavy_keys(facts, [key], min_share)
    heavy, rest = split_by_weight(facts, key, heavy_of[key])
    near = cut(dim.join(_listed(facts, key, heavy_of[key]), key, "left_semi"))
    if near.count() <= NEAR_ROWS:
        met = heavy.join(F.broadcast(near), key, "left")
    else:
        copies = near.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        salted = heavy.withColumn("_salt", F.floor(F.rand(17) * SALTS).cast("int"))
        met = salted.join(copies, [key, "_salt"], "left").drop("_salt")
    return met.unionByName(rest.join(dim, key, "left"))


def dominant_symbols(refs: DataFrame, min_share: float = 0.02) -> DataFrame:
    """Symbols in at least ``min_share`` of all rows of ``refs``: ``side, symbol_id``.

    Sides are ``from`` and ``to``; all rows count in the total, also repeats and rows without
    a symbol; null and empty are not symbols. An empty table gives no rows. Two scans: one for
    the total and the sketches of both sides, one that counts the rows of the heavy keys by
    broadcast join, combined before they are moved. A key that no sketch names has less than
    half the share, so the ordinary keys add nothing to this union and are not shuffled;
    :func:`symbol_usage` has the rows of both parts.
    """
    rows = refs.select(*(named(F.col(f"{side}_symbol_id")).alias(side) for side in ("from", "to")))
    total, heavy = heavy_keys(rows, ["from", "to"], min_share / 2)
    hot = refs.sparkSession.createDataFrame([(s, k) for s, keys in heavy.items() for k in keys], "side string, symbol_id string")
    both = F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("symbol_id")) for s in heavy))
    counted = (
        rows.select(F.inline(both))
        .join(F.broadcast(hot), ["side", "symbol_id"], "left_semi")
        .groupBy("side", "symbol_id")
        .agg(F.count("*").alias("n_rows"))
    )
    return counted.where(F.col("n_rows") >= total * min_share).select("side", "symbol_id")


def symbol_usage(refs: DataFrame, symbols: DataFrame, min_share: float = 0.005) -> DataFrame:
    """Usage of every symbol on both sides of ``refs``, with its kind where it is indexed.

    Output: ``side, symbol_id, kind, n_rows, n_peers, first_seen, last_seen``.
    """
    kinds = symbols.groupBy("symbol_id").agg(F.min(F.lower(F.trim("kind"))).alias("kind"))
    named_ = {side: named(F.col(f"{side}_symbol_id")) for side in ("from", "to")}
    _, heavy = heavy_keys(refs.select(*(c.alias(s) for s, c in named_.items())), ["from", "to"], min_share)
    out = None
    for side, other in (("from", "to"), ("to", "from")):
        keyed = refs.select(named_[side].alias("symbol_id"), named_[other].alias("peer"), F.col("indexed_at").alias("seen_at"))
        part = usage_by_key(keyed, "symbol_id", "peer", heavy[side]).withColumn("side", F.lit(side))
        out = part if out is None else out.unionByName(part)
    return out.join(kinds, "symbol_id", "left").select(
        "side", "symbol_id", "kind", "n_rows", "n_peers", "first_seen", "last_seen"
    )


def reference_targets(refs: DataFrame, symbols: DataFrame, min_share: float = 0.005) -> DataFrame:
    """References counted by kind of reference and kind of the target symbol.

    Every row of ``refs`` meets its target's row (skewed on the target) through
    :func:`join_by_weight`. Output: ``ref_kind, target_kind, n_rows``; targets outside the
    index have a null kind.
    """
    kinds = symbols.groupBy("symbol_id").agg(F.min(F.lower(F.trim("kind"))).alias("target_kind"))
    rows = refs.select(named(F.col("to_symbol_id")).alias("symbol_id"), "ref_kind")
    joined = join_by_weight(rows, kinds, "symbol_id", min_share)
    return joined.groupBy("ref_kind", "target_kind").agg(F.count("*").alias("n_rows"))
