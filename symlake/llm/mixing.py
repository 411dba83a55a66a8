"""Mixing sources to target weights by capped water-filling.

Sizes are tokens of a public tokenizer. A source that cannot fill its share even at its
largest number of repeats is clamped there, and what it leaves is spread over the others in
proportion to their shares, until nothing exceeds. Allocations are met by whole repeats of
every document and one more of a seeded part, cut where the running sum of tokens comes
nearest to what is left, so a source misses by half a document at most: the sums run over
65,536 hash ranges per source first and over one range's rows after that, so that no task
orders a source as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlake.llm.bpe import VOCABULARY, token_counts
from symlake.session import cut

#: Hash ranges of each source.
RANGES = 65_536
#: Sources of a mix at most: their plan is made on the driver and broadcast.
MAX_TARGETS = 10_000
#: As a total: all tokens of the listed sources.
AVAILABLE = "available"


def water_fill(shares: dict[str, float], caps: dict[str, float], total: float | None = None) -> dict[str, float]:
    """Tokens per source: ``total`` times its share, clamped at ``caps``, the rest spread.

    Without ``total``, the largest total at which no source with a cap is clamped, so that
    shares are met exactly. Shares are scaled to sum to 1 over the sources with a cap above 0;
    the others get 0. A total above all caps together gives every source its cap.
    """
    live = {s: w for s, w in shares.items() if w > 0 and caps.get(s, 0) > 0}
    out = dict.fromkeys(shares, 0.0)
    if not live:
        return out
    if total is None:
        weight = sum(live.values())
        total = min(caps[s] * weight / w for s, w in live.items())
    left, open_ = float(total), dict(live)
    while open_ and left > 0:
        weight = sum(open_.values())
        over = [s for s, w in open_.items() if left * w / weight > caps[s]]
        if not over:
            for s, w in open_.items():
                out[s] = left * w / weight
            break
        for s in over:
            out[s] = float(caps[s])
            del open_[s]
        left = total - sum(out.values())
    return out


def sizes(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of the documents of listed sources: ``doc_id, source, n_tokens``, written out.

    Other and null sources do not belong and are left out before they are encoded; so are null
    and empty texts after it, which add nothing.
    """
    listed = targets.select("source").where("source is not null").distinct()
    mine = docs.join(listed, "source", "left_semi").select("doc_id", "source", "text")
    return cut(token_counts(mine, "text", vocabulary).where("n_tokens > 0"))


def plan(sized: DataFrame, targets: DataFrame, total: float | str | None = None) -> list[dict]:
    """Allocation per listed source, from sums per source (as many rows as targets).

    More than ``MAX_TARGETS`` sources raise, as the plan is made on the driver.
    """
    if targets.limit(MAX_TARGETS + 1).count() > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    have = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    goal = {}
    for r in targets.where("source is not null").orderBy("source").collect():
        if r["source"] in goal:
            raise ValueError(f"source {r['source']} is listed twice")
        goal[r["source"]] = (r["target_share"] or 0.0, r["max_repeats"] or 0)
    caps = {s: have.get(s, 0) * most for s, (_, most) in goal.items()}
    if total == AVAILABLE:
        total = float(sum(have.get(s, 0) for s in goal))
    filled = water_fill({s: w for s, (w, _) in goal.items()}, caps, total)
    rows = []
    for s, (share, most) in goal.items():
        own = have.get(s, 0)
        whole = min(most, int(filled[s] // own)) if own else 0
        rest = int(round(filled[s] - whole * own)) if whole < most else 0
        rows.append(
            {"source": s, "target_share": share, "max_repeats": most, "available_tokens": own, "whole": whole, "rest": rest}
        )
    return rows


def mixture(
    docs: DataFrame,
    targets: DataFrame,
    total: float | str | None = None,
    seed: int = 7,
    vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """The mix and its shares.

    Mix: ``doc_id, source, n_tokens, repeats`` with ``1 <= repeats <= max_repeats``; repeated
    input rows are documents of their own. Shares, one row per target: ``source, target_share,
    max_repeats, available_tokens, mixed_tokens, n_docs, actual_share, total_tokens, left_out``:
    the tokens of the whole mix, and the share of the source's tokens that are not in it even
    once. ``total`` may be ``AVAILABLE``. Which documents are taken once more depends on seed and
    doc_id only.
    """
    sized = sizes(docs, targets, vocabulary)
    spark = docs.sparkSession
    rows = plan(sized, targets, total)
    schema = "source string, target_share double, max_repeats int, available_tokens long, whole int, rest long"
    goal = F.broadcast(
        spark.createDataFrame([tuple(r.values()) for r in rows], schema).coalesce(1)
    )
    u = F.xxhash64(F.lit(seed), "doc_id")
    placed = sized.withColumn("u", u).withColumn("range", F.shiftrightunsigned("u", 48).cast("int"))
    by_range = placed.groupBy("source", "range").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = by_range.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    #: one row per source: the range in which its running sum meets the rest
    edge = (
        ranges.join(goal.select("source", "rest"), "source")
        .where("before + n > rest")
        .groupBy("source")
        .agg(F.min(F.struct("range", "before")).alias("edge"))
        .select("source", F.col("edge.range").alias("edge_range"), F.col("edge.before").alias("edge_before"))
    )
    marked = placed.join(goal, "source").join(F.broadcast(edge), "source", "left")
    running = Window.partitionBy("source").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.where("range = edge_range").withColumn(
        "extra", (F.col("edge_before") + F.sum("n_tokens").over(running) - F.col("n_tokens") / 2 <= F.col("rest")).cast("int")
    )
    outside = marked.where("edge_range is null or range <> edge_range").withColumn(
        "extra",
        ((F.col("rest") > 0) & F.coalesce(F.col("range") < F.col("edge_range"), F.lit(True))).cast("int"),
    )
    mix = (
        inside.unionByName(outside)
        .withColumn("repeats", F.col("whole") + F.col("extra"))
        .where("repeats > 0")
        .select("doc_id", "source", "n_tokens", "repeats")
    )
    mixed = mix.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("used")
    )
    per = goal.join(mixed, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        "available_tokens",
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("used", F.lit(0)).alias("used"),
    )
    #: a window over as many rows as there are targets
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))
    shares = per.select(
        *(c for c in per.columns if c != "used"),
        F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0).alias("actual_share"),
        whole.alias("total_tokens"),
        F.when(F.col("available_tokens") > 0, 1 - F.col("used") / F.col("available_tokens")).otherwise(0.0).alias("left_out"),
    )
    return mix, shares
