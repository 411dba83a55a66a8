"""Call graph traversal with budgets, for any number of roots in one job.

A level costs one join of the frontier with an adjacency table cut once to the neighbours a
node can ever contribute; hubs are cut map-side. Levels are written out, so a lost executor
re-reads the last level only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlake.session import cut
from symlake.sources.relations import KEY

#: Reference kinds that are calls, and the deepest traversal.
CALLS = ["Call", "Instantiate"]
MAX_DEPTH = 6


def _ends(callers: bool) -> tuple[str, str]:
    return ("to_symbol_id", "from_symbol_id") if callers else ("from_symbol_id", "to_symbol_id")


def adjacency(refs: DataFrame, limit: int, callers: bool = True) -> DataFrame:
    """Neighbours each node contributes: ``repo_id, commit_sha, node, other, place``.

    The first ``2 * (limit + 1)`` edges of any kind in edge order; of these the calls with
    another end, each neighbour once, the first ``limit + 1``.
    """
    mine, other = _ends(callers)
    edges = refs.where(F.col(mine).isNotNull()).select(
        *KEY, F.col(mine).alias("node"), F.col(other).alias("other"), "ref_kind", "edge_seq"
    )
    first = Window.partitionBy(*KEY, "node").orderBy("edge_seq")
    near = (
        edges.withColumn("r", F.row_number().over(first))
        .where(F.col("r") <= 2 * (limit + 1))
        .where(F.col("ref_kind").isin(CALLS) & F.col("other").isNotNull())
        .groupBy(*KEY, "node", "other")
        .agg(F.min("r").alias("r"))
    )
    order = Window.partitionBy(*KEY, "node").orderBy("r")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit + 1).drop("r")


def traverse(
    roots: DataFrame,
    refs: DataFrame,
    depth: int = 2,
    limit: int = 20,
    callers: bool = True,
    aliases: DataFrame | None = None,
    lookup: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first traversal from each root within its snapshot.

    ``roots`` has repo_id, commit_sha, root. Returns ``nodes(repo_id, commit_sha, root,
    symbol_id, depth, truncated)`` with the root at depth 0, and ``edges(repo_id, commit_sha,
    root, from_node, to_node, depth)``, the expansions of admitted nodes. A level admits at
    most ``limit`` new nodes per root in the order of their parents; more set ``truncated``;
    edges are recorded even to nodes seen before or not admitted. ``aliases`` (keys, root,
    symbol_id) are nodes whose neighbours count as the root's, such as the interface members
    a method stands for. The neighbours of all nodes are worked out once and written; with
    ``lookup``, for few roots, only those of each level's nodes are, from the references that
    meet them.
    """
    depth = max(0, min(depth, MAX_DEPTH))
    near = None if lookup else cut(adjacency(refs, limit, callers)).withColumnRenamed("node", "at")
    query = [*KEY, "root"]
    start = roots.select(*query).distinct()
    frontier = start.select(*query, F.col("root").alias("symbol_id"), F.lit(1).alias("place"))
    levels = [cut(frontier.withColumn("depth", F.lit(0)).withColumn("over", F.lit(False)))]
    edges = []
    for d in range(1, depth + 1):
        parents = levels[-1].select(*query, F.col("symbol_id").alias("at"), F.col("place").alias("parent_place"))
        if d == 1 and aliases is not None:
            other = Window.partitionBy(*query).orderBy("symbol_id")
            extra = aliases.join(start, query, "left_semi").select(
                *query, F.col("symbol_id").alias("at"), (F.row_number().over(other) + 1).alias("parent_place")
            )
            parents = parents.unionByName(extra)
        if lookup:
            sought = parents.select(*KEY, F.col("at").alias(_ends(callers)[0])).distinct()
            met = refs.join(sought, sought.columns, "left_semi")
            near = adjacency(met, limit, callers).withColumnRenamed("node", "at")
        expanded = parents.join(near, [*KEY, "at"])
        if d == 1 and aliases is not None:
            expanded = expanded.withColumn("at", F.col("root"))
        edges.append(
            expanded.select(*query, F.col("at").alias("from_node"), F.col("other").alias("to_node"), F.lit(d).alias("depth"))
        )
        seen = reduce(DataFrame.unionByName, levels).select(*query, F.col("symbol_id").alias("other"))
        fresh = (
            expanded.join(seen, [*query, "other"], "left_anti")
            .groupBy(*query, "other")
            .agg(F.min(F.struct("parent_place", "place")).alias("first"))
        )
        order = Window.partitionBy(*query).orderBy("first")
        ranked = fresh.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit + 1)
        more = ranked.withColumn("over", F.max("n").over(Window.partitionBy(*query)) > limit)
        level = more.where(F.col("n") <= limit).select(
            *query, F.col("other").alias("symbol_id"), F.col("n").alias("place"), F.lit(d).alias("depth"), "over"
        )
        #: the last level is read once only
        levels.append(cut(level) if d < depth else level)
    reached = reduce(DataFrame.unionByName, levels)
    cutoff = reached.groupBy(*query).agg(F.max("over").alias("truncated"))
    nodes = reached.select(*query, "symbol_id", "depth").join(cutoff, query)
    none = start.select(*query, F.lit("").alias("from_node"), F.lit("").alias("to_node"), F.lit(0).alias("depth"))
    return nodes, reduce(DataFrame.unionByName, edges, none.limit(0))


def hydrate(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nodes with kind, display name and span; unknown symbols count as methods."""
    cards = symbols.select(*KEY, "symbol_id", "kind", "fqname", "file_id", "span_start")
    return nodes.join(cards, [*KEY, "symbol_id"], "left").withColumn("kind", F.coalesce("kind", F.lit("method")))


def trace_feature(
    entries: DataFrame, refs: DataFrame, facts: DataFrame, depth: int = 3, limit: int = 100, lookup: bool = False
) -> DataFrame:
    """Call trees below entry points as pre-order rows: ``repo_id, commit_sha, root, path, depth,
    symbol_id, annotations``.

    ``path`` lists the symbols from the root; nodes of several parents repeat, cycles end at
    ``depth``. Annotations are the facts of the symbol, values cut at their first pipe.
    """
    nodes, edges = traverse(entries, refs, depth, limit, callers=False, lookup=lookup)
    query = [*KEY, "root"]
    known = nodes.select(*query, F.col("symbol_id").alias("to_node")).distinct()
    links = cut(edges.select(*query, "from_node", "to_node").distinct().join(known, [*query, "to_node"]))
    level = entries.select(*query).distinct().select(
        *query, F.col("root").alias("symbol_id"), F.array("root").alias("path"), F.lit(0).alias("depth")
    )
    rows = [level]
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        level = level.join(links.withColumnRenamed("from_node", "symbol_id"), [*query, "symbol_id"]).select(
            *query,
            F.col("to_node").alias("symbol_id"),
            F.concat("path", F.array("to_node")).alias("path"),
            F.lit(d).alias("depth"),
        )
        rows.append(level)
    notes = facts.groupBy(*KEY, "symbol_id").agg(
        F.array_join(
            F.array_sort(F.collect_set(F.concat("fact_kind", F.lit(":"), F.trim(F.substring_index("value", "|", 1))))), "; "
        ).alias("annotations")
    )
    tree = reduce(DataFrame.unionByName, rows)
    return tree.join(notes, [*KEY, "symbol_id"], "left").select(
        *query, F.array_join("path", " > ").alias("path"), "depth", "symbol_id", "annotations"
    )


def type_hierarchy(type_relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """One step up and down from every type of the relations: ``base_type, interfaces, derived``
    with ids joined in order."""
    rel = type_relations
    up = rel.groupBy(*KEY, F.col("type_symbol_id").alias("symbol_id")).agg(
        F.min(F.when(F.col("relation_kind") == "basetype", F.col("related_symbol_id"))).alias("base_type"),
        F.array_join(
            F.array_sort(F.collect_set(F.when(F.col("relation_kind") == "interface", F.col("related_symbol_id")))), ", "
        ).alias("interfaces"),
    )
    down = rel.groupBy(*KEY, F.col("related_symbol_id").alias("symbol_id")).agg(
        F.count_distinct("type_symbol_id").alias("n_derived")
    )
    types = symbols.where(F.col("kind").isin("class", "struct", "interface", "record", "enum", "delegate"))
    return (
        types.select(*KEY, "symbol_id")
        .join(up, [*KEY, "symbol_id"], "left")
        .join(down, [*KEY, "symbol_id"], "left")
        .where("base_type is not null or interfaces is not null or n_derived is not null")
        .select(*KEY, "symbol_id", "base_type", F.coalesce("interfaces", F.lit("")).alias("interfaces"), F.coalesce("n_derived", F.lit(0)).cast("long").alias("n_derived"))
    )


def derived_types(type_relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Types directly below each type: ``repo_id, commit_sha, symbol_id, derived_id, relation_kind,
    display_name``, one row each, so that no type's list is gathered; the name is the symbol's
    full name, else what the relation says of it, else the id's."""
    rows = type_relations.select(
        *KEY, F.col("related_symbol_id").alias("symbol_id"), F.col("type_symbol_id").alias("derived_id"), "relation_kind"
    ).distinct()
    names = symbols.select(*KEY, F.col("symbol_id").alias("derived_id"), "fqname")
    return rows.join(names, [*KEY, "derived_id"], "left").select(
        *KEY, "symbol_id", "derived_id", "relation_kind", F.coalesce("fqname", F.regexp_replace("derived_id", "^[A-Z]:", "")).alias("display_name")
    )


def has_edge(pairs: DataFrame, refs: DataFrame) -> DataFrame:
    """``pairs`` (keys, from_symbol_id, to_symbol_id) with ``has_edge``: any reference between them."""
    ends = [*KEY, "from_symbol_id", "to_symbol_id"]
    known = refs.join(pairs.select(*ends).distinct(), ends, "left_semi").select(*ends).distinct().withColumn("has_edge", F.lit(True))
    return pairs.join(known, ends, "left").withColumn("has_edge", F.coalesce("has_edge", F.lit(False)))


def interface_members(symbols: DataFrame, type_relations: DataFrame) -> DataFrame:
    """Members of interfaces that members of implementing types stand for: ``symbol_id,
    interface_member``.

    The id of a member with its type replaced by each interface of the type, where that id is
    a symbol of the snapshot: a chain of equality joins on computed ids.
    """
    owner = F.regexp_extract("symbol_id", r"^[A-Z]:(.*?)\.[^.(]+(?:\(.*)?$", 1)
    tail = F.regexp_extract("symbol_id", r"^[A-Z]:.*?(\.[^.(]+(?:\(.*)?)$", 1)
    members = symbols.where(F.col("symbol_id").rlike("^[MPE]:")).select(
        *KEY, "symbol_id", F.concat(F.lit("T:"), owner).alias("type_symbol_id"), F.substring("symbol_id", 1, 2).alias("kind"), tail.alias("tail")
    )
    faces = type_relations.where("relation_kind = 'interface'").select(*KEY, "type_symbol_id", "related_symbol_id")
    wanted = members.join(faces, [*KEY, "type_symbol_id"]).select(
        *KEY,
        "symbol_id",
        F.concat("kind", F.substring("related_symbol_id", 3, 1_000_000), "tail").alias("interface_member"),
    )
    have = symbols.select(*KEY, F.col("symbol_id").alias("interface_member"))
    return wanted.join(have, [*KEY, "interface_member"], "left_semi").select(*KEY, "symbol_id", "interface_member")
