"""Parent-child links to full hierarchies.

Connected components are found on 64-bit node codes by the alternating large-star and
small-star steps, each a join and an aggregation on node codes with map-side combine.
Components of at most ``LIMIT`` nodes are then co-located, sorted and walked one after
another by an iterative depth-first traversal with node colouring, which keeps a parent
pointer per node and spells out paths and descendants only as it hands them on. Larger
components, which no task may hold, are resolved by pointer doubling over the whole cluster
instead; both ways give the same rows. Node codes only place rows together, so that two ids
sharing a code do no harm: the traversal compares the ids themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.functions.text import definition_id, fold, strip_global, type_id_of
from symlake.session import cut, cut_with

#: Nodes of the largest component that one task walks.
LIMIT = 200_000

#: Kinds of symbols that are types.
TYPE_KINDS = ["class", "struct", "interface", "record", "enum"]

#: Ids in the rows that a task gathers before it hands them on.
BATCH_IDS = 200_000

FULL = (
    "group string, node string, root string, depth int, path array<string>, "
    "n_descendants long, on_cycle boolean, listed boolean"
)
ROOTS = "group string, node string, root string, listed boolean"
PAIRS = "group string, ancestor string, descendant string, distance int"
CYCLES = "group string, from_node string, to_node string, n_nodes int"


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` of longs: ``node, comp``.

    ``comp`` is the least node of the component. Loops are kept as single nodes. Ends when a
    round changes nothing, after a number of rounds that grows as the logarithm of the longest
    chain.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    digest = {"n": F.count("*"), "x": F.bit_xor(F.xxhash64("u", "v")), "y": F.sum(F.hash("u", "v").cast("long"))}
    pairs, before = cut_with(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), **digest
    )
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u and v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        pairs, after = cut_with(small, **digest)
        if after == before:
            break
        before = after
    return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node", "left").select(
        "node", F.coalesce("comp", "node").alias("comp")
    )


@dataclass
class Forest:
    """One set of links, traversed: a parent pointer, root, depth and count per node.

    ``up`` of a cycle's members other than its least id is that id, of the least id None, so
    that it is a tree; ``order`` lists parents before their children; ``rings`` has the members
    of each cycle by its least id.
    """

    up: dict[str, str | None] = field(default_factory=dict)
    root: dict[str, str] = field(default_factory=dict)
    depth: dict[str, int] = field(default_factory=dict)
    below: dict[str, int] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)
    rings: dict[str, list[str]] = field(default_factory=dict)
    own: set[str] = field(default_factory=set)
    parent: dict[str, str | None] = field(default_factory=dict)

    def path(self, node: str) -> list[str]:
        """Ids from the root to ``node``."""
        out = [node]
        while (above := self.up[out[-1]]) is not None:
            out.append(above)
        return out[::-1]


def traverse(links: list[tuple[str, str | None]]) -> Forest:
    """Depth-first traversal of ``(node, parent or None)`` links, without recursion.

    White nodes are unseen, grey ones on the way, black ones done; meeting a grey node again is
    a back edge, whose chain is a cycle with its least id as the root. Of several parents of a
    node the least id counts. Memory is a few pointers per node, however deep the trees.
    """
    out = Forest()
    parent = out.parent
    for node, up in links:
        out.own.add(node)
        if up is not None and (parent.get(node) is None or up < parent[node]):
            parent[node] = up
        else:
            parent.setdefault(node, None)
        if up is not None:
            parent.setdefault(up, None)
    white, grey, black = 0, 1, 2
    colour = dict.fromkeys(parent, white)
    ring_of: dict[str, str] = {}
    for start in parent:
        chain, at = [], start
        while at is not None and colour[at] == white:
            colour[at] = grey
            chain.append(at)
            at = parent[at]
        if at is not None and colour[at] == grey:
            ring = chain[chain.index(at) :]
            least = min(ring)
            out.rings[least] = ring
            ring_of.update(dict.fromkeys(ring, least))
        for done in chain:
            colour[done] = black
    children: dict[str, list[str]] = {}
    tops = []
    for node, up in parent.items():
        least = ring_of.get(node)
        above = up if least is None else (least if node != least else None)
        out.up[node] = above
        if above is None:
            tops.append(node)
        else:
            children.setdefault(above, []).append(node)
    for top in tops:
        out.root[top], out.depth[top] = top, 0
        stack = [top]
        while stack:
            node = stack.pop()
            out.order.append(node)
            for child in children.get(node, ()):
                out.root[child], out.depth[child] = top, out.depth[node] + 1
                stack.append(child)
    out.below = dict.fromkeys(parent, 0)
    for node in reversed(out.order):
        if out.up[node] is not None:
            out.below[out.up[node]] += out.below[node] + 1
    #: nodes on a cycle are each other's descendants
    for least, ring in out.rings.items():
        for node in ring:
            out.below[node] = out.below[least]
    return out


def full_rows(f: Forest) -> Iterator[tuple]:
    """``(node, root, depth, path, n_descendants, on_cycle, listed)`` of every node."""
    ringed = {n for ring in f.rings.values() for n in ring}
    for node in f.order:
        yield node, f.root[node], f.depth[node], f.path(node), f.below[node], node in ringed, node in f.own


def root_rows(f: Forest) -> Iterator[tuple]:
    """``(node, root, listed)`` of every node."""
    for node in f.order:
        yield node, f.root[node], node in f.own


def pair_rows(f: Forest) -> Iterator[tuple]:
    """``(ancestor, descendant, distance)`` of every node and all it descends from; members of a
    cycle are one step from each other."""
    ringed = {n: least for least, ring in f.rings.items() for n in ring}
    for node in f.order:
        at, distance = node, 0
        while at not in ringed and f.up[at] is not None:
            at, distance = f.up[at], distance + 1
            yield at, node, distance
        for member in f.rings.get(ringed.get(at), ()):
            if member != at:
                yield member, node, distance + 1


def cycle_rows(f: Forest) -> Iterator[tuple]:
    """``(from_node, to_node, n_nodes)`` of the back edge of every cycle: the link that leads back
    to its least id."""
    for least, ring in f.rings.items():
        for node in ring:
            if f.parent[node] == least:
                yield node, least, len(ring)


def walk(links: list[tuple[str, str | None]]) -> list[tuple]:
    """``(node, root, depth, path, n_descendants, on_cycle)`` of every node of one set of links."""
    return [r[:-1] for r in full_rows(traverse(links))]


def _walker(rows: Callable[[Forest], Iterator[tuple]], schema: str) -> Callable:
    """Walks the components of a partition sorted by (group, comp), each when it is complete."""
    names = [c.split()[0] for c in schema.split(", ")]
    at_path = names.index("path") - 1 if "path" in names else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, links, held, ids = None, [], [], 0

        def component() -> Iterator[pd.DataFrame]:
            nonlocal held, ids
            if not links:
                return
            for row in rows(traverse(links)):
                held.append((key[0], *row))
                ids += 1 if at_path is None else 1 + len(row[at_path])
                if ids >= BATCH_IDS:
                    yield pd.DataFrame(held, columns=names)
                    held, ids = [], 0
            links.clear()

        for batch in batches:
            for group, comp, node, up in batch.itertuples(index=False, name=None):
                if (group, comp) != key:
                    yield from component()
                    key = (group, comp)
                links.append((node, up))
        yield from component()
        if held:
            yield pd.DataFrame(held, columns=names)

    return run


def _climb(state: DataFrame, join_more: dict, rounds: int) -> DataFrame:
    """Pointer doubling: every node's ``up`` becomes its up's up, until none is left or for
    ``rounds`` rounds. ``join_more`` maps a column to how it merges with the up's."""
    for _ in range(rounds):
        if state.where("up is not null").isEmpty():
            break
        nxt = state.select(
            "group", F.col("node").alias("up"), F.col("up").alias("up2"), *(F.col(c).alias(f"{c}2") for c in join_more)
        )
        grown = state.join(nxt, ["group", "up"], "left")
        state = cut(
            grown.select("group", "node", F.col("up2").alias("up"), *(f(c, f"{c}2").alias(c) for c, f in join_more.items()))
        )
    return state


def _as_forest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(group, node, up, listed)`` of the links without their cycles, and the members of these as
    ``(group, node, ring)``: for components no task can hold.

    After as many steps as there are nodes every pointer that found no top is on a cycle, and
    every cycle member is pointed to; the least id met on the way is the cycle's, below which
    its other members are hung.
    """
    one = links.groupBy("group", "node").agg(F.min("parent").alias("parent")).withColumn("listed", F.lit(True))
    tops = (
        one.where("parent is not null")
        .select("group", F.col("parent").alias("node"))
        .join(one, ["group", "node"], "left_anti")
        .distinct()
        .withColumn("parent", F.lit(None).cast("string"))
        .withColumn("listed", F.lit(False))
    )
    base = cut(one.unionByName(tops))
    pointers = base.select("group", "node", F.col("parent").alias("up"), F.col("node").alias("least"))
    ended = _climb(pointers, {"least": lambda a, b: F.least(a, b)}, base.count().bit_length() + 1)
    met = ended.where("up is not null").select("group", F.col("up").alias("node")).distinct()
    ring = cut(ended.join(met, ["group", "node"], "left_semi").select("group", "node", F.col("least").alias("ring")))
    hung = F.when(F.col("ring").isNull(), F.col("parent")).when(F.col("ring") != F.col("node"), F.col("ring"))
    forest = base.join(ring, ["group", "node"], "left").select("group", "node", hung.alias("up"), "listed")
    return cut(forest), ring


def _double_roots(links: DataFrame) -> DataFrame:
    """Rows of :func:`root_rows` by pointer doubling: one id per node and round."""
    forest, _ = _as_forest(links)
    start = forest.select("group", "node", "up", F.col("up").alias("last"))
    ended = _climb(start, {"last": lambda a, b: F.coalesce(F.col(b), F.col(a))}, 64)
    return ended.join(forest.select("group", "node", "listed"), ["group", "node"]).select(
        "group", "node", F.coalesce("last", "node").alias("root"), "listed"
    )


def _double(links: DataFrame) -> DataFrame:
    """Rows of :func:`full_rows` by pointer doubling: paths double until all have met their root."""
    forest, ring = _as_forest(links)
    none = F.array().cast("array<string>")
    start = forest.select("group", "node", "up", F.array_compact(F.array("up")).alias("above"))
    full = _climb(start, {"above": lambda a, b: F.concat(a, F.coalesce(F.col(b), none))}, 64)
    paths = cut(full.select("group", "node", F.concat(F.reverse("above"), F.array("node")).alias("path")))
    below = (
        paths.select("group", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("node"))
        .groupBy("group", "node")
        .agg(F.count("*").alias("n"))
    )
    counted = (
        paths.join(below, ["group", "node"], "left")
        .join(ring, ["group", "node"], "left")
        .join(forest.select("group", "node", "listed"), ["group", "node"])
    )
    of_ring = below.select("group", F.col("node").alias("ring"), F.col("n").alias("ring_n"))
    return counted.join(of_ring, ["group", "ring"], "left").select(
        "group",
        "node",
        F.col("path")[0].alias("root"),
        (F.size("path") - 1).alias("depth"),
        "path",
        F.coalesce("ring_n", "n", F.lit(0)).cast("long").alias("n_descendants"),
        F.col("ring").isNotNull().alias("on_cycle"),
        "listed",
    )


def _double_cycles(links: DataFrame) -> DataFrame:
    """Rows of :func:`cycle_rows` by pointer doubling."""
    _, ring = _as_forest(links)
    back = links.groupBy("group", "node").agg(F.min("parent").alias("ring"))
    size = ring.groupBy("group", "ring").agg(F.count("*").cast("int").alias("n_nodes"))
    return (
        ring.join(back, ["group", "node", "ring"])
        .join(size, ["group", "ring"])
        .select("group", F.col("node").alias("from_node"), F.col("ring").alias("to_node"), "n_nodes")
    )


def _clean(links: DataFrame) -> DataFrame:
    return links.where(F.col("node").isNotNull()).select(
        "group", "node", F.when(F.trim("parent") != "", F.col("parent")).alias("parent")
    )


def _by_component(links: DataFrame, limit: int, rows: Callable, schema: str, doubled: Callable) -> DataFrame:
    """Rows of every component: walked up to ``limit`` nodes, by ``doubled`` beyond."""
    links = cut(
        _clean(links)
        .groupBy("group", "node")
        .agg(F.min("parent").alias("parent"))
        .withColumn("a", F.xxhash64("group", "node"))
        .withColumn("b", F.xxhash64("group", F.coalesce("parent", "node")))
    )
    comp = cut(components(links.select("a", "b")))
    big = cut(comp.groupBy("comp").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("comp"))
    placed = links.join(comp.withColumnRenamed("node", "a"), "a")
    walked = (
        placed.join(big, "comp", "left_anti")
        .select("group", "comp", "node", "parent")
        .repartition("comp")
        .sortWithinPartitions("group", "comp", "node")
        .mapInPandas(_walker(rows, schema), schema)
    )
    if big.isEmpty():
        return walked
    return walked.unionByName(doubled(placed.join(big, "comp", "left_semi").select("group", "node", "parent")))


def hierarchies(links: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Full hierarchies of ``links(group, node, parent)``, one row per node of a group.

    Output: ``group, node, root, depth, path, n_descendants, on_cycle, listed``; parents that
    are no nodes themselves come out as roots that are not ``listed``. ``path`` runs from the
    root to the node. A node on or below a cycle has the cycle's least id as its root, and
    ``path`` leads from it through the cycle member it hangs on; nodes on a cycle are each
    other's descendants. Rows with a null node are left out, a null or blank parent means none,
    a node that is its own parent is a cycle of one, and of several parents the least id
    counts; :func:`other_parents` has the rest.
    """
    return _by_component(links, limit, full_rows, FULL, _double)


def roots(links: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``group, node, root, listed`` of :func:`hierarchies`, without spelling out any path."""
    return _by_component(links, limit, root_rows, ROOTS, _double_roots)


def all_descendants(links: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All descendants of every node, in and below cycles too: ``group, ancestor, descendant,
    distance``; as many rows of a node as ``n_descendants`` of :func:`hierarchies` says."""
    return _by_component(links, limit, pair_rows, PAIRS, lambda big: descendants(_double(big)))


def cycles(links: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The back edge of every cycle: ``group, from_node, to_node, n_nodes``; ``to_node`` is the
    least id of the cycle and the parent of ``from_node``."""
    return _by_component(links, limit, cycle_rows, CYCLES, _double_cycles)


def other_parents(links: DataFrame) -> DataFrame:
    """Links that hierarchies do not follow, as the node has a parent of a lesser id: ``group,
    node, parent``, each once."""
    each = _clean(links).where("parent is not null").distinct()
    least = each.groupBy("group", "node").agg(F.min("parent").alias("least"))
    return each.join(least, ["group", "node"]).where("parent <> least").drop("least")


def type_links(type_relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Links of both hierarchies, ``group`` being ``base`` or ``containment``, plus ``listed``.

    The parent of a nested type is the type with that full name in its repository, else the id
    that the name would have. ``listed`` marks the types a query reports (not mere parents).
    """
    base = type_relations.where(fold(F.col("relation_kind")) == "basetype").select(
        F.lit("base").alias("group"),
        F.col("type_symbol_id").alias("node"),
        definition_id(F.col("related_symbol_id")).alias("parent"),
    )
    types = symbols.where(fold(F.col("kind")).isin(TYPE_KINDS))
    nested = (
        types.select("repo_id", "symbol_id", strip_global(F.col("containing_type")).alias("fqname"))
        .where("fqname is not null")
        .distinct()
    )
    names = types.groupBy("repo_id", strip_global(F.col("fqname")).alias("fqname")).agg(
        F.min("symbol_id").alias("parent")
    )
    held = nested.join(names, ["repo_id", "fqname"], "left").select(
        F.lit("containment").alias("group"),
        F.col("symbol_id").alias("node"),
        F.coalesce("parent", type_id_of(F.col("fqname"))).alias("parent"),
    )
    return base.unionByName(held)


def type_hierarchies(type_relations: DataFrame, symbols: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows of :func:`hierarchies` for the types of both hierarchies; ``listed`` are those that
    have a parent row of their own."""
    return hierarchies(type_links(type_relations, symbols), limit)


def type_roots(type_relations: DataFrame, symbols: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``hierarchy, symbol_id, root_id`` of every listed type, each once; ids in definition form."""
    return roots(type_links(type_relations, symbols), limit).where("listed").select(
        F.col("group").alias("hierarchy"), F.col("node").alias("symbol_id"), F.col("root").alias("root_id")
    )


def descendants(full: DataFrame) -> DataFrame:
    """All descendants of every node: ``group, ancestor, descendant, distance``.

    A node has as many rows as ``n_descendants`` says. They are read off the paths; a member of
    a cycle also gets its fellow members and what hangs below them, which its own path does not
    lead to. Members of a cycle are one step from each other, as in :func:`hierarchies`.
    """
    full = cut(full.select("group", "node", "root", "depth", "path", "on_cycle"))
    on_path = full.select(
        "group",
        F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("pos", "ancestor"),
        F.col("node").alias("descendant"),
        "depth",
    ).select("group", "ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
    #: the least id of a cycle is on all paths of it already
    members = cut(full.where("on_cycle and node <> root").select("group", "root", F.col("node").alias("ancestor")))
    if members.isEmpty():
        return on_path
    hung = full.join(members.select("group", "root").distinct(), ["group", "root"], "left_semi").select(
        "group", "root", F.col("node").alias("descendant"), "depth", F.try_element_at("path", F.lit(2)).alias("ancestor")
    )
    #: the member that a node is or hangs on; null for the least id and what hangs on that
    known = members.select("group", "ancestor", F.lit(True).alias("by_member"))
    hung = hung.join(known, ["group", "ancestor"], "left").select(
        "group", "root", "descendant", "depth", F.when(F.col("by_member"), F.col("ancestor")).alias("member")
    )
    beside = (
        members.join(hung, ["group", "root"])
        .where(~F.col("member").eqNullSafe(F.col("ancestor")))
        .select("group", "ancestor", "descendant", F.when(F.col("member").isNull(), F.col("depth") + 1).otherwise(F.col("depth")).alias("distance"))
    )
    return on_path.unionByName(beside)
