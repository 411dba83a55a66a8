"""The general data problems on small cases, against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from symlake.functions.text import definition_id, squeeze, type_id_of
from symlake.operators import changes, history, orphans, skew, trees
from symlake.operators.snapshots import built_snapshots
from tests import helpers as h


# --- keys ------------------------------------------------------------------------------------


def test_dominant_symbols_counts_all_rows(spark):
    edges = [{"from_symbol_id": f"M:A{i}", "to_symbol_id": "M:Hub" if i % 3 == 0 else f"M:B{i}"} for i in range(300)]
    edges += [{"from_symbol_id": "M:Big", "to_symbol_id": ""}] * 30 + [{"from_symbol_id": None, "to_symbol_id": None}] * 30
    found = h.rows(skew.dominant_symbols(h.refs(spark, edges)))
    assert found == [("from", "M:Big"), ("to", "M:Hub")]


def test_dominant_symbols_at_the_border_and_empty(spark):
    edges = [{"from_symbol_id": f"M:{i % 50}", "to_symbol_id": None} for i in range(100)]
    assert len(h.rows(skew.dominant_symbols(h.refs(spark, edges)))) == 50
    assert h.rows(skew.dominant_symbols(h.refs(spark, []))) == []


def test_usage_is_complete_for_heavy_and_light_keys(spark):
    random.seed(1)
    data = [("hot" if random.random() < 0.5 else f"k{random.randrange(200)}", f"p{random.randrange(40)}") for _ in range(3000)]
    edges = [{"from_symbol_id": a, "to_symbol_id": b, "indexed_at": h.START} for a, b in data]
    edges += [{"from_symbol_id": "hot", "to_symbol_id": None, "indexed_at": None}]
    out = skew.symbol_usage(h.refs(spark, edges), h.symbols(spark, [{"symbol_id": "hot", "kind": " CLASS "}]))
    got = {r["symbol_id"]: r for r in out.where("side = 'from'").collect()}
    want, peers = Counter(a for a, _ in data), defaultdict(set)
    for a, b in data:
        peers[a].add(b)
    want["hot"] += 1
    assert {k: (r["n_rows"], r["n_peers"]) for k, r in got.items()} == {k: (n, len(peers[k])) for k, n in want.items()}
    assert got["hot"]["kind"] == "class" and got["k1"]["kind"] is None


def test_join_by_weight_keeps_every_row(spark):
    edges = h.refs(spark, [{"to_symbol_id": "x"}] * 40 + [{"to_symbol_id": f"y{i}"} for i in range(40)] + [{"to_symbol_id": None}] * 3)
    out = skew.reference_targets(edges, h.symbols(spark, [{"symbol_id": "x", "kind": "Field"}]))
    assert h.rows(out) == [("Call", "field", 40), ("Call", None, 43)]


@pytest.mark.parametrize("near", [skew.NEAR_ROWS, 1])
def test_join_by_weight_with_many_rows_of_a_key(spark, near, monkeypatch):
    monkeypatch.setattr(skew, "NEAR_ROWS", near)
    facts = spark.createDataFrame([("hot", i) for i in range(90)] + [("cold", 90), ("none", 91), (None, 92)], "k string, n int")
    dim = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("cold", "c"), (None, "d")], "k string, v string")
    want = [("hot", i, v) for i in range(90) for v in "ab"] + [("cold", 90, "c"), ("none", 91, None), (None, 92, None)]
    assert h.rows(skew.join_by_weight(facts, dim, "k", 0.5)) == sorted(want, key=repr)


# --- hierarchies -----------------------------------------------------------------------------


def brute_hierarchy(links):
    """Root, depth, cycle flag of each node by walking up."""
    parent = {}
    for node, up in links:
        if up is not None:
            parent[node] = min(up, parent.get(node, up)) if node in parent else up
    out = {}
    for node in {x for link in links for x in link if x is not None}:
        seen, at = [], node
        while at is not None and at not in seen:
            seen.append(at)
            at = parent.get(at)
        if at is None:
            out[node] = (seen[-1], len(seen) - 1, False)
        else:
            ring = seen[seen.index(at) :]
            below = seen[: seen.index(at)]
            root = min(ring)
            out[node] = (root, (0 if node == root else 1) if node in ring else len(below) + (at != root), node in ring)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_walk_against_brute_force(seed):
    random.seed(seed)
    n = random.choice([1, 2, 5, 30, 200])
    links = [(f"n{i}", random.choice([None, f"n{random.randrange(n)}", f"n{random.randrange(max(1, i))}"])) for i in range(n)]
    got = {r[0]: (r[1], r[2], r[5]) for r in trees.walk(links)}
    assert got == brute_hierarchy(links)
    for node, root, depth, path, n_below, on_cycle in trees.walk(links):
        assert path[0] == root and path[-1] == node and len(path) == depth + 1


def test_walk_of_a_very_deep_chain():
    links = [(str(i), str(i + 1)) for i in range(3_000)]
    got = {r[0]: r for r in trees.walk(links)}
    assert got["0"][1] == "3000" and got["0"][2] == 3_000 and got["3000"][4] == 3_000


@pytest.mark.parametrize("limit", [trees.LIMIT, 1])
def test_both_ways_give_the_same_hierarchies(spark, limit):
    random.seed(3)
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("x", "y"), ("x", "y"), ("y", "z"), ("s", "s"), ("t", "s"), ("w", None), (None, "q"), ("v", " ")]
    links += [(f"n{i}", f"n{random.randrange(i)}") for i in range(1, 60)]
    df = spark.createDataFrame([("g", a, b) for a, b in links] + [("g2", "a", "z")], "group string, node string, parent string")
    rows = trees.hierarchies(df, limit).collect()
    got = {(r["group"], r["node"]): (r["root"], r["depth"], r["on_cycle"], r["n_descendants"]) for r in rows}
    clean = [(a, b if (b or "").strip() else None) for a, b in links if a]
    want = {("g", k): v for k, v in brute_hierarchy(clean).items()} | {("g2", "a"): ("z", 1, False), ("g2", "z"): ("z", 0, False)}
    assert {k: v[:3] for k, v in got.items()} == want
    if limit == 1:
        walked = trees.hierarchies(df).collect()
        assert {k: v[3] for k, v in got.items()} == {(r["group"], r["node"]): r["n_descendants"] for r in walked}
        paths = lambda d: {(r["group"], r["node"]): r["path"] for r in d}
        assert paths(rows) == paths(walked)


def test_a_chain_at_the_limit_fits_one_task():
    import tracemalloc

    links = [(f"{i:06}", f"{i + 1:06}") for i in range(trees.LIMIT)]
    frame = pd.DataFrame({"group": "g", "comp": 1, "node": [a for a, _ in links], "parent": [b for _, b in links]})
    tracemalloc.start()
    got = pd.concat(trees._walker(trees.root_rows, trees.ROOTS)(iter([frame])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(links) + 1 and set(got["root"]) == {links[-1][1]} and peak < 1 << 30
    #: paths come in batches of a bounded number of ids
    short = frame.tail(3_000)
    sizes = [b["path"].map(len).sum() for b in trees._walker(trees.full_rows, trees.FULL)(iter([short]))]
    assert max(sizes) <= trees.BATCH_IDS + 3_001 and sum(sizes) == 3_001 * 3_002 // 2


@pytest.mark.parametrize("limit", [trees.LIMIT, 1])
def test_roots_descendants_and_cycles_agree_with_hierarchies(spark, limit):
    random.seed(9)
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("s", "s"), ("t", "s"), (None, "q"), ("v", " "), ("d", "c"), ("d", "c")]
    links += [(f"n{i}", f"n{random.randrange(i)}") for i in range(1, 40)] + [("m1", "m2"), ("m2", "m1"), ("m3", "m2")]
    df = spark.createDataFrame([("g", *x) for x in links], "group string, node string, parent string")
    full = trees.hierarchies(df, limit).cache()
    assert h.rows(trees.roots(df, limit)) == h.rows(full.select("group", "node", "root", "listed"))
    assert h.rows(trees.all_descendants(df, limit)) == h.rows(trees.descendants(full))
    assert h.rows(trees.cycles(df, limit)) == [("g", "c", "a", 3), ("g", "m2", "m1", 2), ("g", "s", "s", 1)]
    assert h.rows(trees.other_parents(df)) == [("g", "d", "c")]


def test_components_against_union_find(spark):
    random.seed(5)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(-5, -5), (1_000, 1_001)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        up[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["comp"] for r in trees.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}


def test_type_roots_spellings_and_missing_parents(spark):
    rel = h.type_relations(
        spark,
        [
            {"type_symbol_id": "T:N.A", "related_symbol_id": "T:N.B{System.Int32,N.C{X,Y}}", "relation_kind": "BASETYPE"},
            {"type_symbol_id": "T:N.B`2", "related_symbol_id": "T:Lib.Top"},
            {"type_symbol_id": "T:N.A", "related_symbol_id": "T:N.IX", "relation_kind": "Interface"},
        ],
    )
    sym = h.symbols(
        spark,
        [
            {"symbol_id": "T:N.O", "fqname": "N.O", "kind": "class"},
            {"symbol_id": "T:N.O.P", "fqname": "N.O.P", "kind": "Struct", "containing_type": "global::N.O"},
            {"symbol_id": "T:N.G`1.Q", "fqname": "N.G<T>.Q", "kind": "Enum", "containing_type": "N.G<T>"},
            {"symbol_id": "M:N.O.F", "fqname": "N.O.F", "containing_type": "N.O"},
            {"symbol_id": "T:N.Z", "fqname": "N.Z", "kind": "Record", "containing_type": None},
        ],
    )
    assert h.rows(trees.type_roots(rel, sym)) == [
        ("base", "T:N.A", "T:Lib.Top"),
        ("base", "T:N.B`2", "T:Lib.Top"),
        ("containment", "T:N.G`1.Q", "T:N.G`1"),
        ("containment", "T:N.O.P", "T:N.O"),
    ]
    none = trees.type_roots(h.type_relations(spark, []), h.symbols(spark, []))
    assert h.rows(none) == []


def test_descendants_come_from_paths(spark):
    df = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c")], "group string, node string, parent string")
    assert h.rows(trees.descendants(trees.hierarchies(df))) == [("g", "b", "a", 1), ("g", "c", "a", 2), ("g", "c", "b", 1)]


def test_definition_ids(spark):
    from pyspark.sql import functions as F

    cases = {"T:A.B{X,Y{Z,W},V}": "T:A.B`3", "T:A{X}.B{Y,Z}": "T:A`1.B`2", "T:A`1": "T:A`1", "M:A.F(L{X})": "M:A.F(L{X})", "": ""}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "x string")
    assert {r[0]: r[1] for r in df.select("x", definition_id(F.col("x"))).collect()} == cases | {None: None}
    one = spark.createDataFrame([("N.P<T, U>.Q",)], "x string").select(type_id_of(F.col("x"))).first()[0]
    assert one == "T:N.P`2.Q"


# --- history ---------------------------------------------------------------------------------


def test_history_of_changes_gaps_and_returns(spark):
    shas = ["c1", "c2", "c3", "c4", "c5"]
    v = lambda sha, sig, vis="Public", sid="s": {"commit_sha": sha, "symbol_id": "M:x", "stable_id": sid, "signature": sig, "visibility": vis}
    sym = h.symbols(
        spark,
        [
            v("c1", "int  F()"), v("c1", "int  F()"), v("c2", "int\tF()", "PUBLIC"), v("c3", "long F()"), v("c5", "int F()"),
            v("c1", None, sid="n"), v("c2", "", sid="n"), v("c3", None, sid="n", vis=None), v("c9", "z"), v("c2", "q", sid=None),
        ],
    )
    snaps = h.snapshots(spark, shas)
    assert h.rows(history.symbol_versions(sym, snaps)) == [
        ("r", "n", "c1"), ("r", "n", "c2"), ("r", "n", "c3"), ("r", "s", "c1"), ("r", "s", "c3"), ("r", "s", "c5"),
    ]
    full = {(r["stable_id"], r["version"]): r for r in history.symbol_history(sym, snaps).collect()}
    assert (full["s", 1]["valid_to"] - full["s", 1]["valid_from"]).days == 2 and full["s", 1]["n_snapshots"] == 2
    assert full["s", 2]["valid_to"] == full["s", 3]["valid_from"].replace(day=4)
    assert full["s", 3]["valid_to"] is None
    assert h.rows(history.symbol_versions(h.symbols(spark, []), snaps)) == []


def test_snapshots_skip_unbuilt_and_repeats(spark):
    base = h.baselines(spark, ["c1", "c2", "c3"])
    snaps = built_snapshots(base.union(base), h.symbols(spark, [{"symbol_id": "a", "commit_sha": "c1"}]), h.files(spark, [{"file_id": "f", "commit_sha": "c3"}]))
    assert [(r["commit_sha"], r["ord"]) for r in snaps.orderBy("ord").collect()] == [("c1", 1), ("c3", 2)]


# --- orphans ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [10, 9_000])
def test_bitmaps_are_sets(n):
    rng = np.random.default_rng(n)
    a, b = (np.unique(rng.integers(0, orphans.RANGE, n)) for _ in range(2))
    assert orphans.Bitmap(a).and_not(orphans.Bitmap(b)).tolist() == sorted(set(a.tolist()) - set(b.tolist()))


def test_ranges_of_many_keys_and_batches():
    rng = np.random.default_rng(2)
    n = 150_000
    keys = np.sort(rng.integers(0, 1 << 40, n))
    frame = pd.DataFrame({"repo": np.repeat([1, 2], n // 2), "period": rng.integers(0, 3, n), "k1": np.concatenate([keys[: n // 2], keys[n // 2 :]]), "k2": 0, "side": rng.integers(0, 2, n)}).drop_duplicates()
    frame["k2"] = frame["k1"] * 3
    cuts = np.sort(rng.integers(0, len(frame), 30))
    batches = [frame.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(frame)])]
    got = pd.concat(orphans._orphans_of_partition(iter(b for b in batches if len(b))))
    have = set(map(tuple, frame[frame.side == 1][["period", "k1"]].to_numpy()))
    want = {t for t in map(tuple, frame[frame.side == 0][["period", "k1"]].to_numpy()) if t not in have}
    assert set(map(tuple, got[["period", "k1"]].to_numpy())) == want and len(got) == len(want)


def test_orphans_by_snapshot_state_and_stub(spark):
    e = lambda to, **k: {"to_symbol_id": to} | k
    refs = h.refs(
        spark,
        [
            e("M:a"), e("M:gone"), e("M:gone", resolution_state="UnResolved"), e("", resolution_state="resolved"), e(None),
            e("M:lib"), e("M:a", commit_sha="c2"), e("M:gone", resolution_state=" Resolved"), e("M:a", repo_id=None),
        ],
    )
    refs = refs.union(refs.where("edge_seq = 1"))
    facts = h.facts(spark, [{"file_id": "f1"}, {"file_id": "f9"}, {"file_id": ""}, {"file_id": None}])
    stubs = spark.createDataFrame([("M:lib",)], "symbol_id string")
    out = orphans.orphan_references(refs, facts, h.symbols(spark, [{"symbol_id": "M:a"}]), h.files(spark, [{"file_id": "f1"}]), stubs)
    assert h.rows(out) == [("facts", 1), ("refs", 1), ("refs", 6), ("refs", 7), ("refs", 8)]
    report = orphans.orphan_report(refs, facts, h.symbols(spark, [{"symbol_id": "M:a"}]), h.files(spark, [{"file_id": "f1"}]), stubs, h.baselines(spark, ["c1"]))
    assert h.rows(report) == [("facts", "2024-01", 1), ("refs", "2024-01", 2), ("refs", None, 2)]
    none = orphans.orphan_references(h.refs(spark, []), h.facts(spark, []), h.symbols(spark, []), h.files(spark, []), stubs)
    assert h.rows(none) == []


# --- changes ---------------------------------------------------------------------------------


@pytest.mark.parametrize("cells", [128, 2])
def test_changes_against_brute_force(spark, cells):
    random.seed(cells)
    data, state = [], {f"k{i}": "p0" for i in range(60)}
    shas = ["c1", "c2", "c3", "c4"]
    want = []
    for i, sha in enumerate(shas):
        new = dict(state)
        if i:
            for k in random.sample(sorted(new), 20):
                new[k] = random.choice([None, "p0", "p1", "", "gone"])
                if new[k] == "gone":
                    del new[k]
            new |= {f"x{i}_{j}": "é" * j for j in range(5)}
            for k in sorted(set(state) | set(new)):
                kind = "added" if k not in state else "removed" if k not in new else "changed" if new[k] != state[k] else None
                if kind:
                    want.append(("r", sha, k, kind))
        state = new
        data += [("r", sha, k, p) for k, p in state.items()]
    data += data[:7] + [("r", "c1", None, "p"), ("r", "c99", "zz", "p"), ("q", "c1", "k", "p")]
    df = spark.createDataFrame(data, "repo_id string, commit_sha string, key string, payload string")
    got = changes.snapshot_changes(df, h.snapshots(spark, shas), cells)
    assert h.rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("length", [32, 33, 129, 5_000])
def test_changes_of_long_keys(spark, length):
    snaps = h.snapshots(spark, ["c1", "c2"])
    keys = {n: n * length for n in "aékx"}
    data = [("r", "c1", keys["a"], "x"), ("r", "c1", keys["k"], "x"), ("r", "c2", keys["k"], "y"), ("r", "c2", keys["é"], "x"), ("r", "c2", "short", None)]
    data += [("r", c, keys["x"], "x") for c in ("c1", "c2")]
    df = spark.createDataFrame(data, "repo_id string, commit_sha string, key string, payload string")
    want = [(keys["a"], "removed"), (keys["k"], "changed"), (keys["é"], "added"), ("short", "added")]
    for cells in (changes.CELLS, 1):
        got = h.rows(changes.snapshot_changes(df, snaps, cells))
        assert got == sorted((("r", "c2", *w) for w in want), key=repr)


def test_changes_of_empty_tables(spark):
    schema = "repo_id string, commit_sha string, key string, payload string"
    assert h.rows(changes.snapshot_changes(spark.createDataFrame([], schema), h.snapshots(spark, ["c1", "c2"]))) == []


def test_symbol_and_file_changes_ignore_spelling(spark):
    sym = h.symbols(spark, [{"symbol_id": "a", "stable_id": "s", "signature": "int  F"}, {"symbol_id": "a", "commit_sha": "c2", "stable_id": "s", "signature": "int F"}])
    fil = h.files(spark, [{"file_id": "f", "path": "a", "sha256": "AB"}, {"file_id": "f", "path": "a", "sha256": "ab", "commit_sha": "c2"}, {"file_id": "g", "path": "b", "commit_sha": "c2"}])
    got = changes.symbol_and_file_changes(sym, fil, h.snapshots(spark, ["c1", "c2"]))
    assert h.rows(got) == [("r", "c2", "file", "g", "added")]


def test_squeeze(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" a  b c　d\n",), (None,), ("  ",)], "x string")
    assert [r[0] for r in df.select(squeeze(F.col("x"))).collect()] == ["a b c d", None, ""]


# --- extra columns ---------------------------------------------------------------------------


def test_extra_columns_with_clashing_names_do_no_harm(spark):
    from pyspark.sql import functions as F

    def dressed(df):
        for name in ("ord", "n", "n_rows", "side", "payload", "key", "bucket", "cells", "comp", "node", "period", "k1", "salt", "total", "group", "root"):
            df = df.withColumn(name, F.lit("x"))
        return df

    refs = dressed(h.refs(spark, [{"to_symbol_id": "M:a", "from_symbol_id": "M:b", "indexed_at": h.START}]))
    sym = dressed(h.symbols(spark, [{"symbol_id": "T:N.O", "fqname": "N.O", "kind": "class", "stable_id": "s"}, {"symbol_id": "T:N.O.P", "fqname": "N.O.P", "kind": "class", "containing_type": "N.O"}]))
    fil, fac, rel = dressed(h.files(spark, [{"file_id": "f1", "path": "a"}])), dressed(h.facts(spark, [{"file_id": "f2"}])), dressed(h.type_relations(spark, []))
    base, stubs = dressed(h.baselines(spark, ["c1"])), dressed(spark.createDataFrame([("M:z",)], "symbol_id string"))
    snaps = built_snapshots(base, sym, fil)
    assert skew.dominant_symbols(refs).count() == 2 and skew.symbol_usage(refs, sym).count() == 2
    assert skew.reference_targets(refs, sym).count() == 1
    assert h.rows(trees.type_roots(rel, sym)) == [("containment", "T:N.O.P", "T:N.O")]
    assert history.symbol_versions(sym, snaps).count() == 1 and history.symbol_history(sym, snaps).count() == 1
    assert h.rows(orphans.orphan_references(refs, fac, sym, fil, stubs)) == [("facts", 0), ("refs", 0)]
    assert orphans.orphan_report(refs, fac, sym, fil, stubs, base).count() == 2
    assert changes.symbol_and_file_changes(sym, fil, snaps).isEmpty()
    assert changes.snapshot_changes(dressed(sym.select("repo_id", "commit_sha")), snaps).isEmpty()
