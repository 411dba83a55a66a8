"""Catalog, harvest, overlay stream, and the driver's entry points."""

from __future__ import annotations

import importlib
import json

import pytest

import __spark_entry__
from symlake import schemas
from symlake.sources.catalog import IndexCatalog, harvest
from symlake.streaming import overlays
from tests import helpers as h

A, B, C = "a" * 40, "b" * 40, "c" * 40


def test_catalog_round_trip_and_cleanup(spark, tmp_path):
    cat = IndexCatalog(spark, str(tmp_path / "lake"))
    assert cat.baselines().isEmpty() and cat.read("symbols").isEmpty()
    sym = h.symbols(spark, [{"symbol_id": "T:A"}, {"symbol_id": "T:B"}])
    for i, sha in enumerate((A, B, C)):
        assert cat.write("r", sha, {"symbols": sym, "files": h.files(spark, [{"file_id": "f"}])}, f"2024-01-0{i + 1}", is_head=sha == C)
    assert not cat.write("r", A, {"symbols": sym}, "2024-01-01")
    assert cat.read("symbols", "r", B).count() == 2 and cat.read("symbols").count() == 6
    assert [r["commit_sha"] for r in cat.cleanup(keep=1).collect()] == [A, B] or cat.cleanup(keep=1).count() == 2
    assert cat.read("symbols").count() == 6
    cat.cleanup(keep=2, dry_run=False)
    assert cat.read("symbols").count() == 4 and not cat.has("r", A)
    other = IndexCatalog(spark, str(tmp_path / "shared"))
    assert cat.push(other, "r", C) and not cat.push(other, "r", C) and other.read("symbols", "r", C).count() == 2
    assert cat.remove_repo("r") == 2 and cat.remove_repo("r", dry_run=False) == 2 and cat.read("files").isEmpty()
    with pytest.raises(schemas.InvalidArgument):
        cat.write("r", "x", {}, "2024-01-01")
    with pytest.raises(schemas.InvalidArgument):
        cat.write("r", A, {"nope": sym}, "2024-01-01")


def test_half_written_snapshots_are_not_read(spark, tmp_path):
    cat = IndexCatalog(spark, str(tmp_path / "lake"))
    cat.write("r", A, {"symbols": h.symbols(spark, [{"symbol_id": "T:A"}])}, "2024-01-01")
    h.symbols(spark, [{"symbol_id": "T:X", "repo_id": "r", "commit_sha": B}]).write.mode("append").partitionBy("repo_id", "commit_sha").parquet(str(tmp_path / "lake/symbols"))
    assert [r["symbol_id"] for r in cat.read("symbols").collect()] == ["T:A"]


def test_harvest_reads_whole_files(spark, tmp_path):
    src = tmp_path / "repo" / "src" / "Shop"
    src.mkdir(parents=True)
    (src / "A.cs").write_text("﻿class A {}\n", encoding="utf-8")
    (src / "skip.bin").write_bytes(b"\0")
    got = harvest(spark, str(tmp_path / "repo"), "r", A).collect()
    assert [(r["path"], r["project_name"], r["content"]) for r in got] == [("src/Shop/A.cs", "Shop", "class A {}\n")]


def test_overlay_stream_replays_and_compacts(spark, tmp_path):
    landing, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    (tmp_path / "in").mkdir()

    def land(name, rows):
        with open(f"{landing}/{name}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(("workspace_id", "symbol_id", "op", "changed_at"), r))) + "\n" for r in rows)
        stream = spark.readStream.schema(overlays.LOG).json(landing)
        overlays.append_deltas(stream, log, check).awaitTermination()

    land("1", [("w", "a", "upsert", "2024-01-01T00:00:00"), ("w", "b", "upsert", "2024-01-01T00:05:00")])
    land("2", [("w", "a", "delete", "2024-01-01T00:20:00")])
    assert [r["symbol_id"] for r in overlays.replay(spark, log).collect()] == ["b"]
    land("3", [("w", "a", "upsert", "2024-01-01T00:30:00")])
    assert sorted(r["symbol_id"] for r in overlays.replay(spark, log).collect()) == ["a", "b"]
    assert sorted(r["symbol_id"] for r in overlays.replay(spark, log, up_to=0).collect()) == ["a", "b"]
    overlays.compact(spark, log, str(tmp_path / "small"))
    assert sorted(r["symbol_id"] for r in overlays.replay(spark, str(tmp_path / "small")).collect()) == ["a", "b"]
    per = overlays.changes_per_window(spark.read.schema(overlays.LOG).json(landing))
    assert per.where("op = 'upsert'").selectExpr("sum(n_changes)").first()[0] == 3


def test_tables_written_between_steps_go_with_their_scope(spark):
    import glob

    from symlake.session import cut, scratch, shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/symlake-*"))
    with scratch(spark):
        with scratch(spark):
            inner = cut(spark.range(3))
            assert inner.count() == 3
        outer = cut(spark.range(2))
        assert len(set(glob.glob(f"{folder}/symlake-*")) - before) == 1 and outer.count() == 2
    assert set(glob.glob(f"{folder}/symlake-*")) == before


def test_logs_of_whole_rows_replay(spark, tmp_path):
    log = str(tmp_path / "rows")
    rows = lambda r, op, *x: spark.createDataFrame([("w", "f", i, v, op, r) for i, v in x], "workspace_id string, file_id string, edge_seq long, to_symbol_id string, op string, revision long")
    rows(0, "upsert", (1, "a"), (2, "b")).write.parquet(f"{log}/revision=0")
    rows(1, "upsert", (1, "c")).unionByName(rows(1, "delete", (2, None))).write.parquet(f"{log}/revision=1")
    rows(2, "upsert", (2, "d")).write.parquet(f"{log}/revision=2")
    live = lambda n: {(r["edge_seq"], r["to_symbol_id"]) for r in overlays.replay_rows(spark, log, ["edge_seq"], n).collect()}
    assert live(0) == {(1, "a"), (2, "b")} and live(1) == {(1, "c")} and live(None) == {(1, "c"), (2, "d")}
    assert overlays.compaction_due(spark, log, max_rows=5) and not overlays.compaction_due(spark, log)


def test_queries_and_sql_have_the_same_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and {f"p{n}_found" for n in (1, 3, 4, 5, 6)} <= set(queries)
    for name in __spark_entry__.MODULES:
        module = importlib.import_module(name)
        assert set(module.SQL) <= set(module.QUERIES)


def test_nothing_imports_the_text_subpackage():
    import ast
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent / "symlake"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("symlake.llm") for n in names), path


def test_entry_has_a_stable_schema(spark):
    assert __spark_entry__.entry(spark).columns == ["side", "symbol_id", "kind", "n_rows", "n_peers", "first_seen", "last_seen"]


def test_workspaces_and_checkouts(spark, tmp_path):
    from symlake.sources import workspaces as w

    store = w.Workspaces(str(tmp_path))
    assert store.create("r", "mine", A) == store.create("r", "mine", A)
    with pytest.raises(schemas.InvalidArgument):
        store.create("r", "mine", B)
    assert store.advance("r", "mine").revision == 1 and store.reset("r", "mine").revision == 0
    base = h.baselines(spark, [A, B])
    assert [(r["workspace_id"], r["is_stale"]) for r in store.list(spark, base).collect()] == [("mine", True)]
    assert store.delete("r", "mine") and not store.delete("r", "mine")
    assert w.repo_id_of("git@host.example:team/app.git") == w.repo_id_of("https://host.example/team/App/")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.csproj").write_text("")
    assert w.find_solution(str(tmp_path)).name == "a.csproj"
    (tmp_path / "x.sln").write_text("")
    assert w.find_solution(str(tmp_path), "x.slnx").name == "x.sln" and w.find_solution(str(tmp_path / "none")) is None
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "refs/heads/main").write_text(A)
    assert w.checkout_state(str(tmp_path)) == {"branch": "main", "head": A}
    assert w.closest("serch", ["search", "refs"]) == "search" and w.closest("zzz", ["search"]) is None
    df = spark.createDataFrame([("a", "net8.0"), ("a", "netstandard2.0"), ("a", "net10.0"), ("b", "net48")], "path string, target string")
    assert h.rows(w.best_targets(df)) == [("a", "net10.0", 3), ("b", "net48", 1)]
