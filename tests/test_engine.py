"""The engine over published snapshots, and that its filters reach the scans."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from symlake.engine import GUIDE, Engine
from symlake.operators import diff, graph, search, summary
from symlake.schemas import Budget, InvalidArgument
from symlake.sources import catalog as cat
from symlake.sources import workspaces as w
from tests import helpers as h

A, B = "a" * 40, "b" * 40
CODE = "class Reader\n{\n    void Read()\n    {\n    }\n}"


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    out = cat.IndexCatalog(spark, str(tmp_path_factory.mktemp("lake")))
    for i, sha in enumerate((A, B)):
        rows = {
            "symbols": h.symbols(spark, [
                {"symbol_id": "T:N.Reader", "fqname": "N.Reader", "kind": " CLASS ", "stable_id": "s1", "file_id": "f1"},
                {"symbol_id": "T:N.Reader", "fqname": "N.Reader", "kind": "class", "stable_id": "s1", "file_id": "f1"},
                {"symbol_id": "M:N.Reader.Read", "fqname": "N.Reader.Read", "stable_id": "s2", "span_start": 3, "span_end": 5, "signature": "void Read()" if i else "int Read()", "containing_type": "global::N.Reader"},
                {"symbol_id": "M:N.Test.Run", "fqname": "N.Test.Run", "file_id": "f2"},
                {"symbol_id": "M:Lib.Old.ReadOld", "fqname": "Lib.Old.ReadOld", "file_id": "f3", "is_decompiled": 1},
            ]),
            "refs": h.refs(spark, [{"from_symbol_id": "M:N.Test.Run", "to_symbol_id": "M:N.Reader.Read", "file_id": "f2", "loc_start": 2}] * 2),
            "facts": h.facts(spark, [{"fact_kind": "Route", "value": "GET /a", "symbol_id": "M:N.Reader.Read"}, {"fact_kind": "DbTable", "value": "dbo.Orders|DbSet<Order>"}, {"fact_kind": "DbTable", "value": "Lines|[Table]"}]),
            "files": h.files(spark, [{"file_id": "f1", "path": "src\\N\\Reader.cs", "project_name": "N", "content": CODE}, {"file_id": "f2", "path": "tests/N.Tests/Test.cs", "project_name": "N.Tests"}, {"file_id": "f3", "path": "decompiled/R.cs"}]),
            "type_relations": h.type_relations(spark, [{"type_symbol_id": "T:N.Reader", "related_symbol_id": "T:N.Base{X}"}]),
        }
        out.write("r/1", sha, rows, f"2024-01-0{i + 1}", is_head=i == 1)
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_of_requests_reach_the_scan(lake):
    e = Engine.open(lake, "r/1", B)
    for answer, pushed in ((e.endpoints(), "EqualTo(fact_kind,Route)"), (e.references(["M:N.Reader.Read"]), "In(to_symbol_id") , (e.search(["read"]), "StringStartsWith(token,read)")):
        text = answer.rows._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in text.split("\n") if "FileScan" in x]
        assert scans and all("repo_id" in x.split("PartitionFilters")[1].split("]")[0] and "commit_sha" in x.split("PartitionFilters")[1].split("]")[0] for x in scans)
        assert pushed in text or pushed.replace("In(", "EqualTo(") in text, text
    roots = e.spark.createDataFrame([("r/1", B, "M:N.Reader.Read")], "repo_id string, commit_sha string, root string")
    assert {r["symbol_id"] for r in e.callers(roots).rows.collect()} == {"M:N.Reader.Read", "M:N.Test.Run"}
    assert {r["symbol_id"] for r in e.callees(roots.withColumn("root", F.lit("M:N.Test.Run"))).rows.collect()} == {"M:N.Reader.Read", "M:N.Test.Run"}


def test_records_are_folded_when_published(lake):
    got = lake.read("symbols", "r/1", A)
    assert got.count() == 4 and got.where("symbol_id = 'T:N.Reader'").first()["kind"] == "class"
    assert lake.read("files", "r/1", A).where("file_id = 'f1'").first()["path"] == "src/N/Reader.cs"
    assert lake.read("type_relations").first()["related_symbol_id"] == "T:N.Base`1" and lake.read("symbols").count() == 8


def test_search_filters(lake):
    e = Engine.open(lake, "r/1", B)
    ids = lambda **k: {r["symbol_id"] for r in e.search(["read"], **k).rows.collect()}
    both = {"T:N.Reader", "M:N.Reader.Read"}
    assert ids() == both | {"M:Lib.Old.ReadOld"} and ids(decompiled=False) == both
    assert ids(file_path="SRC/") == both and ids(project="n") == both and ids(project="N.Tests") == set()
    assert ids(virtual=["src/n/reader.cs"]) == both and ids(tests=False) == both | {"M:Lib.Old.ReadOld"}
    assert {r["symbol_id"] for r in e.browse(["method"], tests=False).rows.collect()} == {"M:N.Reader.Read", "M:Lib.Old.ReadOld"}
    assert [r["symbol_id"] for r in e.resolve(["Reader"]).rows.collect()] == ["T:N.Reader"]
    assert {r["symbol_id"] for r in e.suggest(["Some.Readers.Old(X)"]).rows.collect()} == {"M:Lib.Old.ReadOld"}
    with pytest.raises(InvalidArgument):
        search.narrowed(e.base["symbols"], project="N")
    found = search.search(e.base["symbols"], ["read", "old"])
    assert h.rows(found) == h.rows(e.search(["read", "old"]).rows)


def test_every_kind_of_request_answers(lake, tmp_path):
    e = Engine.open(lake, "r/1", B)
    assert [r["code"].split("\n")[0] for r in e.card(["M:N.Reader.Read"], code=True).rows.collect()] == ["    3 |     void Read()"]
    assert [(r["first_line"], r["last_line"]) for r in e.definition(["M:N.Reader.Read"]).rows.collect()] == [(1, 6)]
    cut = e.span("SRC/n/reader.cs", 1, 6, Budget(chars=10)).rows.first()
    assert cut["truncated"] and len(cut["code"]) == 10 and not e.span("src/N/Reader.cs", 1, 2).rows.first()["truncated"]
    with pytest.raises(InvalidArgument):
        e.span("a", 3, 2)
    roots = e.spark.createDataFrame([("r/1", B, "M:N.Test.Run")], "repo_id string, commit_sha string, root string")
    assert e.context(roots).rows.count() == 2 and e.trace(roots).rows.count() == 2
    assert [(r["table_name"], r["entity"]) for r in e.tables(table="ord").rows.collect()] == [("Orders", "M:N.A.F")]
    assert e.tables(limit=1).rows.count() == 1 and e.tables(limit=1, table="lines").rows.isEmpty()
    assert [r["derived_id"] for r in e.derived(["T:N.Base`1"]).rows.collect()] == ["T:N.Reader"]
    assert {r["kind"] for r in e.surface().rows.collect()} == {"class", "method"} and e.surface("summary").rows.count() == 1
    assert {r["section"] for r in e.summarize(titles=["Data"]).rows.collect()} == {"Data"} and e.export(titles=["Data"]).rows.count() == 1
    assert e.config_keys().rows.isEmpty() and e.search_text("void Read").rows.count() == 1
    answer = json.loads(e.endpoints().json())
    assert answer["rows"][0]["path"] == "/a" and answer["mode"] == "committed"
    assert set(Engine.guide()) == set(GUIDE) and all(hasattr(Engine, n) for n in GUIDE)
    assert list(Engine.guide("endpoint")) == ["endpoints"] and Engine.guide("zzzzzz") == {}


def test_difference_of_any_two_commits(lake):
    e = Engine.open(lake, "r/1")
    got = e.diff("r/1", A, B)
    assert [(r["change_kind"], r["to_id"]) for r in got["symbols"].rows.collect()] == [("SignatureChanged", "M:N.Reader.Read")]
    assert e.diff("r/1", A, B, kinds=["Class"], facts=False)["symbols"].rows.isEmpty() and got["facts"].rows.isEmpty()
    twice = h.symbols(e.spark, [{"symbol_id": s, "stable_id": "s"} for s in "ab"])
    with pytest.raises(Exception, match="stable id twice"):
        diff.require_unique(twice).collect()


def test_copies_are_compared_before_they_are_published(lake, tmp_path, monkeypatch):
    other = cat.IndexCatalog(lake.spark, str(tmp_path / "copy"))
    assert not other.pull(lake, "r/1", "c" * 40) and other.pull(lake, "r/1", A) and not other.pull(lake, "r/1", A)
    assert h.rows(other.read("symbols", "r/1", A)) == h.rows(lake.read("symbols", "r/1", A))
    digests = iter(range(100))
    monkeypatch.setattr(cat, "digest", lambda df: next(digests))
    with pytest.raises(cat.Corrupt):
        other.pull(lake, "r/1", B)
    assert not other.has("r/1", B) and other.read("symbols").count() == 4


def test_stops_between_the_steps_of_a_removal_lose_nothing_else(lake, tmp_path, monkeypatch):
    own = cat.IndexCatalog(lake.spark, str(tmp_path / "own"))
    for sha in (A, B):
        own.pull(lake, "r/1", sha)
    delete, calls = own.storage.delete, []

    def stop(*paths):
        calls.append(paths)
        if len(calls) == 2:
            raise OSError("stopped")
        delete(*paths)

    monkeypatch.setattr(own.storage, "delete", stop)
    with pytest.raises(OSError):
        own._drop([("r/1", A)])
    assert not own.has("r/1", A) and own.has("r/1", B) and own.read("symbols").count() == 4
    monkeypatch.undo()
    assert own.pull(lake, "r/1", A) and own.read("symbols").count() == 8


def test_workspaces_keep_every_revision(lake, tmp_path):
    from multiprocessing.pool import ThreadPool

    store = w.Workspaces(str(tmp_path), lake.spark)
    store.create("r/1", "mine", A)
    with ThreadPool(4) as pool:
        got = pool.map(lambda _: store.advance("r/1", "mine").revision, range(12))
    assert sorted(got) == list(range(1, 13))
    (tmp_path / "workspaces/r%2F1/mine/deltas/symbols").mkdir(parents=True)
    assert [(r["repo_id"], r["revision"], r["changed"]) for r in store.list(lake.spark, lake.baselines()).collect()] == [("r/1", 12, "symbols")]
    assert store.reset("r/1", "mine").revision == 0 and store.list(lake.spark, lake.baselines()).first()["changed"] == ""


def test_a_refresh_leads_to_a_workspace(lake, tmp_path):
    e = Engine.open(lake, "r/1", A)
    e.create_workspace("r/1", "w", A)
    edited = {
        "files": h.files(e.spark, [{"file_id": "f1", "path": "src/N/Reader.cs"}]),
        "symbols": h.symbols(e.spark, [{"symbol_id": "M:N.Reader.Pull", "fqname": "N.Reader.Pull", "file_id": "f1"}]),
    }
    over = e.refresh("r/1", "w", edited)
    assert {r["symbol_id"] for r in over._symbols().collect()} == {"M:N.Reader.Pull", "M:N.Test.Run", "M:Lib.Old.ReadOld"}
    assert over.mode == "workspace" and over.references(["M:N.Reader.Read"]).rows.isEmpty()
    roots = e.spark.createDataFrame([("r/1", A, "M:N.Test.Run")], "repo_id string, commit_sha string, root string")
    assert [r["symbol_id"] for r in over.callees(roots).rows.collect()] == ["M:N.Test.Run"]
    assert [r["revision"] for r in e.workspaces().rows.collect()] == [1] and e.delete_workspace("r/1", "w")
    assert {(r["commit_sha"][0], r["is_stale"]) for r in e.baselines().rows.collect()} == {("a", True), ("b", False)}


def test_small_operators(lake):
    spark = lake.spark
    df = spark.createDataFrame([("Full", "Partial"), (None, "Full"), ("SyntaxOnly", None), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(summary.worst_level(F.col("a"), F.col("b"))).collect()] == ["Partial", "Full", "SyntaxOnly", None]
    facts = h.facts(spark, [{"fact_kind": "DbTable", "value": v} for v in ("orders|x", "Orders|a", "Lines|b")])
    assert {r["table_name"] for r in summary.data_tables(facts).collect()} == {"Orders", "Lines"}
    pairs = spark.createDataFrame([("r", "c1", "M:a", "M:b"), ("r", "c1", "M:b", "M:a")], "repo_id string, commit_sha string, from_symbol_id string, to_symbol_id string")
    refs = h.refs(spark, [{"from_symbol_id": "M:a", "to_symbol_id": "M:b"}] * 2)
    assert {(r["from_symbol_id"], r["has_edge"]) for r in graph.has_edge(pairs, refs).collect()} == {("M:a", True), ("M:b", False)}
