"""Index operators on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from symlake import schemas
from symlake.engine import Engine
from symlake.functions import facts as parse
from symlake.functions import names
from symlake.operators import diff, extract, graph, maintenance, overlay, references, search, summary, surfaces, text
from symlake.sources import relations
from tests import helpers as h


def col(spark, values, f):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


# --- names and requests -----------------------------------------------------------------------


def test_names(spark):
    ids = ["M:N.Type`1.Do(System.Int32)", "M:N.Type.#ctor", "T:N.HXQReader", None]
    assert col(spark, ids, names.display_name) == ["Do", "Type", "HXQReader", None]
    assert col(spark, ["A.B.C(x)", "C", None], names.short_name) == ["B.C", "C", None]
    assert col(spark, ["A.B.C(x)", "C"], names.parent_name) == ["A.B", None]
    tokens = h.symbols(spark, [{"symbol_id": "T:My.HXQReader2", "namespace": "My", "signature": "class HXQReader2", "documentation": "Reads pages, aGoodOne"}])
    got = search.with_tokens(tokens).first()["tokens"]
    assert {"hxqreader2", "hxq", "reader", "my", "my.hxqreader2", "class", "reads", "pages", "good", "one"} <= set(got)
    assert names.query_tokens("Order_Service2*") == ["order", "service2", "service"]
    assert names.sanitize_query('^ab"c') == "abc" and names.sanitize_query('"a b"') == '"a b"'
    import re

    assert re.match(names.glob_regex("src/**/*.cs"), "src/a/b/X.cs") and not re.match(names.glob_regex("src/*.cs"), "src/a/X.cs")


def test_ids_and_budgets():
    assert schemas.commit_sha("a" * 40) and schemas.file_path("src/a.cs") and schemas.stable_id("sym_" + "0" * 16)
    for f, bad in ((schemas.commit_sha, "A" * 40), (schemas.file_path, "a/../b"), (schemas.file_path, "/a"), (schemas.workspace_id, "a/b"), (schemas.stable_id, "x")):
        with pytest.raises(schemas.InvalidArgument):
            f(bad)
    now, cuts = schemas.Budget(results=500, depth=9).clamped()
    assert (now.results, now.depth) == (100, 6) and cuts["results"] == schemas.LimitApplied(500, 100) and "lines" not in cuts


def test_fact_formats(spark):
    assert col(spark, ["GET /a b", "X"], parse.route_path) == ["/a b", ""]
    assert col(spark, ["k|p|q", "k"], lambda c: parse.after_pipe(c, "unknown")) == ["p|q", "unknown"]
    r = [tuple(x[0]) for x in spark.createDataFrame([("IA → A|Scoped",), ("IH → W|Singleton|HostedService",), ("bare",)], "x string").select(F.struct(*parse.registration(F.col("x")).values())).collect()]
    assert r == [("IA", "A", "Scoped", False), ("IH", "W", "Singleton", True), ("bare", "", None, False)]
    assert col(spark, ["Use|pos:3|terminal", "Use"], parse.middleware_position) == [3, None]


# --- relations --------------------------------------------------------------------------------


def test_relations_undo_spelling_and_repeats(spark):
    sym = h.symbols(spark, [{"symbol_id": "T:A", "kind": " CLASS", "containing_type": "global::B", "signature": "a  b"}] * 2 + [{"symbol_id": None}])
    got = relations.symbols(sym).collect()
    assert len(got) == 1 and (got[0]["kind"], got[0]["containing_type"], got[0]["signature"]) == ("class", "B", "a b")
    edge = relations.refs(h.refs(spark, [{"edge_seq": 1, "to_symbol_id": "", "resolution_state": None}] * 2)).collect()
    assert len(edge) == 1 and edge[0]["to_symbol_id"] is None and edge[0]["resolution_state"] == "resolved"
    assert relations.files(h.files(spark, [{"file_id": "f", "path": ".\\src\\A.cs", "is_virtual": None}])).first()["path"] == "src/A.cs"
    assert relations.facts(h.facts(spark, [{"file_id": ""}])).first()["file_id"] is None


# --- search -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def named(spark):
    ids = ["T:N.DockService", "T:N.IDockService", "T:N.DockServiceFactory", "M:N.DockService.Open", "T:Other.HXQReader"]
    return relations.symbols(h.symbols(spark, [{"symbol_id": i, "fqname": i[2:], "namespace": i[2:].split(".")[0], "kind": "Class" if i[0] == "T" else "Method"} for i in ids])).cache()


def test_search_ranks_exact_prefix_and_parts(named):
    got = [(r["symbol_id"], r["score"]) for r in search.search(named, ["dockservice"]).orderBy("rank").collect()]
    assert got[0] == ("T:N.DockService", 125) and ("T:N.DockServiceFactory", 65) in got
    assert [r["symbol_id"] for r in search.search(named, ["hxq read"]).collect()] == ["T:Other.HXQReader"]
    assert search.search(named, ["nothing"]).isEmpty()


def test_search_limits_filters_and_errors(named):
    top = search.search(named, ["dock"], limit=2).collect()
    assert len(top) == 2 and all(r["truncated"] for r in top)
    assert {r["symbol_id"] for r in search.search(named, ["open"], kinds=["Method"]).collect()} == {"M:N.DockService.Open"}
    assert search.search(named, ["dock"], namespace="other").isEmpty()
    assert {r["symbol_id"] for r in search.search(named, ["h"]).collect()} == {"T:Other.HXQReader"}
    with pytest.raises(schemas.InvalidArgument):
        search.search(named, [" "])
    with pytest.raises(schemas.InvalidArgument):
        search.browse(named, [])


def test_resolve_names(named):
    got = {r["query"]: (r["outcome"], r["symbol_id"]) for r in search.resolve_names(named, ["HXQReader", "DockService", "None"]).collect()}
    assert got == {"HXQReader": ("resolved", "T:Other.HXQReader"), "DockService": ("ambiguous", None)}


# --- graph ------------------------------------------------------------------------------------


def walk(spark, edges, root="A", depth=3, limit=20, **k):
    rows = [{"from_symbol_id": a, "to_symbol_id": b} for a, b in edges]
    refs = relations.refs(h.refs(spark, rows))
    roots = spark.createDataFrame([("r", "c1", root)], "repo_id string, commit_sha string, root string")
    nodes, links = graph.traverse(roots, refs, depth, limit, callers=False)
    got = {r["symbol_id"]: r["depth"] for r in nodes.collect()}
    cut = nodes.select(F.max("truncated")).first()[0]
    return got, cut, sorted((r["from_node"], r["to_node"]) for r in links.collect())


def test_traversal_cycles_diamonds_and_loops(spark):
    got, cut, links = walk(spark, [("A", "B"), ("B", "A")])
    assert got == {"A": 0, "B": 1} and not cut and links == [("A", "B"), ("B", "A")]
    got, _, links = walk(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("C", "C")])
    assert got == {"A": 0, "B": 1, "C": 1, "D": 2} and ("C", "D") in links and ("C", "C") in links


def test_traversal_depth_and_fanout(spark):
    chain = [("A", "B"), ("B", "C"), ("C", "D")]
    assert walk(spark, chain, depth=0)[0] == {"A": 0}
    assert walk(spark, chain, depth=2)[0] == {"A": 0, "B": 1, "C": 2}
    got, cut, links = walk(spark, [("A", f"B{i}") for i in range(5)], depth=1, limit=3)
    assert got == {"A": 0, "B0": 1, "B1": 1, "B2": 1} and cut and len(links) == 4


def brute_traverse(edges, root, depth, limit):
    seen, frontier, cut = {root: 0}, [root], False
    for d in range(1, depth + 1):
        nxt = []
        for parent in frontier:
            near, raw = [], [e for e in edges if e[0] == parent][: 2 * (limit + 1)]
            for _, b in raw:
                if b not in near:
                    near.append(b)
            for b in near[: limit + 1]:
                if b in seen:
                    continue
                if len(nxt) < limit:
                    seen[b] = d
                    nxt.append(b)
                else:
                    cut = True
        frontier = nxt
    return seen, cut


@pytest.mark.parametrize("seed", range(3))
def test_traversal_against_brute_force(spark, seed):
    import random

    random.seed(seed)
    edges = [(f"n{random.randrange(25)}", f"n{random.randrange(25)}") for _ in range(120)]
    for limit in (2, 4):
        want, cut = brute_traverse(edges, "n0", 3, limit)
        got, got_cut, _ = walk(spark, edges, "n0", 3, limit)
        assert got == want and bool(got_cut) == cut


def test_trace_repeats_shared_nodes(spark):
    refs = relations.refs(h.refs(spark, [{"from_symbol_id": a, "to_symbol_id": b} for a, b in [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")]]))
    roots = spark.createDataFrame([("r", "c1", "A")], "repo_id string, commit_sha string, root string")
    fact = h.facts(spark, [{"symbol_id": "D", "fact_kind": "Config", "value": "k|x"}])
    got = [(r["path"], r["annotations"]) for r in graph.trace_feature(roots, refs, fact).orderBy("path").collect()]
    assert [p for p, _ in got] == ["A", "A > B", "A > B > D", "A > C", "A > C > D"] and got[2][1] == "Config:k"


def test_hierarchy_and_interface_members(spark):
    sym = relations.symbols(h.symbols(spark, [{"symbol_id": s, "kind": k} for s, k in [("T:N.A", "class"), ("T:N.IA", "interface"), ("M:N.A.Do(System.Int32)", "method"), ("M:N.IA.Do(System.Int32)", "method"), ("M:N.A.Own", "method")]]))
    rel = relations.type_relations(h.type_relations(spark, [{"type_symbol_id": "T:N.A", "related_symbol_id": "T:N.IA", "relation_kind": "Interface"}, {"type_symbol_id": "T:N.A", "related_symbol_id": "T:X.Base"}]))
    assert h.rows(graph.interface_members(sym, rel)) == [("r", "c1", "M:N.A.Do(System.Int32)", "M:N.IA.Do(System.Int32)")]
    got = {r["symbol_id"]: (r["base_type"], r["interfaces"], r["n_derived"]) for r in graph.type_hierarchy(rel, sym).collect()}
    assert got == {"T:N.A": ("T:X.Base", "T:N.IA", 0), "T:N.IA": (None, "", 1)}


# --- references -------------------------------------------------------------------------------


def test_references_order_limit_and_excerpt(spark):
    refs = relations.refs(h.refs(spark, [{"to_symbol_id": "M:t", "from_symbol_id": "M:a", "loc_start": i} for i in (3, 1, 2)]))
    files = relations.files(h.files(spark, [{"file_id": "f1", "path": "a.cs", "content": "x" * 250 + "\n  two\r\nthree"}]))
    got = references.find(refs, files, limit=2)
    assert [(r["loc_start"], r["truncated"]) for r in got.orderBy("rank").collect()] == [(1, True), (2, True)]
    lines = {r["loc_start"]: r["excerpt"] for r in references.with_excerpt(got, files).collect()}
    assert lines == {1: "x" * 197 + "...", 2: "two"}


def test_resolution_by_name_and_hint(spark):
    sym = relations.symbols(h.symbols(spark, [{"symbol_id": "M:N.A.Go", "containing_type": "N.A"}, {"symbol_id": "M:N.B.Go", "containing_type": "N.B"}, {"symbol_id": "M:N.B.One(X)", "containing_type": "N.B"}]))
    u = lambda n, hint=None: {"to_name": n, "to_container_hint": hint, "resolution_state": "unresolved", "from_symbol_id": "M:x"}
    refs = relations.refs(h.refs(spark, [u("One"), u("Go"), u("Go", "N.B"), u("Never")]))
    found = references.resolve(refs, sym)
    assert h.rows(found) == [(0, "M:N.B.One(X)"), (2, "M:N.B.Go")]
    assert references.upgraded(refs, found).where("resolution_state = 'resolved'").count() == 2


# --- surfaces and summaries -------------------------------------------------------------------


def test_endpoints_limit_before_filter(spark):
    facts = relations.facts(h.facts(spark, [{"fact_kind": "Route", "value": v} for v in ("GET /a", "GET /b", "POST /c")]))
    assert surfaces.endpoints(facts, limit=2, method="post").isEmpty()
    assert surfaces.endpoints(facts, limit=2, method="post", filter_first=True).count() == 1
    assert surfaces.endpoints(facts, path="/A").count() == 1


def test_tables_group_ignoring_case(spark):
    facts = relations.facts(
        h.facts(spark, [{"fact_kind": "DbTable", "value": v, "symbol_id": s, "confidence": c} for v, s, c in [("dbo.Orders|DbSet<Order>", "M:1", "High"), ("DBO.ORDERS|Raw SQL", "M:2", "Medium"), ("Items|Raw SQL", "M:3", "Low")]])
    )
    got = {r["table_name"]: (r["schema_name"], r["n_referrers"], r["confidence"]) for r in surfaces.db_tables(facts).collect()}
    assert got == {"ORDERS": ("DBO", 2, "Medium"), "Items": (None, 1, "Low")}


def test_export_keeps_the_budget(spark):
    facts = relations.facts(h.facts(spark, [{"fact_kind": "Route", "value": f"GET /path/{i:03d}"} for i in range(40)] + [{"fact_kind": "Config", "value": "k|x"}]))
    out = summary.export(facts, max_tokens=50).collect()
    assert len(out) == 1 and not out[0]["fits"] and len(out[0]["body"]) <= 50 * 4 and out[0]["body"].endswith("...")
    assert summary.sections(facts, 3).where("section = 'Endpoints'").first()["n_items"] == 40


# --- text -------------------------------------------------------------------------------------


def test_text_search_lines_and_limits(spark):
    files = relations.files(h.files(spark, [{"file_id": "f1", "path": "b.cs", "content": "one\r\nTwo two\n"}, {"file_id": "f2", "path": "A.cs", "content": "two"}, {"file_id": "f3", "path": "n.cs", "content": None}]))
    got = text.search_text(files, "two").orderBy("rank").collect()
    assert [(r["path"], r["line"], r["excerpt"]) for r in got] == [("A.cs", 1, "two"), ("b.cs", 2, "Two two")]
    assert text.search_text(files, "two", limit=1).first()["truncated"]
    assert text.search_text(files, "^TWO", ignore_case=True, path_prefix="B").count() == 1
    with pytest.raises(schemas.InvalidArgument):
        text.search_text(files, "")


def test_spans_number_lines(spark):
    files = relations.files(h.files(spark, [{"file_id": "f1", "path": "a.cs", "content": "\n".join(f"l{i}" for i in range(1, 11))}]))
    sym = relations.symbols(h.symbols(spark, [{"symbol_id": "M:a", "span_start": 1, "span_end": 3}, {"symbol_id": "M:b", "span_start": 9, "span_end": 99}]))
    got = {r["symbol_id"]: r for r in text.definitions(sym, files, context=1, max_lines=3).collect()}
    assert got["M:a"]["code"] == "    1 | l1\n    2 | l2\n    3 | l3" and got["M:a"]["truncated"]
    assert (got["M:b"]["first_line"], got["M:b"]["last_line"], got["M:b"]["truncated"]) == (8, 10, False)


# --- differences and overlays -----------------------------------------------------------------


def test_symbol_diff_cases(spark):
    s = lambda sha, sid, stable, sig="s", vis="public": {"commit_sha": sha, "symbol_id": sid, "stable_id": stable, "signature": sig, "visibility": vis}
    sym = relations.symbols(
        h.symbols(
            spark,
            [
                s("c1", "M:same", "1"), s("c2", "M:same", "1"), s("c1", "M:old", "2"), s("c2", "M:new", "2"),
                s("c1", "M:sig", "3"), s("c2", "M:sig", "3", "t"), s("c1", "M:vis", "4"), s("c2", "M:vis", "4", vis="private"),
                s("c1", "M:gone", "5"), s("c2", "M:add", "6"), s("c1", "M:null", None), s("c2", "M:null", None, "u"),
            ],
        )
    )
    got = {(r["change_kind"], r["from_id"], r["to_id"]) for r in diff.symbol_diff(sym, h.snapshots(spark, ["c1", "c2"])).collect()}
    assert got == {
        ("Renamed", "M:old", "M:new"), ("SignatureChanged", "M:sig", "M:sig"), ("VisibilityChanged", "M:vis", "M:vis"),
        ("Removed", "M:gone", None), ("Added", None, "M:add"), ("SignatureChanged", "M:null", "M:null"),
    }


def test_fact_diff_by_key(spark):
    f = lambda sha, kind, v: {"commit_sha": sha, "fact_kind": kind, "value": v}
    facts = relations.facts(h.facts(spark, [f("c1", "Config", "k|a"), f("c2", "Config", "k|b"), f("c1", "Route", "GET /x"), f("c2", "Route", "GET /y")]))
    got = {(r["fact_kind"], r["change_kind"]) for r in diff.fact_diff(facts, h.snapshots(spark, ["c1", "c2"])).collect()}
    assert got == {("Config", "Changed"), ("Route", "Removed"), ("Route", "Added")}


def test_overlay_merge(spark):
    base = relations.symbols(h.symbols(spark, [{"symbol_id": f"M:{i}", "file_id": f"f{i // 2}"} for i in range(6)]))
    over_sym = relations.symbols(h.symbols(spark, [{"symbol_id": "M:0", "file_id": "f0", "signature": "new"}, {"symbol_id": "M:9", "file_id": "f0"}]))
    key = "repo_id string, commit_sha string, "
    over = overlay.Overlay(
        files=spark.createDataFrame([("r", "c1", "f0")], key + "file_id string"),
        symbols=over_sym,
        refs=relations.refs(h.refs(spark, [])),
        facts=relations.facts(h.facts(spark, [])),
        type_relations=relations.type_relations(h.type_relations(spark, [])),
        deleted=spark.createDataFrame([("r", "c1", "M:5")], key + "symbol_id string"),
    )
    got = {(r["symbol_id"], r["side"]) for r in overlay.merged_symbols(base, over).collect()}
    assert got == {("M:0", "overlay"), ("M:9", "overlay"), ("M:2", "baseline"), ("M:3", "baseline"), ("M:4", "baseline")}
    edges = relations.refs(h.refs(spark, [{"to_symbol_id": "M:5", "file_id": "f2"}, {"to_symbol_id": "M:2", "file_id": "f0"}, {"to_symbol_id": "M:2", "file_id": "f1"}, {"to_symbol_id": None, "file_id": "f1"}]))
    assert {r["edge_seq"] for r in overlay.merged_refs(edges, over).collect()} == {2, 3}
    tables = {"symbols": h.symbols(spark, [{"symbol_id": f"M:{i}", "file_id": f"f{i // 2}"} for i in range(6)]), "refs": h.refs(spark, []), "facts": h.facts(spark, []), "files": h.files(spark, [{"file_id": "f2", "path": "a"}]), "type_relations": h.type_relations(spark, [])}
    assert Engine(spark, tables, over).card(["M:5"]).rows.isEmpty() and Engine(spark, tables).card(["M:5"]).rows.count() == 1


def test_overlay_log_readds(spark):
    log = spark.createDataFrame([("w", "a", 1, "upsert"), ("w", "a", 2, "delete"), ("w", "a", 3, "upsert"), ("w", "b", 1, "upsert"), ("w", "b", 2, "delete")], "workspace_id string, symbol_id string, revision long, op string")
    assert h.rows(overlay.latest_state(log)) == [("w", "a", 3)]


def test_phased_changes(spark):
    rows = spark.createDataFrame([("r", "c", "a", "Added", 1), ("r", "c", "a", "Deleted", 2), ("r", "c", "b", "Modified", 1)], "repo_id string, commit_sha string, path string, change_kind string, phase int")
    assert h.rows(overlay.phased_changes(rows)) == [("r", "c", "a", "Deleted"), ("r", "c", "b", "Modified")]


# --- upkeep and extraction ----------------------------------------------------------------------


def test_retention(spark):
    base = h.baselines(spark, [f"c{i}" for i in range(5)]).withColumn("is_active_workspace_base", F.col("commit_sha") == "c0")
    got = {r["commit_sha"]: r["verdict"] for r in maintenance.retention(relations.baselines(base), keep=2).collect()}
    assert got == {"c4": "protected", "c3": "kept", "c2": "removed", "c1": "removed", "c0": "protected"}


def test_structural_ids_survive_renames(spark):
    sym = relations.symbols(h.symbols(spark, [{"symbol_id": "M:N.A.X(S)", "containing_type": "N.A", "signature": "int X(S)"}, {"symbol_id": "M:N.A.Y(S)", "containing_type": "N.A", "signature": "int Y(S)", "span_start": 9}, {"symbol_id": "M:N.A.Z(S)", "commit_sha": "c2", "containing_type": "N.A", "signature": "int Z(S)"}]))
    got = {r["symbol_id"]: r["structural_id"] for r in maintenance.structural_ids(sym).collect()}
    assert got["M:N.A.X(S)"] == got["M:N.A.Z(S)"] != got["M:N.A.Y(S)"]


SOURCE = '''namespace Shop.Api;
[Route("api/[controller]")]
public class OrderController : ControllerBase, IOrders
{
    public DbSet<Order> Orders { get; set; }
    [HttpGet("{id}")]
    public async Task<Order> Get(int id)
    {
        var x = config["Db:Name"] ?? throw new Missing(); var y = config["Db:Port"];
        services.AddScoped<IStore, Store>().TryAddSingleton<IClock>(sp => new Clock());
        services.AddSingleton(sp => new Bus()); services.AddSingleton<ICache>(new Cache()); services.AddHostedService<Worker>();
        services.Configure<Mail>(config.GetSection("Mail")); var z = config.GetSection("Log");
        app.UseRouting(); app.MapGet("/ping", P); app.MapHub<H>("/h");
        _log.Log(LogLevel.Debug, "lvl"); _log.LogWarning(ex, "no literal first");
        p.WaitAndRetryAsync(3, i => i); q.AddCircuitBreaker(); r.AddRetry(o);
        try { } catch (IOException e) { throw; }
        _log.LogError("no {Id}", id);
        await db.Query("SELECT * FROM dbo.Orders o JOIN sys.tables t");
        throw new NotFoundException(nameof(id));
        // throw new Ignored();
    }
}
'''


def test_extraction_from_source(spark):
    files = relations.files(h.files(spark, [{"file_id": "f1", "path": "src/A.cs", "content": SOURCE}, {"file_id": "f2", "path": "b.fs", "content": "namespace My.Fs\nmodule rec Util\nlet inline add a b = a + b\n[<Struct>] type Shape = { X: int }\nand IDraw = interface\ntype Constructor() =\n  member _.Build x = x"}, {"file_id": "f3", "path": "c.vb", "content": None}]))
    got = {(r["fact_kind"], r["value"]) for r in extract.extract_facts(files).collect()}
    assert got == {
        ("Route", "GET /api/order/{id}"), ("Route", "GET /ping"), ("DbTable", "Orders|DbSet<Order>"),
        ("Config", "Db:Name|IConfiguration indexer"), ("Config", "Db:Port|IConfiguration indexer"), ("Config", "Mail|Options Configure"), ("Config", "Log|GetSection"),
        ("DiRegistration", "IStore → Store|Scoped"), ("DiRegistration", "IClock → factory|Singleton"), ("DiRegistration", "Bus → factory|Singleton"),
        ("DiRegistration", "ICache → Cache|Singleton"), ("DiRegistration", "Worker → Worker|Singleton|HostedService"),
        ("Middleware", "UseRouting|pos:1"), ("Middleware", "MapHub|pos:2|terminal"), ("Log", "no {Id}|Error"), ("Log", "lvl|Debug"),
        ("RetryPolicy", "WaitAndRetryAsync(3)|Polly"), ("RetryPolicy", "CircuitBreaker|Resilience"), ("RetryPolicy", "AddRetry|Resilience"),
        ("DbTable", "dbo.Orders|Raw SQL"), ("Exception", "NotFoundException|throw new (nameof guard)"), ("Exception", "Missing|throw expression"),
        ("Exception", "IOException|re-throw"),
    }
    names_ = {(r["kind"], r["name"], r["namespace"]) for r in extract.extract_symbols(files).collect()}
    assert {("class", "OrderController", "Shop.Api"), ("property", "Orders", "Shop.Api"), ("method", "Get", "Shop.Api"), ("class", "Util", "My.Fs"), ("method", "add", "My.Fs"), ("struct", "Shape", "My.Fs"), ("interface", "IDraw", "My.Fs"), ("class", "Constructor", "My.Fs"), ("method", "Build", "My.Fs")} == names_
    assert {(r["related_name"], r["relation_kind"]) for r in extract.extract_relations(files).collect()} == {("ControllerBase", "BaseType"), ("IOrders", "Interface")}
    calls = {(r["ref_kind"], r["to_name"], r["to_container_hint"]) for r in extract.extract_calls(files).collect()}
    assert {("Call", "UseRouting", "app"), ("Instantiate", "NotFoundException", None), ("Call", "Query", "db")} <= calls


def test_empty_relations_give_empty_answers(spark):
    sym, refs, facts, files, rel = relations.symbols(h.symbols(spark, [])), relations.refs(h.refs(spark, [])), relations.facts(h.facts(spark, [])), relations.files(h.files(spark, [])), relations.type_relations(h.type_relations(spark, []))
    snaps = h.snapshots(spark, ["c1", "c2"])
    for out in (search.search(sym, ["a"]), references.find(refs, files), references.resolve(refs, sym), surfaces.db_tables(facts), summary.statistics(sym, refs, facts, files), summary.export(facts), graph.type_hierarchy(rel, sym), diff.symbol_diff(sym, snaps), diff.fact_diff(facts, snaps), extract.extract_facts(files), text.search_text(files, "a")):
        assert out.isEmpty()


# --- context and upkeep of workspaces ----------------------------------------------------------


def test_context_answers_and_outlines(spark):
    from symlake.operators import context

    files = relations.files(h.files(spark, [{"file_id": "f1", "path": "a.cs", "content": "one\r\ntwo\nthree"}]))
    sym = relations.symbols(h.symbols(spark, [{"symbol_id": "M:A", "span_start": 2, "span_end": 3}, {"symbol_id": "M:B", "file_id": "f9"}]))
    refs = relations.refs(h.refs(spark, [{"from_symbol_id": "M:A", "to_symbol_id": "M:B"}]))
    roots = spark.createDataFrame([("r", "c1", "M:A")], "repo_id string, commit_sha string, root string")
    got = {r["symbol_id"]: (r["depth"], r["code"]) for r in context.contexts(roots, sym, refs, files).collect()}
    assert got == {"M:A": (0, "two\nthree"), "M:B": (1, None)}
    assert context.symbols_by_file(sym, files).first()["outline"] == "M:A"
    assert context.code_of(sym, files).first()["code"] == "    2 | two\n    3 | three"
    unsaved = spark.createDataFrame([("a.cs", "new"), ("b.cs", "x")], "path string, content string")
    assert [r["content"] for r in context.with_virtual_files(files, unsaved).collect()] == ["new"]
    changes = spark.createDataFrame([("r", 2, "Renamed", "a", "b"), ("r", 2, "Added", None, "c")], "repo_id string, ord int, change_kind string, from_id string, to_id string")
    assert context.render_changes(changes).first()["body"] == "- Added: c\n- Renamed: a -> b"


def test_callers_follow_interfaces(spark):
    from symlake.operators import context

    sym = relations.symbols(h.symbols(spark, [{"symbol_id": s, "kind": k} for s, k in [("T:N.A", "class"), ("T:N.IA", "interface"), ("M:N.A.Do", "method"), ("M:N.IA.Do", "method"), ("M:N.X.Own", "method"), ("M:N.X.Far", "method")]]))
    rel = relations.type_relations(h.type_relations(spark, [{"type_symbol_id": "T:N.A", "related_symbol_id": "T:N.IA", "relation_kind": "Interface"}]))
    refs = relations.refs(h.refs(spark, [{"from_symbol_id": "M:N.X.Own", "to_symbol_id": "M:N.A.Do"}, {"from_symbol_id": "M:N.X.Far", "to_symbol_id": "M:N.IA.Do"}]))
    roots = spark.createDataFrame([("r", "c1", "M:N.A.Do")], "repo_id string, commit_sha string, root string")
    plain = {r["symbol_id"] for r in graph.traverse(roots, refs, 1)[0].collect()}
    aliases = context.interface_aliases(roots, sym, rel)
    more = {r["symbol_id"] for r in graph.traverse(roots, refs, 1, aliases=aliases)[0].collect()}
    assert plain == {"M:N.A.Do", "M:N.X.Own"} and more == plain | {"M:N.X.Far"}
    assert h.rows(context.interface_callers(sym, refs, rel)) == [("r", "c1", "M:N.A.Do", 1, 1)]


def test_routes_combine(spark):
    cases = [("api/[controller]", "{id}", "OrdersController", "/api/orders/{id}"), ("api", "/root", "XController", "/api/root"), (None, "/x", "XController", "/x"), ("api/", None, "X", "/api"), ("", "a", "X", "/a"), ("[Controller]", None, "AbController", "/ab")]
    df = spark.createDataFrame(cases, "prefix string, action string, controller string, want string")
    assert df.where(extract.combined_route(F.col("prefix"), F.col("action"), F.col("controller")) != F.col("want")).isEmpty()


def test_razor_and_vb_facts(spark):
    text_ = '@inject IStore Store\n[Parameter] public string Title { get; set; }\n<HttpGet("x")>\nThrow New BadThing("a")\nPublic Property Items As DbSet(Of Item)\ns.AddScoped(Of IA, A)()'
    got = {(r["fact_kind"], r["value"]) for r in extract.extract_facts(relations.files(h.files(spark, [{"file_id": "f", "path": "a.vb", "content": text_}]))).collect()}
    assert got == {("RazorInject", "Store: IStore"), ("RazorParameter", "Title: string"), ("Route", "GET /x"), ("Exception", "BadThing|throw new"), ("DbTable", "Items|DbSet<Item>"), ("DiRegistration", "IA → A|Scoped")}
