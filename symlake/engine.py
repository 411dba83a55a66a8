"""One entry point over snapshots or workspaces: budgets, routing and the answer's envelope."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.operators import context, diff, graph, maintenance, overlay, references, search, summary, surfaces, text
from symlake.schemas import RELATIONS, Budget, InvalidArgument, LimitApplied
from symlake.sources import relations, workspaces
from symlake.sources.catalog import IndexCatalog, harvest

#: What each request is for: the guide.
GUIDE = {
    "search": "symbols by words of their names, signatures and documentation",
    "browse": "symbols of some kinds", "resolve": "the id that a name stands for", "suggest": "symbols near a name that was not found",
    "card": "all that is known of some symbols", "span": "numbered source lines", "definition": "the source of some symbols",
    "context": "symbols with their code and what they call", "references": "who refers to some symbols",
    "callers": "calls above symbols", "callees": "calls below symbols", "trace": "call trees with facts below entry points",
    "hierarchy": "base, interfaces and number of derived types", "derived": "derived types",
    "endpoints": "routes", "config_keys": "configuration keys", "tables": "database tables", "search_text": "lines by regular expression",
    "summarize": "sections of facts", "export": "sections in a token budget", "surface": "public types and members",
    "diff": "changes between two commits", "ensure_baseline": "publishes a checkout", "baselines": "published snapshots",
    "cleanup": "removes old snapshots", "remove_repo": "removes a repository", "refresh": "the workspace that an edit leads to",
    "create_workspace": "a workspace over a commit", "reset_workspace": "drops its changes", "workspaces": "all workspaces",
    "delete_workspace": "removes one", "status": "branch, head and whether it is indexed", "guide": "this list",
}


@dataclass(frozen=True)
class Answer:
    """Rows of an answer with what was cut and how it can be checked."""

    rows: DataFrame
    limits: dict[str, LimitApplied] = field(default_factory=dict)
    mode: str = "committed"

    def json(self) -> str:
        """The envelope as text; for answers within a budget, as the rows are collected."""
        limits = {k: {"requested": v.requested, "applied": v.applied} for k, v in self.limits.items()}
        return json.dumps({"mode": self.mode, "limits": limits, "rows": [json.loads(r) for r in self.rows.toJSON().collect()]})


class Engine:
    """Requests over relations; an overlay switches to workspace mode.

    ``tables`` are stored rows, which are folded, or with ``published`` records of a catalog, which
    are read as they are, so that filters of a request reach the scan. All requests answer for
    every snapshot in the tables at once; narrow the tables, or use :meth:`open`, to ask about
    one. Workspace mode merges symbols, references, facts and relations; text search, summary,
    export and difference stay on the committed state, tracing follows committed edges.
    """

    def __init__(
        self,
        spark: SparkSession,
        tables: dict[str, DataFrame],
        over: overlay.Overlay | None = None,
        published: bool = False,
        catalog: IndexCatalog | None = None,
    ) -> None:
        self.spark, self.over, self.catalog, self.published = spark, over, catalog, published
        names = RELATIONS if not published else [n for n in tables]
        self.base = {n: tables[n] if published else getattr(relations, n)(tables[n]) for n in names}
        self.mode = "workspace" if over else "committed"

    @classmethod
    def open(cls, catalog: IndexCatalog, repo_id: str | None = None, sha: str | None = None, over: overlay.Overlay | None = None) -> "Engine":
        """An engine over a catalog's published records, of one repository or snapshot if named."""
        names = [*RELATIONS, "postings", "refs_by_source"]
        return cls(catalog.spark, {n: catalog.read(n, repo_id, sha) for n in names}, over, True, catalog)

    def _symbols(self) -> DataFrame:
        own = self.base["symbols"]
        return overlay.merged_symbols(own, self.over).drop("side") if self.over else own

    def _refs(self, source: str = "refs") -> DataFrame:
        own = self.base.get(source, self.base["refs"])
        return overlay.merged_refs(own, self.over).drop("side") if self.over else own

    def _facts(self) -> DataFrame:
        own = self.base["facts"]
        return overlay.merged_facts(own, self.over).drop("side") if self.over else own

    def _relations(self) -> DataFrame:
        own = self.base["type_relations"]
        return overlay.merged_type_relations(own, self.over).drop("side") if self.over else own

    def _searched(self, queries: list[str]) -> DataFrame:
        """Symbols to search in: those that a published token index leads to, where there is one."""
        if "postings" in self.base and not self.over:
            near = search.candidates(self.base["postings"], queries)
            return self.base["symbols"].join(near, [*relations.KEY, "symbol_id"], "left_semi")
        return self._symbols()

    # --- symbols -----------------------------------------------------------------------------

    def search(self, queries: list[str], budget: Budget = Budget(), kinds: list[str] | None = None, namespace: str | None = None, **where) -> Answer:
        """Symbols by token prefixes; ``where`` as for :func:`search.narrowed`. Overlay hits and those
        of the baseline outside changed files count alike."""
        now, cuts = budget.clamped()
        rows = search.narrowed(self._searched(queries), self.base["files"], **where)
        return Answer(search.search(rows, queries, now.results, kinds, namespace), cuts, self.mode)

    def browse(self, kinds: list[str], budget: Budget = Budget(), **where) -> Answer:
        """Symbols of some kinds; an id on both sides is the overlay's."""
        now, cuts = budget.clamped()
        return Answer(search.browse(search.narrowed(self._symbols(), self.base["files"], **where), kinds, now.results), cuts, self.mode)

    def resolve(self, names: list[str]) -> Answer:
        """Ids that names stand for."""
        return Answer(search.resolve_names(self._searched(names), names), {}, self.mode)

    def suggest(self, names: list[str]) -> Answer:
        """Symbols near names that were not found."""
        return Answer(search.suggestions(self._symbols(), names), {}, self.mode)

    def card(self, symbol_ids: list[str], code: bool = False) -> Answer:
        """Cards of some symbols, with up to 100 lines of code if asked."""
        if not symbol_ids:
            raise InvalidArgument("symbol ids are required")
        wanted = self._symbols().where(F.col("symbol_id").isin(symbol_ids))
        facts = overlay.merged_card_facts(self.base["facts"], self.over).drop("side") if self.over else self.base["facts"]
        cards = summary.cards(wanted, facts.where(F.col("symbol_id").isin(symbol_ids)), self.base["files"])
        if code:
            lines = context.code_of(wanted, self.base["files"]).select(*relations.KEY, "symbol_id", "code")
            cards = cards.join(lines, [*relations.KEY, "symbol_id"], "left")
        return Answer(cards, {}, self.mode)

    def definition(self, symbol_ids: list[str], budget: Budget = Budget(), lines: int = 2) -> Answer:
        """Source of some symbols with lines around it."""
        now, cuts = budget.clamped()
        wanted = self._symbols().where(F.col("symbol_id").isin(symbol_ids))
        return Answer(text.definitions(wanted, self.base["files"], lines, now.lines, now.chars), cuts, self.mode)

    def span(self, path: str, first: int, last: int, budget: Budget = Budget(), lines: int = 0) -> Answer:
        """Numbered lines of a file, found by its path in any case."""
        if first < 1 or last < first:
            raise InvalidArgument("lines count from 1 and do not end before they start")
        now, cuts = budget.clamped()
        asked = self.base["files"].where(F.lower("path") == path.lower()).select(
            *relations.KEY, "file_id", F.lit(first).alias("span_start"), F.lit(last).alias("span_end")
        )
        return Answer(text.spans(asked, self.base["files"], lines, now.lines, now.chars), cuts, self.mode)

    def context(self, roots: DataFrame, depth: int = 1, limit: int = 10) -> Answer:
        """Symbols with their code and what they call."""
        return Answer(context.contexts(roots, self._symbols(), self._refs("refs_by_source"), self.base["files"], depth, limit, lookup=True), {}, self.mode)

    # --- references and graphs ----------------------------------------------------------------

    def references(self, symbol_ids: list[str], budget: Budget = Budget(), kind: str | None = None, state: str | None = None) -> Answer:
        """References to some symbols; none to a symbol that the workspace deletes."""
        now, cuts = budget.clamped()
        mine = self._refs().where(F.col("to_symbol_id").isin(symbol_ids))
        return Answer(references.find(mine, self.base["files"], now.references, kind, state), cuts, self.mode)

    def callers(self, roots: DataFrame, budget: Budget = Budget(depth=1), follow_interface: bool = False) -> Answer:
        """Call graph above roots; with ``follow_interface`` calls of the interface members that a root
        stands for count as its own."""
        now, cuts = budget.clamped()
        symbols = self._symbols()
        aliases = context.interface_aliases(roots, symbols, self._relations()) if follow_interface else None
        nodes, _ = graph.traverse(roots, self._refs(), now.depth, now.results, True, aliases, lookup=True)
        return Answer(graph.hydrate(nodes, symbols), cuts, self.mode)

    def callees(self, roots: DataFrame, budget: Budget = Budget(depth=1)) -> Answer:
        """Call graph below roots, in a workspace by the cautious rule of :func:`overlay.merged_callees`."""
        now, cuts = budget.clamped()
        own = self.base.get("refs_by_source", self.base["refs"])
        refs = overlay.merged_callees(own, self.over).drop("side") if self.over else own
        nodes, _ = graph.traverse(roots, refs, now.depth, now.results, False, lookup=True)
        return Answer(graph.hydrate(nodes, self._symbols()), cuts, self.mode)

    def trace(self, roots: DataFrame, budget: Budget = Budget(results=100)) -> Answer:
        """Call trees with facts below entry points."""
        now, cuts = budget.clamped()
        refs = self.base.get("refs_by_source", self.base["refs"])
        return Answer(graph.trace_feature(roots, refs, self._facts(), now.depth, now.results, lookup=True), cuts, self.mode)

    def hierarchy(self) -> Answer:
        """One step around every type."""
        return Answer(graph.type_hierarchy(self._relations(), self._symbols()), {}, self.mode)

    def derived(self, symbol_ids: list[str]) -> Answer:
        """Types directly below some types."""
        mine = self._relations().where(F.col("related_symbol_id").isin(symbol_ids))
        return Answer(graph.derived_types(mine, self._symbols()), {}, self.mode)

    # --- surfaces, text and summaries ---------------------------------------------------------

    def endpoints(self, limit: int = 50, method: str | None = None, path: str | None = None) -> Answer:
        """Routes."""
        return Answer(surfaces.endpoints(self._facts(), limit, method, path), {}, self.mode)

    def config_keys(self, limit: int = 50, prefix: str | None = None) -> Answer:
        """Configuration keys."""
        return Answer(surfaces.config_keys(self._facts(), limit, prefix), {}, self.mode)

    def tables(self, limit: int = 50, table: str | None = None) -> Answer:
        """Database tables."""
        return Answer(surfaces.db_tables(self._facts(), table, limit), {}, self.mode)

    def search_text(self, pattern: str, limit: int = 50, path_prefix: str | None = None) -> Answer:
        """Lines by regular expression, in the committed state."""
        return Answer(text.search_text(self.base["files"], pattern, min(limit, text.MAX_MATCHES), path_prefix), {}, "committed")

    def summarize(self, limit: int = 50, titles: list[str] | None = None) -> Answer:
        """Sections of the committed state, all or some."""
        rows = summary.sections(self.base["facts"], limit)
        return Answer(rows.where(F.col("section").isin(titles)) if titles else rows, {}, "committed")

    def export(self, max_tokens: int = 4_000, titles: list[str] | None = None) -> Answer:
        """Rendered sections within a token budget, in the committed state."""
        return Answer(summary.export(self.base["facts"], max_tokens, titles=titles), {}, "committed")

    def surface(self, detail: str = "standard") -> Answer:
        """Public types (``summary``), with their members (``standard`` and ``full``), the latter with
        signatures."""
        if detail not in ("summary", "standard", "full"):
            raise InvalidArgument("detail is summary, standard or full")
        rows = summary.public_types(self.base["symbols"], self.base["files"], detail != "summary")
        return Answer(rows if detail == "full" else rows.drop("signature"), {}, "committed")

    def diff(self, repo_id: str, from_sha: str, to_sha: str, kinds: list[str] | None = None, facts: bool = True) -> dict[str, Answer]:
        """Changes of symbols, and of facts if asked, between two commits of a repository."""
        ends = diff.between(self.spark, repo_id, from_sha, to_sha)
        at = (F.col("repo_id") == repo_id) & F.col("commit_sha").isin(from_sha, to_sha)
        symbols = diff.require_unique(self.base["symbols"].where(at))
        out = {"symbols": Answer(diff.of_kinds(diff.symbol_diff(symbols, ends), kinds))}
        if facts:
            out["facts"] = Answer(diff.fact_diff(self.base["facts"].where(at), ends, diff.FACTS_PER_KIND))
        return out

    # --- upkeep -------------------------------------------------------------------------------

    def _catalog(self) -> IndexCatalog:
        if self.catalog is None:
            raise InvalidArgument("the engine has no catalog")
        return self.catalog

    def _workspaces(self) -> workspaces.Workspaces:
        return workspaces.Workspaces(self._catalog().root, self.spark)

    def ensure_baseline(self, folder: str, repo_id: str, sha: str, created_at: str) -> bool:
        """Publishes the sources of a checkout; False if the commit is there already."""
        return self._catalog().write(repo_id, sha, {"files": harvest(self.spark, folder, repo_id, sha)}, created_at, is_head=True)

    def baselines(self) -> Answer:
        """Published snapshots with their order and whether they are behind the head."""
        rows = self._catalog().baselines()
        order = F.row_number().over(maintenance.by_age())
        return Answer(maintenance.catalog(rows, rows.withColumn("ord", order)))

    def cleanup(self, keep: int = 5, older_than: str | None = None, dry_run: bool = True) -> Answer:
        """Removes old snapshots, or says which."""
        return Answer(self._catalog().cleanup(keep, older_than, dry_run))

    def remove_repo(self, repo_id: str, dry_run: bool = True) -> int:
        """Removes a repository's snapshots, or says how many there are."""
        return self._catalog().remove_repo(repo_id, dry_run)

    def create_workspace(self, repo_id: str, name: str, base: str) -> workspaces.Workspace:
        """A workspace over a commit."""
        return self._workspaces().create(repo_id, name, base)

    def reset_workspace(self, repo_id: str, name: str) -> workspaces.Workspace:
        """The workspace without its changes."""
        return self._workspaces().reset(repo_id, name)

    def workspaces(self) -> Answer:
        """All workspaces."""
        return Answer(self._workspaces().list(self.spark, self._catalog().baselines()))

    def delete_workspace(self, repo_id: str, name: str) -> bool:
        """Removes a workspace."""
        return self._workspaces().delete(repo_id, name)

    def refresh(self, repo_id: str, name: str, rows: dict[str, DataFrame]) -> "Engine":
        """The engine over the workspace that new rows of changed files (``files`` with its symbols,
        refs, facts and type relations) lead to, at the workspace's next revision."""
        now = self._workspaces().advance(repo_id, name)
        at = (F.col("repo_id") == repo_id) & (F.col("commit_sha") == now.base_commit_sha)
        even = {
            n: getattr(relations, n)(rows.get(n, self.spark.createDataFrame([], RELATIONS[n])))
            .withColumn("repo_id", F.lit(repo_id))
            .withColumn("commit_sha", F.lit(now.base_commit_sha))
            for n in RELATIONS
        }
        deleted = overlay.deleted_symbols(self.base["symbols"].where(at), even["symbols"], even["files"])
        over = overlay.Overlay(even["files"], even["symbols"], even["refs"], even["facts"], even["type_relations"], deleted)
        return Engine(self.spark, {n: self.base[n] for n in RELATIONS}, over, True, self.catalog)

    def status(self, folder: str, repo_id: str) -> dict:
        """Branch and head of a checkout and whether that commit is published."""
        state = workspaces.checkout_state(folder)
        return state | {"is_indexed": bool(state["head"]) and self._catalog().has(repo_id, state["head"])}

    @staticmethod
    def guide(name: str | None = None) -> dict[str, str]:
        """What there is to ask for; for a name that is unknown, the nearest one."""
        if name is None or name in GUIDE:
            return GUIDE if name is None else {name: GUIDE[name]}
        near = workspaces.closest(name, list(GUIDE))
        return {near: GUIDE[near]} if near else {}
