"""Queries of the code index operators over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.operators import context, diff, graph, maintenance, overlay, references, search, summary, surfaces, text
from symlake.operators.snapshots import built_snapshots
from symlake.plans import index_sql
from symlake.session import cut, table
from symlake.sources import relations

#: Requests of the search queries.
SEARCHES = ["reader", "order service", "Snapshot.Read", "IQueueStore", "merge al"]
NAMES = ["OrderReader", "LockReader", "GaugeTracker"]
DEPTH, LIMIT = 2, 20


def rel(spark: SparkSession, d: str, name: str, columns: str = "", where: Column | str | None = None) -> DataFrame:
    """A relation in even spelling, with the key and the named columns."""
    return getattr(relations, name)(table(spark, d, name), columns.split(), where)


#: Columns that the operators need.
SEARCHED = "kind namespace signature documentation"
PLACED = "to_symbol_id file_id loc_start resolution_state"
OWNED = "fqname kind file_id visibility containing_type"
FACT = "symbol_id value"
DIFFED = "kind signature visibility stable_id"
OVERLAID = {
    "symbols": "kind signature file_id", "refs": "to_symbol_id file_id", "facts": "value file_id", "type_relations": "",
}
OF_KIND = lambda *kinds: f"fact_kind in {(*kinds, kinds[0])}"
SECTIONED = OF_KIND(*summary.SECTIONS)


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return built_snapshots(table(spark, d, "baselines"), table(spark, d, "symbols"), table(spark, d, "files"))


def _search(spark: SparkSession, d: str, queries: list[str], **narrow) -> DataFrame:
    """A search that narrows the stored rows before they are folded."""
    return search.search(rel(spark, d, "symbols", SEARCHED, search.may_match(queries)), queries, LIMIT, **narrow)


def symbols_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, SEARCHES)


def symbols_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, SEARCHES[:2], kinds=["Class", "Interface"])


def symbols_search_written(spark: SparkSession, d: str) -> DataFrame:
    asked = SEARCHES[:2]
    rows = rel(spark, d, "symbols", f"{SEARCHED} file_id is_decompiled", search.may_match(asked))
    near = search.narrowed(rows, rel(spark, d, "files", "path project_name"), file_path="SRC/", decompiled=False, tests=False)
    return search.search(near, asked, LIMIT)


def symbols_resolve_name(spark: SparkSession, d: str) -> DataFrame:
    return search.resolve_names(rel(spark, d, "symbols", SEARCHED, search.may_match(NAMES)), NAMES)


def symbols_browse(spark: SparkSession, d: str) -> DataFrame:
    return search.browse(rel(spark, d, "symbols", "fqname kind", F.col("kind").isin("interface", "enum")), ["Interface", "Enum"], LIMIT)


def index_tokens(spark: SparkSession, d: str) -> DataFrame:
    return search.token_statistics(rel(spark, d, "symbols", SEARCHED))


def symbols_card(spark: SparkSession, d: str) -> DataFrame:
    return summary.cards(rel(spark, d, "symbols", "kind signature visibility confidence file_id span_start"), rel(spark, d, "facts", FACT), rel(spark, d, "files", "path"))


def refs_find(spark: SparkSession, d: str) -> DataFrame:
    return references.find(rel(spark, d, "refs", PLACED), rel(spark, d, "files", "path"))


def refs_find_calls(spark: SparkSession, d: str) -> DataFrame:
    return references.find(rel(spark, d, "refs", PLACED, F.col("ref_kind") == "Call"), rel(spark, d, "files", "path"), 5, kind="Call", state="resolved")


def refs_outgoing(spark: SparkSession, d: str) -> DataFrame:
    return references.find(rel(spark, d, "refs", PLACED), rel(spark, d, "files", "path"), outgoing=True)


def refs_excerpts(spark: SparkSession, d: str) -> DataFrame:
    files = rel(spark, d, "files", "path content")
    return references.with_excerpt(references.find(rel(spark, d, "refs", PLACED), files), files)


def refs_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.counts(rel(spark, d, "refs", "to_symbol_id resolution_state"))


def refs_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return references.unresolved_in_files(rel(spark, d, "refs", "to_name to_container_hint file_id loc_start resolution_state"), rel(spark, d, "files", "path"))


def refs_resolve(spark: SparkSession, d: str) -> DataFrame:
    return references.resolve(rel(spark, d, "refs", "to_name to_container_hint resolution_state"), rel(spark, d, "symbols", "containing_type"))


def refs_upgraded(spark: SparkSession, d: str) -> DataFrame:
    edges = rel(spark, d, "refs", "to_symbol_id to_name to_container_hint resolution_state")
    return references.counts(references.upgraded(edges, references.resolve(edges, rel(spark, d, "symbols", "containing_type"))))


def _route_owners(spark: SparkSession, d: str) -> DataFrame:
    owners = rel(spark, d, "facts", "symbol_id", OF_KIND("Route"))
    return owners.select("repo_id", "commit_sha", F.col("symbol_id").alias("root")).distinct()


def _called_types(spark: SparkSession, d: str) -> DataFrame:
    types = rel(spark, d, "symbols", "kind", F.col("kind") == "interface")
    return types.select("repo_id", "commit_sha", F.col("symbol_id").alias("root"))


def graph_callees(spark: SparkSession, d: str) -> DataFrame:
    return graph.traverse(_route_owners(spark, d), rel(spark, d, "refs", "to_symbol_id"), DEPTH, LIMIT, callers=False)[0]


def graph_callers(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = graph.traverse(_called_types(spark, d), rel(spark, d, "refs", "to_symbol_id"), DEPTH, LIMIT)
    return graph.hydrate(nodes, rel(spark, d, "symbols", "kind fqname file_id span_start")).select(
        "repo_id", "commit_sha", "root", "symbol_id", "depth", "truncated", "kind"
    )


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.traverse(_route_owners(spark, d), rel(spark, d, "refs", "to_symbol_id"), DEPTH, LIMIT, callers=False)[1]


def graph_trace_feature(spark: SparkSession, d: str) -> DataFrame:
    return graph.trace_feature(_route_owners(spark, d), rel(spark, d, "refs", "to_symbol_id"), rel(spark, d, "facts", FACT))


def types_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return graph.type_hierarchy(rel(spark, d, "type_relations", ""), rel(spark, d, "symbols", "kind"))


def types_derived(spark: SparkSession, d: str) -> DataFrame:
    return graph.derived_types(rel(spark, d, "type_relations"), rel(spark, d, "symbols", "fqname"))


def interface_members(spark: SparkSession, d: str) -> DataFrame:
    return graph.interface_members(rel(spark, d, "symbols", ""), rel(spark, d, "type_relations", ""))


def surfaces_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.endpoints(rel(spark, d, "facts", FACT, OF_KIND("Route")))


def surfaces_endpoints_get(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.endpoints(rel(spark, d, "facts", FACT, OF_KIND("Route")), 30, method="get")


def surfaces_config_keys(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.config_keys(rel(spark, d, "facts", FACT, OF_KIND("Config")))


def surfaces_config_sections(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.by_top_prefix(rel(spark, d, "facts", "value", OF_KIND("Config")))


def surfaces_db_tables(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.db_tables(rel(spark, d, "facts", "symbol_id value confidence", OF_KIND("DbTable")))


def surfaces_db_tables_top(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.db_tables(rel(spark, d, "facts", "symbol_id value confidence", OF_KIND("DbTable")), "s", LIMIT)


def surfaces_registrations(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.registrations(rel(spark, d, "facts", "value", OF_KIND("DiRegistration")))


def surfaces_middleware(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.middleware(rel(spark, d, "facts", "value", OF_KIND("Middleware")))


def code_search_text(spark: SparkSession, d: str) -> DataFrame:
    return text.search_text(rel(spark, d, "files", "path content", F.col("content").isNotNull()), r"throw new \w+Exception")


def code_search_glob(spark: SparkSession, d: str) -> DataFrame:
    return text.search_text(rel(spark, d, "files", "path content", F.col("content").isNotNull()), "cursor", 20, glob="src/**/*.cs", ignore_case=True)


def code_definition_spans(spark: SparkSession, d: str) -> DataFrame:
    return text.definitions(rel(spark, d, "symbols", "file_id span_start span_end"), rel(spark, d, "files", "path content", F.col("content").isNotNull()))


def diff_symbols(spark: SparkSession, d: str) -> DataFrame:
    return diff.symbol_diff(rel(spark, d, "symbols", DIFFED), _snapshots(spark, d))


def diff_facts(spark: SparkSession, d: str) -> DataFrame:
    return diff.fact_diff(rel(spark, d, "facts", "value"), _snapshots(spark, d))


def diff_statistics(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff_statistics(rel(spark, d, "symbols", DIFFED), _snapshots(spark, d))


def diff_fact_statistics(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff_statistics(rel(spark, d, "symbols", DIFFED), _snapshots(spark, d), rel(spark, d, "facts", "value"))


def _next_files(spark: SparkSession, d: str) -> tuple[Callable[[DataFrame], DataFrame], DataFrame]:
    """What brings rows of the next snapshot under the key of the one before, and the file changes
    between the two."""
    snaps = _snapshots(spark, d)
    base = snaps.select("repo_id", F.col("commit_sha").alias("base_sha"), (F.col("ord") + 1).alias("ord"))
    step = snaps.join(base, ["repo_id", "ord"]).select("repo_id", "commit_sha", "base_sha")

    def ahead(df: DataFrame) -> DataFrame:
        return df.join(step, ["repo_id", "commit_sha"]).withColumn("commit_sha", F.col("base_sha")).drop("base_sha")

    files = rel(spark, d, "files", "path sha256")
    bases = files.join(step.select("repo_id", F.col("base_sha").alias("commit_sha")), ["repo_id", "commit_sha"], "left_semi")
    return ahead, overlay.file_changes(bases, ahead(files))


def _next_as_overlay(spark: SparkSession, d: str, *names: str) -> tuple[overlay.Overlay, dict[str, DataFrame]]:
    """Workspaces over every snapshot: the changed files of the next one, keyed by the base; and the
    folded relations of the base. Symbols and those named are written once, as base and workspace
    both read them."""
    ahead, changed = _next_files(spark, d)
    changed = cut(changed)
    mine = changed.select("repo_id", "commit_sha", "file_id")
    inside = lambda df: ahead(df).join(mine, ["repo_id", "commit_sha", "file_id"], "left_semi")
    folded = {n: cut(rel(spark, d, n, OVERLAID[n])) for n in ("symbols", *names)}
    own = {n: folded[n] if n in folded else rel(spark, d, n, OVERLAID[n]) for n in OVERLAID}
    after = inside(own["symbols"])
    types = after.select("repo_id", "commit_sha", F.col("symbol_id").alias("type_symbol_id"))
    over = overlay.Overlay(
        files=mine,
        symbols=after,
        refs=inside(own["refs"]),
        facts=inside(own["facts"]),
        type_relations=ahead(own["type_relations"]).join(types, ["repo_id", "commit_sha", "type_symbol_id"], "left_semi"),
        deleted=overlay.deleted_symbols(own["symbols"], ahead(own["symbols"]), changed),
    )
    return over, own


def overlay_changes(spark: SparkSession, d: str) -> DataFrame:
    return _next_files(spark, d)[1]


def overlay_deleted(spark: SparkSession, d: str) -> DataFrame:
    return _next_as_overlay(spark, d)[0].deleted


def overlay_symbols(spark: SparkSession, d: str) -> DataFrame:
    over, own = _next_as_overlay(spark, d)
    merged = overlay.merged_symbols(own["symbols"], over)
    return merged.select("repo_id", "commit_sha", "symbol_id", "kind", "signature", "side")


def overlay_refs(spark: SparkSession, d: str) -> DataFrame:
    over, own = _next_as_overlay(spark, d, "refs")
    merged = overlay.merged_refs(own["refs"], over)
    return merged.groupBy("repo_id", "commit_sha", "ref_kind", "side").agg(F.count("*").alias("n_refs"))


def overlay_callees(spark: SparkSession, d: str) -> DataFrame:
    over, own = _next_as_overlay(spark, d, "refs")
    merged = overlay.merged_callees(own["refs"], over)
    return merged.groupBy("repo_id", "commit_sha", "ref_kind", "side").agg(F.count("*").alias("n_refs"))


def overlay_facts(spark: SparkSession, d: str) -> DataFrame:
    over, own = _next_as_overlay(spark, d, "facts")
    merged = overlay.merged_facts(own["facts"], over)
    return merged.select("repo_id", "commit_sha", "fact_seq", "fact_kind", "value", "side")


def overlay_type_relations(spark: SparkSession, d: str) -> DataFrame:
    over, own = _next_as_overlay(spark, d, "type_relations")
    merged = overlay.merged_type_relations(own["type_relations"], over)
    return merged.select("repo_id", "commit_sha", "type_symbol_id", "related_symbol_id", "relation_kind", "side")


def summary_statistics(spark: SparkSession, d: str) -> DataFrame:
    return summary.statistics(rel(spark, d, "symbols", "kind"), rel(spark, d, "refs", "resolution_state"), rel(spark, d, "facts", ""), rel(spark, d, "files", "project_name"))


def summary_levels(spark: SparkSession, d: str) -> DataFrame:
    return summary.semantic_levels(rel(spark, d, "refs", "file_id resolution_state"), rel(spark, d, "files", "project_name"))


def summary_sections(spark: SparkSession, d: str) -> DataFrame:
    return summary.sections(rel(spark, d, "facts", FACT, SECTIONED))


def summary_errors_and_logs(spark: SparkSession, d: str) -> DataFrame:
    return summary.error_and_log_counts(rel(spark, d, "facts", "value", OF_KIND("Exception", "Log")))


def summary_services(spark: SparkSession, d: str) -> DataFrame:
    return summary.services(rel(spark, d, "symbols", OWNED), rel(spark, d, "files", "path"))


def summary_surface(spark: SparkSession, d: str) -> DataFrame:
    return summary.public_types(rel(spark, d, "symbols", f"{OWNED} signature"), rel(spark, d, "files", "path"))


def summary_data_tables(spark: SparkSession, d: str) -> DataFrame:
    return summary.data_tables(rel(spark, d, "facts", "value", OF_KIND("DbTable")))


def summary_export(spark: SparkSession, d: str) -> DataFrame:
    return summary.export(rel(spark, d, "facts", FACT, SECTIONED))


def summary_projects(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.project_statistics(rel(spark, d, "symbols", "file_id"), rel(spark, d, "files", "project_name"))


def baselines_catalog(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.catalog(rel(spark, d, "baselines"), _snapshots(spark, d))


def baselines_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.retention(rel(spark, d, "baselines"), 3)


def baselines_reclaimed(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.reclaimed(rel(spark, d, "baselines"), 3)


def structural_ids(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.structural_ids(rel(spark, d, "symbols", "kind containing_type namespace signature span_start"))


def plain_ids(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.plain_ids(rel(spark, d, "symbols", "fqname kind signature documentation span_start span_end visibility file_id"), rel(spark, d, "files", "project_name"))


def symbols_context(spark: SparkSession, d: str) -> DataFrame:
    symbols = rel(spark, d, "symbols", "kind signature file_id span_start span_end")
    refs, files = rel(spark, d, "refs", "to_symbol_id"), rel(spark, d, "files", "path content", F.col("content").isNotNull())
    return context.contexts(_route_owners(spark, d), symbols, refs, files)


def symbols_by_file(spark: SparkSession, d: str) -> DataFrame:
    return context.symbols_by_file(rel(spark, d, "symbols", "file_id span_start"), rel(spark, d, "files", "path"))


def interface_callers(spark: SparkSession, d: str) -> DataFrame:
    return context.interface_callers(rel(spark, d, "symbols", ""), rel(spark, d, "refs", "to_symbol_id"), rel(spark, d, "type_relations", ""))


def search_answers(spark: SparkSession, d: str) -> DataFrame:
    return context.search_answers(_search(spark, d, SEARCHES))


def diff_rendered(spark: SparkSession, d: str) -> DataFrame:
    snaps = _snapshots(spark, d)
    return context.render_changes(diff.symbol_diff(rel(spark, d, "symbols", DIFFED), snaps), diff.fact_diff(rel(spark, d, "facts", "value"), snaps))


def search_savings(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.savings(_search(spark, d, SEARCHES))


_NAMES = """
symbols_search symbols_search_filtered symbols_search_written symbols_resolve_name symbols_browse index_tokens symbols_card
refs_find refs_find_calls refs_outgoing refs_excerpts refs_counts refs_unresolved refs_resolve refs_upgraded
graph_callees graph_callers graph_edges graph_trace_feature types_hierarchy types_derived interface_members
surfaces_endpoints surfaces_endpoints_get surfaces_config_keys surfaces_config_sections surfaces_db_tables
surfaces_db_tables_top surfaces_registrations surfaces_middleware code_search_text code_search_glob code_definition_spans
diff_symbols diff_facts diff_statistics diff_fact_statistics overlay_changes overlay_deleted overlay_symbols overlay_refs
overlay_callees overlay_facts overlay_type_relations summary_statistics summary_levels summary_sections
summary_errors_and_logs summary_services summary_surface summary_data_tables summary_export summary_projects baselines_catalog
baselines_cleanup baselines_reclaimed structural_ids search_savings plain_ids symbols_context symbols_by_file interface_callers search_answers
diff_rendered
""".split()
SQL = index_sql.SQL
QUERIES = {n: globals()[n] for n in _NAMES}
