"""Symbol search by token prefixes with an integer score, over every snapshot at once."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symlake.functions.names import display_name, index_tokens, is_test_path, name_tokens, query_tokens, sanitize_query
from symlake.schemas import InvalidArgument
from symlake.sources.relations import KEY

#: Schema of the stored token index.
POSTINGS = T.StructType([T.StructField(n, T.StringType()) for n in (*KEY, "token", "symbol_id")])

#: Index tokens that a prefix of one character stands for at most, in ordinal order.
ONE_CHAR_TOKENS = 50


def with_tokens(symbols: DataFrame) -> DataFrame:
    """``symbols`` with display, tokens and own (tokens of the name alone)."""
    sid = F.col("symbol_id")
    return symbols.select(
        "*",
        display_name(sid).alias("display"),
        index_tokens(sid, F.col("namespace"), F.col("signature"), F.col("documentation")).alias("tokens"),
        name_tokens(sid).alias("own"),
    )


def postings(symbols: DataFrame) -> DataFrame:
    """The inverted index: ``repo_id, commit_sha, token, symbol_id``, for clustered storage."""
    return with_tokens(symbols).select(*KEY, F.explode("tokens").alias("token"), "symbol_id")


def token_statistics(symbols: DataFrame) -> DataFrame:
    """Tokens of each snapshot with the number of symbols they lead to: ``n_symbols``."""
    return postings(symbols).groupBy(*KEY, "token").agg(F.count("*").alias("n_symbols"))


def _any_starts(tokens: str, prefix: str) -> Column:
    """Whether any token of a list column starts with ``prefix``."""
    return F.exists(tokens, lambda t: t.startswith(prefix))


def _score(query: str, tokens: list[str]) -> Column:
    """100 for the exact display name, 80 for the exact full name or its end, 40 for a prefix of
    the display name, else 10; up to 20 for query tokens that the name's own tokens start with;
    5 for names below 30 characters."""
    q = query.strip().rstrip("*").lower()
    display, full = F.lower("display"), F.lower("symbol_id")
    base = (
        F.when(display == q, 100)
        .when((full == q) | full.endswith("." + q), 80)
        .when(display.startswith(q), 40)
        .otherwise(10)
    )
    hits = [_any_starts("own", p).cast("int") for p in tokens]
    matched = reduce(lambda a, b: a + b, hits)
    return (
        base
        + F.floor(F.lit(20) * matched / F.lit(len(tokens))).cast("int")
        + F.when(F.length("display") < 30, 5).otherwise(0)
    ).cast("int")


def _asked(queries: list[str]) -> list[tuple[str, str, list[str]]]:
    """Text, clean text and tokens of each query; a blank one raises :class:`InvalidArgument`."""
    asked = []
    for text in queries:
        clean = sanitize_query(text)
        tokens = query_tokens(clean)
        if not tokens:
            raise InvalidArgument("empty query")
        asked.append((text, clean, tokens))
    return asked


def may_match(queries: list[str]) -> Column:
    """Whether a symbol has the pieces of any query: every token is a piece of its names, signature
    or documentation. A cheap condition in generated code, before names are taken apart."""
    shown = F.lower(F.concat_ws(" ", "symbol_id", "namespace", "signature", "documentation"))
    return reduce(
        lambda a, b: a | b,
        [reduce(lambda a, b: a & b, [shown.contains(t) for t in tokens]) for _, _, tokens in _asked(queries)],
    )


def candidates(index: DataFrame, queries: list[str]) -> DataFrame:
    """Symbols that the stored token index leads to: ``repo_id, commit_sha, symbol_id``, those with a
    token for every token of any query. Prefixes reach the scan of the sorted index."""
    asked = _asked(queries)
    prefixes = sorted({t for _, _, tokens in asked for t in tokens})
    met = index.where(reduce(lambda a, b: a | b, [F.col("token").startswith(p) for p in prefixes]))
    flags = [F.max(F.col("token").startswith(p)).alias(f"p{i}") for i, p in enumerate(prefixes)]
    whole = reduce(
        lambda a, b: a | b,
        [reduce(lambda a, b: a & b, [F.col(f"p{prefixes.index(t)}") for t in tokens]) for _, _, tokens in asked],
    )
    return met.groupBy(*KEY, "symbol_id").agg(*flags).where(whole).select(*KEY, "symbol_id")


def narrowed(
    symbols: DataFrame,
    files: DataFrame | None = None,
    file_path: str | None = None,
    project: str | None = None,
    virtual: list[str] | None = None,
    decompiled: bool = True,
    tests: bool = True,
) -> DataFrame:
    """``symbols`` by where they are written, before any limit.

    ``file_path`` is a prefix and ``project`` a name, both in any case; ``virtual`` are the only
    paths that count; without ``decompiled`` and ``tests`` symbols of decompiled libraries and of
    test projects are left out. What looks at files needs ``files``; symbols of unknown files
    then do not count.
    """
    rows = symbols if decompiled else symbols.where(F.coalesce(F.col("is_decompiled"), F.lit(0)) == 0)
    if file_path is None and project is None and virtual is None and tests:
        return rows
    if files is None:
        raise InvalidArgument("files are required to narrow by path or project")
    if file_path is not None:
        files = files.where(F.lower("path").startswith(file_path.lower()))
    if project is not None:
        files = files.where(F.lower("project_name") == project.lower())
    if virtual is not None:
        files = files.where(F.lower("path").isin([p.lower() for p in virtual]))
    if not tests:
        files = files.where(~F.coalesce(is_test_path(F.col("path")), F.lit(False)))
    return rows.join(files.select(*KEY, "file_id"), [*KEY, "file_id"], "left_semi")


def search(
    symbols: DataFrame,
    queries: list[str],
    limit: int = 20,
    kinds: list[str] | None = None,
    namespace: str | None = None,
) -> DataFrame:
    """The best ``limit`` symbols of each snapshot for each query.

    A symbol matches when every query token is the prefix of one of its tokens; ``kinds`` and
    a case-insensitive ``namespace`` prefix narrow before the limit. Output: ``query, repo_id,
    commit_sha, symbol_id, score, rank, truncated``; ties go by symbol_id. All queries are
    answered in one scan: matches are decided in the row, and only the candidates of a
    partial top-k are shuffled. Blank queries raise :class:`InvalidArgument`.
    """
    asked = _asked(queries)
    rows = symbols
    if kinds:
        rows = rows.where(F.col("kind").isin([k.lower() for k in kinds]))
    if namespace:
        rows = rows.where(F.lower("namespace").startswith(namespace.lower()))
    rows = with_tokens(rows.where(may_match(queries)))
    single = sorted({t for _, _, tokens in asked for t in tokens if len(t) == 1})
    if single:
        own = with_tokens(symbols).select(*KEY, F.explode("tokens").alias("token"))
        first = F.substring("token", 1, 1)
        place = Window.partitionBy(*KEY, "c").orderBy("token")
        allowed = (
            own.withColumn("c", first)
            .where(F.col("c").isin(single))
            .distinct()
            .withColumn("n", F.row_number().over(place))
            .where(F.col("n") <= ONE_CHAR_TOKENS)
            .groupBy(*KEY)
            .agg(F.collect_set("token").alias("allowed"))
        )
        rows = rows.join(allowed, KEY, "left")

    def meets(p: str) -> Column:
        if len(p) == 1:
            return F.exists("tokens", lambda t: t.startswith(p) & F.coalesce(F.array_contains("allowed", t), F.lit(False)))
        return _any_starts("tokens", p)

    hits = F.array_compact(
        F.array(
            *(
                F.when(
                    reduce(lambda a, b: a & b, [meets(p) for p in tokens]),
                    F.struct(F.lit(text).alias("query"), _score(clean, tokens).alias("score")),
                )
                for text, clean, tokens in asked
            )
        )
    )
    found = rows.select(*KEY, "symbol_id", F.explode(hits).alias("hit")).select(
        "hit.query", *KEY, "symbol_id", "hit.score"
    )
    order = Window.partitionBy("query", *KEY).orderBy(F.desc("score"), "symbol_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit + 1)
    more = F.max("rank").over(Window.partitionBy("query", *KEY)) > limit
    return ranked.withColumn("truncated", more).where(F.col("rank") <= limit)


def resolve_names(symbols: DataFrame, names: list[str]) -> DataFrame:
    """What each name means in each snapshot where it has hits: ``query, repo_id, commit_sha,
    outcome, symbol_id, candidates``.

    ``resolved`` with the id for one hit, ``ambiguous`` with up to five candidates for more;
    no row means not found.
    """
    hits = search(symbols, names, limit=21)
    per = hits.groupBy("query", *KEY).agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "symbol_id"))).alias("all")
    )
    return per.select(
        "query",
        *KEY,
        F.when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("outcome"),
        F.when(F.col("n") == 1, F.col("all")[0]["symbol_id"]).alias("symbol_id"),
        F.array_join(F.transform(F.slice("all", 1, 5), lambda s: s["symbol_id"]), " | ").alias("candidates"),
    )


def suggestions(symbols: DataFrame, names: list[str]) -> DataFrame:
    """For names that nothing was found by: the three best symbols of their simple name, ``query,
    repo_id, commit_sha, symbol_id, rank``."""
    simple = {n: re.sub(r"\(.*$", "", n).rpartition(".")[2] or n for n in names}
    asked = sorted({s for s in simple.values() if query_tokens(sanitize_query(s))})
    if not asked:
        raise InvalidArgument("empty query")
    pairs = symbols.sparkSession.createDataFrame([(n, s) for n, s in simple.items()], "name string, query string")
    hits = search(symbols, asked, limit=3).join(pairs, "query")
    return hits.select(F.col("name").alias("query"), *KEY, "symbol_id", "rank")


def browse(symbols: DataFrame, kinds: list[str], limit: int = 50) -> DataFrame:
    """Symbols of some kinds in each snapshot, by full name: ``repo_id, commit_sha, symbol_id,
    kind, rank``; without kinds :class:`InvalidArgument`."""
    if not kinds:
        raise InvalidArgument("kinds are required without a query")
    order = Window.partitionBy(*KEY).orderBy("fqname", "symbol_id")
    return (
        symbols.where(F.col("kind").isin([k.lower() for k in kinds]))
        .select(*KEY, "symbol_id", "kind", F.row_number().over(order).alias("rank"))
        .where(F.col("rank") <= limit)
    )
