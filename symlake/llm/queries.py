"""Queries of the text problems (p2, p7-p10) and the SQL twins of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.llm import bpe, handwritten, mixing, pairs, spam, sql
from symlake.session import spread, table


def _read(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, over all cores: the operators here cost more than moving a small one."""
    return spread(table(spark, d, name).select(*columns))


PLACE = ["repo_id", "commit_sha", "file_id"]
SYMBOL = [*PLACE, "span_start", "symbol_id", "kind", "signature", "documentation", "containing_type"]
SOURCE = [*PLACE, "path", "content"]
FILE = ["file_id", "path", "is_virtual", "project_name", "content"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.documented_symbols(table(spark, d, "symbols").select(*SYMBOL), _read(spark, d, "files", *SOURCE))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.symbol_pairs(table(spark, d, "symbols").select(*SYMBOL), _read(spark, d, "files", *SOURCE))


def p2_origins(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_origins(table(spark, d, "symbols").select(*SYMBOL), _read(spark, d, "files", *SOURCE))


def p2_source_pairs(spark: SparkSession, d: str) -> DataFrame:
    files = _read(spark, d, "files", "file_id", "path", "content").withColumnRenamed("file_id", "source_id")
    return pairs.pairs_from_sources(files)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(_read(spark, d, "files", *FILE))


def p7_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = handwritten.verdicts(_read(spark, d, "files", *FILE)).where("verdict is not null")
    return rows.groupBy("verdict").agg(
        F.count_distinct("file_id").alias("n_files"),
        F.count_distinct(F.when(F.col("layout_verdict").isNotNull(), F.col("file_id"))).alias("n_by_layout"),
    )


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(_read(spark, d, "documents", "doc_id", "text"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(_read(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(_read(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))[1]


def p9_full_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents", "doc_id", "source", "text")
    return mixing.mixture(docs, table(spark, d, "mix_targets"), mixing.AVAILABLE)[0]


def p9_full_shares(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents", "doc_id", "source", "text")
    return mixing.mixture(docs, table(spark, d, "mix_targets"), mixing.AVAILABLE)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(_read(spark, d, "documents", "doc_id", "text")).select("doc_id").distinct()


def p10_kinds(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(_read(spark, d, "documents", "doc_id", "text")).groupBy("kind").agg(F.count("*").alias("n_docs"))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found,
        p2_pairs,
        p2_origins,
        p2_source_pairs,
        p7_found,
        p7_verdicts,
        p8_ids,
        p9_mix,
        p9_shares,
        p9_full_mix,
        p9_full_shares,
        p10_found,
        p10_kinds,
    )
}

SQL = sql.SQL
