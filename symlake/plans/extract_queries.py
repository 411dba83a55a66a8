"""Queries of the source text extractors over all stored contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlake.operators import extract as x
from symlake.plans import extract_sql
from symlake.session import table
from symlake.sources import relations


def _files(spark: SparkSession, d: str) -> DataFrame:
    return relations.files(table(spark, d, "files"), ["path", "content"], "content is not null")


def extract_facts(spark: SparkSession, d: str) -> DataFrame:
    return x.extract_facts(_files(spark, d))


def extract_symbols(spark: SparkSession, d: str) -> DataFrame:
    return x.extract_symbols(_files(spark, d))


def extract_relations(spark: SparkSession, d: str) -> DataFrame:
    return x.extract_relations(_files(spark, d))


def extract_document_facts(spark: SparkSession, d: str) -> DataFrame:
    return x.extract_facts(_documents_as_files(spark, d)).groupBy("fact_kind").agg(
        F.count("*").alias("n_facts"), F.count_distinct("file_id").alias("n_documents")
    )


def extract_calls(spark: SparkSession, d: str) -> DataFrame:
    return x.extract_calls(_files(spark, d))


def _documents_as_files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id is not null")
    ending = F.element_at(
        F.create_map(*(F.lit(v) for v in ("csharp", "cs", "vb", "vb", "fsharp", "fs", "sql", "sql"))), F.lower("lang")
    )
    return docs.select(
        F.lit("documents").alias("repo_id"),
        F.lit("").alias("commit_sha"),
        F.col("doc_id").cast("string").alias("file_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit("."), F.coalesce(ending, F.lit("txt"))).alias("path"),
        F.col("text").alias("content"),
    )


def extract_document_symbols(spark: SparkSession, d: str) -> DataFrame:
    return x.extract_symbols(_documents_as_files(spark, d)).select("file_id", "line", "kind", "name", "namespace")


def extract_sql_tables(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.lower("lang") == "sql")
    return docs.select("doc_id", F.explode(x.sql_tables(F.col("text"))).alias("table_name"))


SQL = extract_sql.SQL
QUERIES = {
    f.__name__: f
    for f in (
        extract_document_facts,
        extract_facts,
        extract_symbols,
        extract_relations,
        extract_calls,
        extract_document_symbols,
        extract_sql_tables,
    )
}
