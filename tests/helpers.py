"""Small hand-made relations."""

from __future__ import annotations

from datetime import datetime, timedelta

from symlake import schemas

START = datetime(2024, 1, 1)


def frame(spark, schema, rows):
    """Rows given as dicts; columns not named are null."""
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def symbols(spark, rows):
    base = {
        "repo_id": "r", "commit_sha": "c1", "kind": "Method", "file_id": "f1", "span_start": 1, "span_end": 2,
        "visibility": "Public", "confidence": "High", "is_decompiled": 0,
    }
    return frame(spark, schemas.SYMBOLS, [base | r for r in rows])


def refs(spark, rows):
    base = {"repo_id": "r", "commit_sha": "c1", "ref_kind": "Call", "file_id": "f1", "loc_start": 1, "is_decompiled": 0}
    return frame(spark, schemas.REFS, [base | {"edge_seq": i} | r for i, r in enumerate(rows)])


def facts(spark, rows):
    base = {"repo_id": "r", "commit_sha": "c1", "symbol_id": "M:N.A.F", "file_id": "f1", "confidence": "High"}
    return frame(spark, schemas.FACTS, [base | {"fact_seq": i} | r for i, r in enumerate(rows)])


def files(spark, rows):
    base = {"repo_id": "r", "commit_sha": "c1", "sha256": "aa", "is_virtual": 0}
    return frame(spark, schemas.FILES, [base | r for r in rows])


def type_relations(spark, rows):
    base = {"repo_id": "r", "commit_sha": "c1", "relation_kind": "BaseType"}
    return frame(spark, schemas.TYPE_RELATIONS, [base | r for r in rows])


def baselines(spark, shas, repo="r"):
    rows = [
        {"repo_id": repo, "commit_sha": s, "created_at": START + timedelta(days=i), "size_bytes": 10, "is_current_head": i == len(shas) - 1, "is_active_workspace_base": False}
        for i, s in enumerate(shas)
    ]
    return frame(spark, schemas.BASELINES, rows)


def snapshots(spark, shas, repo="r"):
    return spark.createDataFrame(
        [(repo, s, START + timedelta(days=i), i + 1) for i, s in enumerate(shas)],
        "repo_id string, commit_sha string, created_at timestamp, ord int",
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
