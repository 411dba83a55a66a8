"""The merge of snapshots into versions: any cut of the stream into batches gives the same."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from symlake.operators import history

NAMES = ["repo_id", "id", "ord", "a", "b"]


def brute(rows):
    """Versions of rows of (repo, id, ord, a, b), entity by entity."""
    out = []
    least = {}
    for repo, key, at, *payload in rows:
        k = (repo, key, at)
        rank = [(p is not None, p or "") for p in payload]
        if k not in least or rank < least[k][0]:
            least[k] = (rank, payload)
    for repo, key in sorted({k[:2] for k in least}):
        number, last = 0, None
        for at in sorted(k[2] for k in least if k[:2] == (repo, key)):
            payload = least[repo, key, at][1]
            if last and last[4] == at - 1 and last[6:] == payload:
                last[4], last[5] = at, last[5] + 1
            else:
                number += 1
                last = [repo, key, number, at, at, 1, *payload]
                out.append(last)
    return [tuple(r) for r in out]


@pytest.mark.parametrize("seed", range(6))
def test_versions_whatever_the_batches(seed):
    random.seed(seed)
    value = lambda: random.choice([None, "", "x", "y"])
    rows = [(random.choice("rs"), f"k{random.randrange(5)}", random.randrange(1, 9), value(), random.choice([None, "p"])) for _ in range(150)]
    rows += rows[:20]
    null_first = lambda v: (v is not None, v or "")
    rows.sort(key=lambda r: (*r[:3], null_first(r[3]), null_first(r[4])))
    for size in (1, 2, 7, 1000):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        schema = pa.schema([("repo_id", pa.string()), ("id", pa.string()), ("ord", pa.int32()), ("a", pa.string()), ("b", pa.string())])
        batches = [pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in p], schema) for p in parts]
        batches.insert(1, batches[0].slice(0, 0))
        got = [tuple(r.values()) for b in history.closed_versions(["repo_id", "id"], ["a", "b"])(iter(batches)) for r in b.to_pylist()]
        assert got == brute(rows)
    assert list(history.closed_versions(["repo_id", "id"], ["a"])(iter([]))) == []
