"""Results that must be whole: nothing found is dropped on the way out."""

from __future__ import annotations

import pytest

from symlake.operators import context, references, trees
from symlake.sources import relations
from tests import helpers as h


def test_references_without_content_keep_a_null_excerpt(spark):
    refs = relations.refs(h.refs(spark, [{"to_symbol_id": "M:t", "file_id": f} for f in ("f1", "f2")]))
    files = relations.files(h.files(spark, [{"file_id": "f1", "path": "a.cs", "content": "one"}, {"file_id": "f2", "path": "b.cs"}]))
    got = references.with_excerpt(references.find(refs, files), files)
    assert {r["path"]: r["excerpt"] for r in got.collect()} == {"a.cs": "one", "b.cs": None}


def test_all_changes_are_rendered(spark):
    n = context.PART_LINES + 60
    changes = spark.createDataFrame([("r", 2, "Added", None, f"s{i:05}") for i in range(n)], "repo_id string, ord int, change_kind string, from_id string, to_id string")
    facts = spark.createDataFrame(
        [("r", 2, "Route", "Added", None, "GET /x"), ("r", 2, "Config", "Changed", "A:B|get", "A:B|bind"), ("r", 3, "DiRegistration", "Removed", "IA → A|Scoped", None)],
        "repo_id string, ord int, fact_kind string, change_kind string, from_value string, to_value string",
    )
    got = {(r["ord"], r["part"]): (r["n_changes"], r["body"].split("\n")) for r in context.render_changes(changes, facts).collect()}
    assert got[3, 1] == (1, ["- Removed DiRegistration: IA → A|Scoped"]) and got[2, 2][0] == n + 2
    assert got[2, 1][1] + got[2, 2][1] == ["- Added Route: GET /x", *(f"- Added: s{i:05}" for i in range(n)), "- Changed Config: A:B"]


@pytest.mark.parametrize("limit", [trees.LIMIT, 1])
def test_members_of_a_cycle_are_each_others_descendants(spark, limit):
    links = [("A", "B"), ("B", "C"), ("C", "A"), ("d", "B"), ("e", "d"), ("f", "A"), ("s", "s"), ("t", "s"), ("y", "x")]
    df = spark.createDataFrame([("g", *x) for x in links], "group string, node string, parent string")
    full = trees.hierarchies(df, limit).cache()
    got = h.rows(trees.descendants(full).drop("group"))
    ring = {
        "A": {"B": 1, "C": 1, "d": 2, "e": 3, "f": 1},
        "B": {"A": 1, "C": 1, "d": 1, "e": 2, "f": 2},
        "C": {"A": 1, "B": 1, "d": 2, "e": 3, "f": 2},
    }
    want = [(a, n, k) for a, below in ring.items() for n, k in below.items()] + [("d", "e", 1), ("s", "t", 1), ("x", "y", 1)]
    assert got == sorted(want, key=repr)
    assert {r["node"]: r["n_descendants"] for r in full.collect()} == {r["node"]: sum(a == r["node"] for a, *_ in got) for r in full.collect()}
