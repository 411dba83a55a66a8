"""Schemas of the index relations, ordered vocabularies, id domains and request budgets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

S, I, L, B, TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SYMBOLS = _schema(
    ("repo_id", S), ("commit_sha", S), ("symbol_id", S), ("fqname", S), ("kind", S), ("file_id", S),
    ("span_start", I), ("span_end", I), ("signature", S), ("documentation", S), ("namespace", S),
    ("containing_type", S), ("visibility", S), ("confidence", S), ("stable_id", S), ("name_tokens", S),
    ("is_decompiled", I),
)
REFS = _schema(
    ("edge_seq", L), ("repo_id", S), ("commit_sha", S), ("from_symbol_id", S), ("to_symbol_id", S), ("ref_kind", S),
    ("file_id", S), ("loc_start", I), ("loc_end", I), ("resolution_state", S), ("to_name", S),
    ("to_container_hint", S), ("stable_from_id", S), ("stable_to_id", S), ("is_decompiled", I), ("indexed_at", TS),
)
FACTS = _schema(
    ("fact_seq", L), ("repo_id", S), ("commit_sha", S), ("symbol_id", S), ("stable_id", S), ("fact_kind", S),
    ("value", S), ("file_id", S), ("loc_start", I), ("loc_end", I), ("confidence", S),
)
FILES = _schema(
    ("repo_id", S), ("commit_sha", S), ("file_id", S), ("path", S), ("sha256", S), ("project_name", S),
    ("is_virtual", I), ("content", S),
)
TYPE_RELATIONS = _schema(
    ("repo_id", S), ("commit_sha", S), ("type_symbol_id", S), ("related_symbol_id", S), ("relation_kind", S),
    ("display_name", S), ("stable_type_id", S), ("stable_related_id", S),
)
BASELINES = _schema(
    ("repo_id", S), ("commit_sha", S), ("created_at", TS), ("size_bytes", L), ("is_current_head", B),
    ("is_active_workspace_base", B),
)
RELATIONS = {
    "symbols": SYMBOLS, "refs": REFS, "facts": FACTS, "files": FILES, "type_relations": TYPE_RELATIONS,
}

#: Ordered vocabularies; where the worst wins, the later one is worse.
SYMBOL_KINDS = [
    "Class", "Struct", "Interface", "Enum", "Delegate", "Record", "Method", "Property", "Field", "Event", "Constructor",
    "Constant", "Indexer", "Operator",
]
REF_KINDS = ["Call", "Read", "Write", "Instantiate", "Override", "Implementation"]
FACT_KINDS = [
    "Route", "Config", "DbTable", "DiRegistration", "Middleware", "Exception", "Log", "RetryPolicy", "RazorInject",
    "RazorParameter",
]
CONFIDENCES = ["High", "Medium", "Low"]
SEMANTIC_LEVELS = ["Full", "Partial", "SyntaxOnly"]
VISIBILITIES = ["Public", "Protected", "Internal", "ProtectedInternal", "PrivateProtected", "Private"]


class InvalidArgument(ValueError):
    """A request outside its domain."""


def commit_sha(value: str) -> str:
    """A commit id: 40 lower-case hexadecimal digits."""
    if not re.fullmatch(r"[0-9a-f]{40}", value or ""):
        raise InvalidArgument("commit_sha must be 40 lower-case hexadecimal digits")
    return value


def file_path(value: str) -> str:
    """A relative path with forward slashes and no ``..`` segment."""
    if not (value or "").strip() or "\\" in value or value.startswith("/") or ".." in value.split("/"):
        raise InvalidArgument("file path must be relative, with forward slashes and without '..'")
    if re.match(r"^[A-Za-z]:", value):
        raise InvalidArgument("file path must be relative")
    return value


def workspace_id(value: str) -> str:
    """A workspace name without separators or ``..``."""
    if not (value or "").strip() or "/" in value or "\\" in value or ".." in value:
        raise InvalidArgument("workspace id must not be blank or hold separators")
    return value


def stable_id(value: str) -> str:
    """A stable id: ``sym_`` and 16 hexadecimal digits."""
    if not re.fullmatch(r"sym_[0-9a-f]{16}", value or ""):
        raise InvalidArgument("stable id must be sym_ and 16 hexadecimal digits")
    return value


@dataclass(frozen=True)
class LimitApplied:
    """A request's limit and what became of it."""

    requested: int
    applied: int


@dataclass(frozen=True)
class Budget:
    """Limits of one request; requests above a hard cap are clamped and reported."""

    results: int = 20
    references: int = 50
    depth: int = 3
    lines: int = 120
    chars: int = 12_000

    #: Hard caps.
    CAPS = {"results": 100, "references": 500, "depth": 6, "lines": 400, "chars": 40_000}

    def clamped(self) -> tuple["Budget", dict[str, LimitApplied]]:
        """This budget within the caps, and the limits that were cut."""
        now, cuts = {}, {}
        for name, cap in self.CAPS.items():
            asked = getattr(self, name)
            now[name] = max(0, min(asked, cap))
            if now[name] != asked:
                cuts[name] = LimitApplied(asked, now[name])
        return Budget(**now), cuts
