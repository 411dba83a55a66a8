"""Parts of fact values; each kind has a small format of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARROW = " → "


def before_pipe(value: Column) -> Column:
    """Left of the first pipe, trimmed."""
    return F.trim(F.substring_index(value, "|", 1))


def after_pipe(value: Column, default: str | None = None) -> Column:
    """Right of the first pipe; ``default`` without one."""
    return F.when(value.contains("|"), F.regexp_replace(value, r"^[^|]*\|", "")).otherwise(F.lit(default))


def route_method(value: Column) -> Column:
    """Method of ``METHOD /path``."""
    return F.substring_index(value, " ", 1)


def route_path(value: Column) -> Column:
    """Path of ``METHOD /path``; empty without a blank."""
    return F.when(value.contains(" "), F.regexp_replace(value, r"^[^ ]* ", "")).otherwise("")


def table_schema(name: Column) -> Column:
    """Schema of ``schema.table``; null without one."""
    return F.when(name.contains("."), F.substring_index(name, ".", 1))


def table_name(name: Column) -> Column:
    """Table of ``[schema.]table``."""
    return F.when(name.contains("."), F.regexp_replace(name, r"^[^.]*\.", "")).otherwise(name)


def registration(value: Column) -> dict[str, Column]:
    """Service, implementation and lifetime of ``Service → Impl|Lifetime[|HostedService]``."""
    bare = F.regexp_replace(value, r"\|HostedService$", "")
    pair = F.when(bare.contains("|"), F.regexp_replace(bare, r"\|[^|]*$", "")).otherwise(bare)
    return {
        "service": F.trim(F.split_part(pair, F.lit("→"), F.lit(1))),
        "implementation": F.trim(F.split_part(pair, F.lit("→"), F.lit(2))),
        "lifetime": F.when(bare.contains("|"), F.substring_index(bare, "|", -1)),
        "hosted": value.endswith("|HostedService"),
    }


def middleware_position(value: Column) -> Column:
    """N of ``Name|pos:N[|terminal]``; null without a number."""
    return F.regexp_extract(value, r"\|pos:(\d{1,9})", 1).try_cast("int")


def diff_key(kind: Column, value: Column) -> Column:
    """What identifies a fact between snapshots, apart by kind."""
    key = (
        F.when(kind == "Route", value)
        .when(kind.isin("Config", "DbTable"), F.substring_index(value, "|", 1))
        .when(kind == "DiRegistration", F.trim(F.split_part(value, F.lit("→"), F.lit(1))))
        .otherwise(value)
    )
    return F.concat(kind, F.lit(":"), key)
