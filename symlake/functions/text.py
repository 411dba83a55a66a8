"""Spelling-insensitive forms of index columns. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, including the Unicode separators.
SPACE = "[\\s\\p{Z}\\x{85}\\x{FEFF}\\x{200B}]"


def squeeze(c: Column) -> Column:
    """White space runs of any kind to one blank, ends trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def fold(c: Column) -> Column:
    """Lower case without surrounding white space; null stays null."""
    return F.lower(squeeze(c))


def code128(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit codes of a key: its integer form for shuffles and bitmaps.

    With 1e10 keys the chance of any 128-bit collision is below 1e-18.
    """
    return F.xxhash64(*cols), F.xxhash64(F.lit("symlake"), *reversed(cols))


def definition_id(c: Column) -> Column:
    """Constructed generic ids in definition form: ``T:N.Pair{A,B{C}}`` to ``T:N.Pair`2``.

    Counts the arguments of each outermost brace pair at any nesting depth. Parameter lists
    of methods keep their braces (they are part of the id).
    """
    step = lambda acc, ch: (
        F.when(
            ch == "{",
            F.struct(
                (acc["depth"] + 1).alias("depth"),
                F.when(acc["depth"] == 0, F.lit(1)).otherwise(acc["args"]).alias("args"),
                acc["out"].alias("out"),
            ),
        )
        .when(
            (ch == "}") & (acc["depth"] > 0),
            F.struct(
                (acc["depth"] - 1).alias("depth"),
                acc["args"].alias("args"),
                F.when(
                    acc["depth"] == 1,
                    F.concat(acc["out"], F.lit("`"), acc["args"].cast("string")),
                )
                .otherwise(acc["out"])
                .alias("out"),
            ),
        )
        .otherwise(
            F.struct(
                acc["depth"].alias("depth"),
                F.when((ch == ",") & (acc["depth"] == 1), acc["args"] + 1)
                .otherwise(acc["args"])
                .alias("args"),
                F.when(acc["depth"] == 0, F.concat(acc["out"], ch)).otherwise(acc["out"]).alias("out"),
            )
        )
    )
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("args"), F.lit("").alias("out"))
    parsed = F.aggregate(F.split(c, ""), start, step, lambda acc: acc["out"])
    return F.when(c.contains("{") & ~c.contains("("), parsed).otherwise(c)


def type_id_of(fqname: Column) -> Column:
    """Documentation-comment id of a type's full name: ``N.Pair<T, U>`` to ``T:N.Pair`2``."""
    braces = F.translate(fqname, "<>", "{}")
    return definition_id(F.concat(F.lit("T:"), braces))


def strip_global(c: Column) -> Column:
    """A type name without its optional ``global::`` prefix; blank becomes null."""
    bare = F.regexp_replace(F.trim(c), "^global::", "")
    return F.when(bare != "", bare)
