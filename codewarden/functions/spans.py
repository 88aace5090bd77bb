"""Positions of regex matches and piecewise rewriting, without leaving the JVM.

Spark can list matches and can split on a pattern; putting the two lists side
by side gives every match its place in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def matches(content: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))


def places(content: Column, pattern: str) -> Column:
    """array<struct<line, offset>>: 1-based line and 0-based offset per match."""
    found = matches(content, pattern)
    gaps = F.slice(F.split(content, pattern), F.lit(1), F.size(found))
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(
        newlines(g).alias("gl"), newlines(m).alias("ml"), F.length(g).alias("gc"), F.length(m).alias("mc")))
    empty = F.array().cast("array<struct<line:int,offset:int>>")
    folded = F.aggregate(
        steps, F.struct(F.lit(1).alias("line"), F.lit(0).alias("pos"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["line"] + x["gl"] + x["ml"]).alias("line"), (acc["pos"] + x["gc"] + x["mc"]).alias("pos"),
            F.array_append(acc["out"], F.struct((acc["line"] + x["gl"]).alias("line"),
                                                (acc["pos"] + x["gc"]).alias("offset"))).alias("out")))
    return folded["out"]


def match_lines(content: Column, pattern: str) -> Column:
    return places(content, pattern)["line"]


def rewrite(content: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Replace every match by ``change(match)``; text between stays."""
    gaps = F.split(content, pattern)
    changed = F.array_append(F.transform(matches(content, pattern), change), F.lit(""))
    return F.array_join(F.zip_with(gaps, changed, lambda g, m: F.concat(g, m)), "")
