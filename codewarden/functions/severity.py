"""Severity ranks and the small decisions that hang on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names in rank order, CRITICAL = 0 ... INFO = 4.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
# Hotspot weight per severity.
HOTSPOT_WEIGHT = {"CRITICAL": 5, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}
# SARIF level per severity.
SARIF_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning",
               "LOW": "note", "INFO": "note"}
# Lens order in a report; other lenses come after these.
LENS_ORDER = ["security", "architecture", "quality"]
# Marker per severity in an inline comment.
SEVERITY_MARK = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🔵", "INFO": "⚪"}


def lookup(col: Column, table: dict, default=None) -> Column:
    """A small constant mapping as one CASE expression (no join)."""
    expr = None
    for key, value in table.items():
        expr = F.when(col == key, F.lit(value)) if expr is None else expr.when(
            col == key, F.lit(value))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def rank(severity: Column) -> Column:
    return lookup(severity, {s: i for i, s in enumerate(SEVERITIES)})


def from_rank(r: Column) -> Column:
    return lookup(r, dict(enumerate(SEVERITIES)))


def higher(a: Column, b: Column) -> Column:
    """The more severe of two severities."""
    return from_rank(F.least(rank(a), rank(b)))


def adjacent(a: Column, b: Column) -> Column:
    return F.abs(rank(a) - rank(b)) <= 1


def escalate(severity: Column) -> Column:
    """One step up; CRITICAL stays."""
    return from_rank(F.greatest(rank(severity) - 1, F.lit(0)))


def sarif_level(severity: Column) -> Column:
    return lookup(severity, SARIF_LEVEL)


def hotspot_weight(severity: Column) -> Column:
    return lookup(severity, HOTSPOT_WEIGHT)


def lens_rank(lens: Column) -> Column:
    return lookup(lens, {v: i for i, v in enumerate(LENS_ORDER)}, len(LENS_ORDER))
