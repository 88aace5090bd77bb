"""The session analysis as one job: redact, parse, match, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import redact, trace
from ..session import cut_lineage


@dataclass
class Analysis:
    redactions: DataFrame
    stats: DataFrame
    tools: DataFrame
    digest: DataFrame
    signals: DataFrame


def analyse(raw: DataFrame) -> Analysis:
    """Analyse (session, pos, line) rows.

    Secrets are replaced before a line is parsed, so no table that follows holds
    them; ``redactions`` counts them per session.
    """
    clean = cut_lineage(redact.redact(raw, "line", "_clean", "redactions"))
    t = trace.build(clean.select("session", "pos", clean["_clean"].alias("line")))
    per_session = clean.groupBy("session").agg({"redactions": "sum"}).withColumnRenamed("sum(redactions)", "redactions")
    return Analysis(per_session, trace.session_stats(t), trace.tool_distribution(t), trace.digest(t), trace.process_findings(t))
