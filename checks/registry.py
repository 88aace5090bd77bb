"""All driver queries in one place."""

from __future__ import annotations

import importlib

MODULES = ["findings_checks", "files_checks", "graph_checks", "trace_checks", "ingest_checks", "job_checks"]


def _modules():
    for name in MODULES:
        try:
            yield importlib.import_module(f"checks.{name}")
        except ModuleNotFoundError as err:
            if name not in str(err):
                raise


def queries():
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracles():
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}
