"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
Every query runs to completion over its whole tables (noop sink).  Before the
clock starts the tables are written once as many files, as a large table would
be: a file with one row group is one task, whatever the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "path_classes", "chunk_packing", "domain_coverage", "rules_phi_in_logs", "rules_encryption", "rules_audit_trail", "rules_all",
    "secret_redaction", "import_edges", "runtime_flows", "exact_merge", "review_merge", "scan_merge", "model_vote", "baseline_split",
    "hotspots", "severity_counts", "flow_paths", "pr_neighbourhood", "endpoint_status", "session_stats", "retry_storms", "dead_ends",
    "unhandled_errors", "digest_lines", "response_status", "response_findings", "diff_packing", "sarif_results",
]


TABLES = ("documents", "events", "pages", "labels", "conversations", "benchmark")


def many_files(spark, sf_dir: str, files: int) -> str:
    """The same rows as ``files`` files for each table."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from checks.registry import queries
    from codewarden.session import local_session

    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    table = queries()
    scale, sf_dir = sf_dir.rsplit("sf", 1)[-1], many_files(spark, sf_dir, 4 * int(cpus))
    names = sys.argv[1:] or HEADLINE
    # Start the JVM, the Python workers and the file cache outside the clock.
    table["severity_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    table["inference"](spark, sf_dir).limit(1).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        table[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": scale}))


if __name__ == "__main__":
    main()
