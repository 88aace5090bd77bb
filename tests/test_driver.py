import pytest

import __spark_entry__ as entry
from checks.compare import check

SMALL = "/root/testdata/sf0.001"
SAMPLE = ["path_classes", "exact_merge", "rules_encryption", "import_edges", "flow_paths", "unhandled_errors", "chunk_packing", "response_findings", "model_vote",
          "scan_findings", "flow_job", "sarif_files", "review_prompts", "packed_reviews", "custom_scanners", "corpus_folder", "scan_documents"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["repo", "domain", "files_scanned", "findings"] and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    outcome, _ = check(spark, SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert outcome.startswith("ok"), outcome
