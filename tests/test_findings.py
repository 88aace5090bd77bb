"""What is attached to findings: evidence of a batch, patches of their files."""

import random

from pyspark.sql import functions as F

from codewarden.operators import findings

CHANGED = "run_id int, filename string, patch string, file_ord long"


def by_hand(files, changed, diff, chars):
    """The evidence as one text: all parts joined, then cut."""
    parts = sorted((o, f"diff for {n}\n{p}") for n, p, o in changed if p and n in files)
    text = "\n\n".join(t for _, t in parts) if parts else diff
    return text[:chars] + findings.EVIDENCE_MARKER if len(text) > chars else text


def test_evidence_is_cut_where_the_whole_text_would_be(spark):
    """Parts that end right at the limit, files that share an order or come twice, and batches without a patch."""
    rng = random.Random(3)
    chars = 60
    names = [f"f{i}" for i in range(6)]
    changed, batches = {}, {}
    for run in range(40):
        changed[run] = [(n, rng.choice([None, "", "x" * rng.randint(1, 70), "y" * rng.randint(1, 8)]), rng.choice([1, i])) for i, n in enumerate(names)]
        changed[run] += changed[run][:1]
        batches[run] = [rng.sample(names, rng.randint(1, 6)) for _ in range(3)]
    for n in range(45, 53):  # the first part and its separator end around the limit
        changed[100 + n], batches[100 + n] = [("a", "x" * n, 1), ("b", "y", 2)], [["a", "b"]]
    c = spark.createDataFrame([(r, *x) for r, rows in changed.items() for x in rows], CHANGED)
    b = spark.createDataFrame([(r, i, f"{n}:1") for r, rows in batches.items() for i, names_ in enumerate(rows) for n in names_], "run_id int, batch long, location string")
    d = spark.createDataFrame([(r, f"whole {r} " * 9) for r in changed], "run_id int, diff string")
    got = {(r.run_id, r.batch): r.evidence for r in findings.batch_evidence(b, c, d, chars=chars).collect()}
    assert got == {(r, i): by_hand(set(f), changed[r], f"whole {r} " * 9, chars) for r, rows in batches.items() for i, f in enumerate(rows)}


def test_evidence_moves_patches_once_per_set_of_files(spark):
    """Texts are gathered by the files they show, never by batch."""
    c = spark.createDataFrame([(1, "a", "x" * 100000, 1)], CHANGED)
    b = spark.range(1000).select(F.lit(1).alias("run_id"), F.col("id").alias("batch"), F.lit("a:1").alias("location"))
    d = spark.createDataFrame([(1, "w")], "run_id int, diff string")
    e = findings.batch_evidence(b, c, d)
    assert e.filter(F.length("evidence") == findings.EVIDENCE_CHARS + len(findings.EVIDENCE_MARKER)).count() == 1000
    grouped = [x for x in e._jdf.queryExecution().optimizedPlan().toString().split("\n") if "collect_list" in x]
    assert grouped and not any("batch#" in x for x in grouped)


def test_evidence_values_are_worked_out_once_per_set_of_files(spark):
    """The function runs on the texts of two sets of files and one whole diff, never on that of a batch."""
    c = spark.createDataFrame([(1, "a", "xyz", 1), (1, "b", "v" * 9000, 2)], CHANGED)
    files = {**{i: "a" for i in range(400)}, **{i: "b" for i in range(400, 700)}, **{i: "none" for i in range(700, 900)}}
    b = spark.createDataFrame([(1, i, f"{n}:1") for i, n in files.items()] + [(2, 0, "a:1"), (3, 0, None)], "run_id int, batch long, location string")
    d = spark.createDataFrame([(1, "whole"), (2, None)], "run_id int, diff string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def size(x):
        calls.add(x is not None)
        return -1 if x is None else len(x)

    got = {(r.run_id, r.batch): r.n for r in findings.batch_evidence(b, c, d, take={"n": lambda e: size(e)}).collect()}
    by_file = {"a": len("diff for a\nxyz"), "b": findings.EVIDENCE_CHARS + len(findings.EVIDENCE_MARKER), "none": 5}
    assert got == {**{(1, i): by_file[n] for i, n in files.items()}, (2, 0): -1, (3, 0): -1}
    assert calls.value == 3
    whole = {(r.run_id, r.batch): r.evidence for r in findings.batch_evidence(b, c, d).collect()}
    assert (whole[1, 0], whole[1, 700], whole[2, 0], whole[3, 0]) == ("diff for a\nxyz", "whole", None, None)


def test_batched_rows_are_worked_out_once(spark):
    """The rows of the batches serve for their files and for the batches without any."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def number(x):
        calls.add(1)
        return x // 10

    c = spark.createDataFrame([(1, "a", "xyz", 1)], CHANGED)
    b = spark.range(200).select(F.lit(1).alias("run_id"), number("id").alias("batch"), F.when(F.col("id") < 100, "a:1").otherwise("b:1").alias("location"))
    d = spark.createDataFrame([(1, "w")], "run_id int, diff string")
    got = {r.batch: r.evidence for r in findings.batch_evidence(b, c, d).collect()}
    assert got == {i: "diff for a\nxyz" if i < 10 else "w" for i in range(20)}
    assert calls.value == 200


def test_patch_values_are_worked_out_once_per_file(spark):
    """The function runs for the two changed files and the empty text, never for a finding."""
    c = spark.createDataFrame([(1, "src/a.ts", "xyz", 1), (1, "b.ts", None, 2)], CHANGED)
    f = spark.createDataFrame([(1, i, p) for i, p in enumerate(["a.ts:1"] * 50 + ["b.ts:2", "none.ts:1"])], "run_id int, id int, location string")
    calls = spark.sparkContext.accumulator(0)

    def measured(p):
        @F.udf("int")
        def size(x):
            calls.add(1)
            return len(x)
        return size(p)

    got = {r.id: r.n for r in findings.attach_patch(f, c, take={"n": measured}).collect()}
    assert got == {**{i: 3 for i in range(50)}, 50: 0, 51: 0}
    whole = {r.id: r.patch for r in findings.attach_patch(f, c).collect()}
    assert whole == {**{i: "xyz" for i in range(50)}, 50: "", 51: ""}
