"""Source folders and report documents on disk."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codewarden.sources import documents, folder


@pytest.fixture
def tree(tmp_path):
    files = {"src/a.ts": b"x", "src/deep/b.ts": "é".encode(), "node_modules/c.ts": b"x", "a/.git/d": b"x", "app.min.js": b"x", "Cargo.lock": b"x", "big.ts": b"y" * 102401,
             "bad.ts": b"caf\xe9", "empty.ts": b"", "z/dist.ts": b"d", "A/B.SVG": b"s"}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    os.symlink("/etc/hostname", tmp_path / "src/link.ts")
    os.symlink("/etc", tmp_path / "outside")
    return tmp_path


def test_folder_source(spark, tree):
    want = {"src/a.ts": (1, "x"), "src/deep/b.ts": (2, "é"), "big.ts": (102401, None), "bad.ts": (4, "caf�"), "empty.ts": (0, ""), "z/dist.ts": (1, "d")}
    for task_bytes in (1, 1 << 26):
        d = folder.read_folder(spark, str(tree), "r", task_bytes=task_bytes)
        assert {r.path: (r.size, r.content) for r in d.collect()} == want and {r.repo for r in d.collect()} == {"r"}
    assert folder.read_folder(spark, str(tree), "r", task_bytes=1).rdd.getNumPartitions() == len(want)


def test_skipped_folders_are_not_entered(spark, tree, monkeypatch):
    """What cannot be opened does not matter where nothing would be read."""
    real = os.scandir
    entered = []
    monkeypatch.setattr(folder.os, "scandir", lambda p: entered.append(str(p)) or real(p))
    names = [p for p, _ in folder.listing(str(tree))]
    assert names == ["bad.ts", "big.ts", "empty.ts", "src/a.ts", "src/deep/b.ts", "z/dist.ts"]
    assert not any("node_modules" in p or ".git" in p or "outside" in p for p in entered)
    assert folder.read_folder(spark, str(tree / "nothing"), "r").count() == 0


def test_files_are_dealt_by_size():
    files = [(str(i), 10 << 20) for i in range(10)] + [("big", 1 << 40)] + [(f"s{i}", 1) for i in range(100)]
    parts = folder.dealt(files, limit=1 << 30, task_bytes=32 << 20)
    assert [f for p in parts for f in p] == files
    assert all(sum(max(s if s <= 1 << 30 else 0, folder.OPEN) for _, s in p) <= 32 << 20 for p in parts) and len(parts) == 4


def parsed(path, ending=".json"):
    return {f.name[: -len(ending)]: json.loads(f.read_text()) for f in path.iterdir()}


def test_nested_documents(spark, tmp_path):
    heads = spark.createDataFrame([(1, '{"t":"a"}'), (2, "{}")], "run_id int, body string")
    items = spark.createDataFrame([(1, i, json.dumps({"i": i} if i else {})) for i in (2, 0, 1)], "run_id int, item long, body string")
    kids = spark.createDataFrame([(1, 1, s, json.dumps({"s": s})) for s in (7, 3)], "run_id int, item long, sub long, body string")
    d = documents.lines(heads, [documents.Section("rows", items, "kids", kids), documents.Section("plain", items)], "run_id")
    documents.write(d.repartition(5), str(tmp_path / "out"))
    assert parsed(tmp_path / "out") == {
        "1": {"t": "a", "rows": [{"kids": []}, {"i": 1, "kids": [{"s": 3}, {"s": 7}]}, {"i": 2, "kids": []}], "plain": [{}, {"i": 1}, {"i": 2}]},
        "2": {"rows": [], "plain": []}}


def finding(spark, runs):
    return spark.createDataFrame([(r, i, f"f{i % 3}", "HIGH", "c", "a.ts:4", "s", "d", "g", ["q"], 5) for r in runs for i in range(7)],
                                 "run_id int, ord long, id string, severity string, category string, location string, summary string, detail string, suggestion string, lenses array<string>, score int")


def test_logs_of_all_runs(spark, tmp_path):
    runs = spark.createDataFrame([(1, "main", None), (2, "dev", "x"), (3, "clean", None)], "run_id int, branch string, note string")
    path = tmp_path / "logs"
    documents.write(documents.sarif_document(runs, finding(spark, [1, 2])), str(path), ending=".sarif")
    logs = {k: v["runs"][0] for k, v in parsed(path, ".sarif").items()}
    assert {k: (len(v["tool"]["driver"]["rules"]), len(v["results"])) for k, v in logs.items()} == {"1": (3, 7), "2": (3, 7), "3": (0, 0)}
    assert [logs[k]["invocations"][0]["properties"] for k in "123"] == [{"branch": "main"}, {"branch": "dev", "note": "x"}, {"branch": "clean"}]


def test_a_failed_job_changes_nothing(spark, tmp_path):
    path = tmp_path / "logs"
    runs = spark.createDataFrame([(1,), (2,)], "run_id int")
    documents.write(documents.sarif_document(runs, finding(spark, [1, 2])), str(path))
    before = parsed(path)
    broken = documents.sarif_document(runs, finding(spark, [1, 2])).withColumn("text", F.when(F.col("run_id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        documents.write(broken, str(path))
    assert parsed(path) == before
    documents.write(documents.sarif_document(runs.limit(0), finding(spark, [])), str(path))
    assert parsed(path) == {}


def test_documents_are_read_in_splits(spark, tmp_path):
    """Items come back with their section and number, also where a file is cut; no row holds a whole document."""
    runs = spark.createDataFrame([(1, "main"), (2, "none")], "run_id int, branch string")
    path = str(tmp_path / "logs")
    documents.write(documents.sarif_document(runs, finding(spark, [1])), path, ending=".sarif")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        assert spark.read.text(path).select(F.max(F.length("value"))).first()[0] < 1000
        items, frames = documents.read_flat(spark, path)
        got = sorted((r.name, r.section, r.n, json.loads(r.body)) for r in items.collect())
        log = json.loads((tmp_path / "logs/1.sarif").read_text())["runs"][0]
        assert got == [("1", 1, i, x) for i, x in enumerate(log["tool"]["driver"]["rules"], 1)] + [("1", 2, i, x) for i, x in enumerate(log["results"], 1)]
        assert {r.name: len(r.frame) for r in frames.collect()} == {"1": 3, "2": 3}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_items_without_commas_are_no_document(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text('{"t":1,"rows":[\n{"i":0}\n{"i":1}\n]\n}\n')
    (tmp_path / "d/b.json").write_text('{"t":1,"rows":[\n{"i":0}\n,{"i":1}\n]\n}\n')
    items, frames = documents.read_flat(spark, str(tmp_path / "d"))
    assert sorted((r.name, r.section, r.n, r.body) for r in items.collect()) == [("b", 1, 1, '{"i":0}'), ("b", 1, 2, '{"i":1}')]
    assert {r.name: r.frame for r in frames.collect()} == {"a": None, "b": ['{"t":1,"rows":[', "]", "}"]}


def test_many_small_files_do_not_make_as_many_tasks():
    files = [(f"f{i:06}", 100) for i in range(100_000)]
    parts = folder.dealt(files, limit=1 << 30, task_bytes=1 << 20)
    assert [f for p in parts for f in p] == files and len(parts) <= 1100
    assert len(folder.dealt(files[:1000], limit=1 << 30, task_bytes=1 << 20)) == 63
