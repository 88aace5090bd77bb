import random

import numpy as np
import pytest

from codewarden.operators import packing


@pytest.mark.parametrize("seed", range(6))
def test_slices_pack_like_one_sequence(seed):
    r = random.Random(seed)
    limit = 20
    sizes = np.array([r.choice([0, 1, 3, 7, 12, 20, 25]) for _ in range(120)])
    whole = packing.pack_slice(sizes, limit, -1, 0)
    used, number, out = -1, 0, []
    for part in np.array_split(sizes, 9):
        out.extend(packing.pack_slice(part, limit, used, number))
        reach, bins, left = packing.slice_summary(part, limit)
        used, number = packing.slice_step(used, number, int(part.sum()), reach, bins, left, limit)
    assert out == whole.tolist() and number == whole[-1]


def test_chunks_of_a_split_group(spark, monkeypatch):
    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = [("hot" if i % 5 else "cold", f"p{i:04d}", "general", r.randrange(5), "x" * r.randrange(0, 400), i) for i in range(400)]
    df = spark.createDataFrame(rows, "repo string, path string, domain string, priority int, content string, n int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(x.repo, x.path): x.chunk_no for x in packing.pack_chunks(df, 200, "n").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(rows)
    for repo in ("hot", "cold"):
        used, number = -1, 0
        for _, path, _, _, content, _ in sorted((x for x in rows if x[0] == repo), key=lambda x: (x[3], x[5])):
            t = -(-len(content) // 4)
            if used < 0 or used + t > 170:
                used, number = 0, number + 1
            used += t
            assert got[repo, path] == number
    assert df.filter(F.col("repo") == "hot").count() == 320


def test_diff_skip_fit_equals_the_loop(spark):
    r = random.Random(8)
    rows = [(i % 2, f"{'auth' if r.random() < 0.2 else 'f'}{i}.ts", "modified", 1, 1, r.randrange(9), i, "p",
             None if i % 11 == 0 else "y" * r.randrange(1, 600), False) for i in range(120)]
    df = spark.createDataFrame(rows, "run_id int, filename string, status string, additions int, deletions int, changes int, file_ord int, "
                                     "patch string, section string, skipped boolean")
    got = {x.filename: x.fate for x in packing.pack_diff(df, 5200, salts=3).collect()}
    for run in (0, 1):
        mine = [x for x in rows if x[0] == run]
        listing = "\n".join(f"- {x[1]} (modified, +1/-1)" for x in mine)
        room, used = 1200 - -(-len(listing) // 4), 0
        for x in sorted(mine, key=lambda x: (not x[1].startswith("auth"), x[5], x[6])):
            t = None if x[8] is None else -(-len(x[8]) // 4)
            fits = t is not None and used + t <= room
            used += t if fits else 0
            assert got[x[1]] == ("packed" if fits else "summary")


def test_empty_files_need_no_summary():
    """A million files without tokens give one entry; a slice is packed as by a plain loop."""
    assert [len(x) for x in packing.slice_summary(np.zeros(1_000_000, np.int64), 100)] == [1, 1, 1]
    rng = np.random.default_rng(2)
    for _ in range(200):
        t = rng.choice([0, 0, 0, 1, 7, 30, 99, 100, 101], int(rng.integers(1, 40)))
        whole = packing.slice_summary(t, 100)
        for used in [-1, *range(0, 101, 7), 100]:
            level, number, bins = used, 3, []
            for x in t:
                if level < 0 or level + x > 100:
                    level, number = 0, number + 1
                level += x
                bins.append(number)
            assert packing.pack_slice(t, 100, used, 3).tolist() == bins
            assert packing.slice_step(used, 3, int(t.sum()), *whole, 100) == (level, number)
