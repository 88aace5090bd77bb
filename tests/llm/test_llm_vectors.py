"""Hard negatives and nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from codewarden.llm import hard_negatives, neighbours, queries

SCHEMA = "vec_id long, embedding array<float>, label int, g string, c int, v string"


def odd_rows(rng, n, dim, labels=4):
    """Random vectors with ties, repeats, odd rows and columns named like the operators' own."""
    rows = []
    for i in range(n):
        x = [float(np.float32(a)) for a in rng.normal(0, 0.5, dim)]
        rows.append((i, x if i % 9 else [0.5] * dim, int(rng.integers(labels)) if i % 3 else 1, "g", 0, "v"))
    rows += [rows[5], rows[200 % n], (n, None, 1, None, None, None), (n + 1, [None] * dim, 1, "", 1, ""), (n + 2, [math.nan] * dim, 2, "", 1, ""),
             (n + 3, [math.inf] + [0.0] * (dim - 1), 2, "", 1, ""), (None, [0.1] * dim, 1, "", 1, ""), (n + 4, [0.1] * dim, None, "", 1, ""),
             (n + 5, [0.0] * dim, 1, "", 1, ""), (n + 6, [], 1, "", 1, ""), (n + 7, [0.25], 1, "", 1, "")]
    return rows


def brute_negatives(rows, anchor, mining):
    taken = {}
    for i, x, label, *_ in rows:
        if i is not None and label is not None and x is not None and all(a is not None and math.isfinite(a) for a in x):
            taken[i] = min(taken.get(i, (9e9, [])), (label, [math.floor(mining.scale * a) for a in x]))
    out = []
    for i in filter(anchor, taken):
        label, x = taken[i]
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, other == label) for j, (other, y) in taken.items() if j != i)
        for p, j in [(-s, j) for s, j, same in scored if same][: mining.positives]:
            window = [(k, -s) for s, k, same in scored if not same and mining.low * p <= -100 * s <= mining.high * p][: mining.negatives]
            out += [(i, j, r + 1, k, p, s) for r, (k, s) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (64, 64, 64), (65, 33, 70), (300, 64, 513)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    a, b = rng.integers(-(1 << 24), 1 << 24, (m, k)), rng.integers(-(1 << 24), 1 << 24, (k, n))
    for leaf in (1, 4, 32):
        assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()


@pytest.mark.parametrize("sizes", [(4096, 4096), (25, 200)])
def test_negatives_by_brute_force(spark, sizes):
    rows = odd_rows(np.random.default_rng(3), 400, 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    mining = hard_negatives.Mining(3, 4, 20, 80, 64)
    got = hard_negatives.mine(df, "vec_id % 10 = 0", mining, group=sizes[0], chunk=sizes[1])
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 10 == 0, mining)


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(empty, "vec_id % 10 = 0").collect() == []
    alone = spark.createDataFrame([(0, [1.0], 1, "", 0, "")], SCHEMA)
    assert hard_negatives.mine(alone, "vec_id % 10 = 0").collect() == []
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(spark.createDataFrame([(i, [1e30], 1, "", 0, "") for i in range(3)], SCHEMA), "vec_id = 0").collect()


def test_negatives_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows = [(i, x, (y + 1) % 10 if i % 7 == 0 else y) for i, x, y in rows]
    got = queries.op11_hard_negatives(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 100 == 0, hard_negatives.Mining())


def brute_neighbours(rows, query, k):
    taken = {}
    for i, x, *_ in rows:
        if i is not None and x and all(a is not None and math.isfinite(a) for a in x) and any(x):
            taken[i] = min(taken.get(i, x), x)
    out = {}
    for i in filter(query, taken):
        near = sorted((float(np.sqrt(((np.array(taken[i]) - np.array(y)) ** 2).sum())), j) for j, y in taken.items() if j != i and len(y) == len(taken[i]))
        out[i] = [(round(s, 9), j) for s, j in near[:k]]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((round(r.score, 9), r.vec_id))
    return out


@pytest.mark.parametrize("width", [1, 5, 64])
def test_rotations_keep_lengths(width):
    x = neighbours.unit(np.random.default_rng(1).normal(size=(20, width)))
    y = neighbours.turned(x, 3)
    assert np.allclose((y**2).sum(axis=1), 2) and np.allclose(y @ y.T, 2 * x @ x.T)


@pytest.mark.parametrize("axes", [1, 2])
def test_probes_in_order(axes):
    x = neighbours.unit(np.random.default_rng(2).normal(size=(30, 6)))
    named = neighbours.buckets(x, 2, axes)
    for count in (1, 5, 16**axes):
        for i, found in enumerate(neighbours.probed(x, 2, neighbours.Probes(axes, count))):
            assert len(set(found.tolist())) == len(found) == 2 * count and set(named[i]) <= set(found.tolist())
            need = neighbours.places(x[i], x, 2, axes)
            assert [bool(set(row) & set(found.tolist())) for row in named] == (need <= count).tolist()


@pytest.mark.parametrize("probes,sizes", [((1, 16), (4096, 4096)), ((2, 256), (8, 64))])
def test_all_probes_give_all_neighbours(spark, probes, sizes):
    """With every bucket probed the search is exact, also for a vector that a ninth of the rows share."""
    rows = odd_rows(np.random.default_rng(4), 400, 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = neighbours.search(df, "vec_id % 10 = 0", neighbours.Search(4), probes=neighbours.Probes(*probes), group=sizes[0], chunk=sizes[1])
    assert by_query(got) == {i: n for i, n in brute_neighbours(rows, lambda i: i % 10 == 0, 4).items() if n}


def test_neighbours_of_nothing(spark):
    assert neighbours.search(spark.createDataFrame([], SCHEMA), "vec_id % 10 = 0").collect() == []
    alone = spark.createDataFrame([(0, [1.0], 1, "", 0, ""), (1, [1.0, 2.0], 1, "", 0, "")], SCHEMA)
    assert neighbours.search(alone, "vec_id = 0").collect() == []


def test_neighbours_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute_neighbours(rows, lambda i: i % 100 == 0, 10)
    got = by_query(queries.op13_neighbours(spark, "/root/testdata/sf0.1"))
    assert got.keys() == want.keys() and all(len(n) == 10 for n in got.values())
    found = sum(len(set(n) & set(want[i])) for i, n in got.items())
    assert found >= 0.9 * sum(map(len, want.values()))
