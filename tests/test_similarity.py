"""The similarity join against all pairs."""

import numpy as np
import pytest

from codewarden.operators import similarity


def table(spark, groups):
    rows = [(g, f"{g}{i:04}", sorted(s)) for g, sets in groups.items() for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, "g string, id string, words array<string>").repartition(3), rows


def brute(rows, threshold, strict):
    out = set()
    for g, a, x in rows:
        for h, b, y in rows:
            if g == h and a < b:
                s = len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 0
                if s > threshold if strict else s >= threshold:
                    out.add((g, a, b))
    return out


def random_sets(seed, n, vocabulary, most):
    rng = np.random.default_rng(seed)
    weight = 1 / np.arange(1, vocabulary + 1)
    sets = {frozenset(f"w{k}" for k in rng.choice(vocabulary, int(rng.integers(1, most + 1)), replace=False, p=weight / weight.sum())) for _ in range(n)}
    return sorted(sets, key=sorted)


@pytest.mark.parametrize("threshold,strict", [(0.5, False), (0.7, True), (0.8, True), (0.34, False)])
@pytest.mark.parametrize("hot", [2, 10, 1000])
def test_equals_all_pairs(spark, threshold, strict, hot):
    """With few sets to a word most words are hot; results never depend on that."""
    df, rows = table(spark, {"a": random_sets(1, 150, 12, 6), "b": random_sets(2, 100, 40, 9), "c": [{"x"}, {"x", "y"}, {"y"}, set()]})
    got = [tuple(r) for r in similarity.similar_sets(df, ["g"], threshold, strict, hot).collect()]
    assert len(set(got)) == len(got) and set(got) == brute(rows, threshold, strict)
    met = [(r.a, r.b) for r in similarity.candidates(df, ["g"], threshold, hot).collect()]
    assert len(set(met)) == len(met)


def test_a_word_that_all_sets_share(spark):
    """Candidates grow with the pairs above the threshold, not with the square of the sets."""
    sets = [{"common", f"u{i}"} for i in range(600)] + [{"common"}] + [{"common", f"p{i}", f"q{i}", *({"z"} if k else set())} for i in range(50) for k in (0, 1)]
    df, rows = table(spark, {"f": sets})
    found = {(r.a, r.b) for r in similarity.similar_sets(df, ["g"], 0.5, False).collect()}
    assert {(a, b) for _, a, b in brute(rows, 0.5, False)} == found
    assert similarity.candidates(df, ["g"], 0.5).count() <= 2 * len(found)
