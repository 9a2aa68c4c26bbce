"""Ward boundaries against the greedy definition."""

import itertools

import numpy as np
import pytest

from corpusloom.operators import topics as W


def greedy(x, clusters):
    """Merge the pair that costs least, again and again."""
    groups = [[i] for i in range(len(x))]
    while len(groups) > clusters:
        def cost(pair):
            a, b = (np.array([x[i] for i in groups[g]]) for g in pair)
            return len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()

        a, b = min(itertools.combinations(range(len(groups)), 2), key=cost)
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(6))
def test_equal_cuts_to_the_greedy_merges(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(int(rng.integers(2, 40)), 4)) + rng.integers(0, 3, size=1)
    for clusters in {1, 2, max(1, len(x) // 3), len(x)}:
        labels = W.ward_labels(x, clusters)
        assert {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels)} == greedy(x, clusters)


def test_equal_and_far_points():
    assert len(set(W.ward_labels(np.zeros((9, 3)), 4))) == 4
    assert W.ward_labels(np.array([[0.0], [9.0], [0.1], [9.1]]), 2).tolist() == [0, 1, 0, 1]


def test_sessions_of_a_table(spark):
    rows = [("a", i, [0.0, 1.0 if i < 6 else 5.0]) for i in range(12)] + [("b", i, [1.0, 1.0]) for i in range(3)] + [("c", 0, None), ("c", 1, [3.0, 0.0]), ("c", 2, [3.0, 0.0]), ("c", 3, None)]
    frame = spark.createDataFrame(rows, "session_id string, place long, vector array<double>")
    assert sorted((r.session_id, r.place) for r in W.topic_boundaries(frame).collect()) == [("a", 5), ("c", 0), ("c", 2)]
    assert W.topic_boundaries(frame.limit(0)).count() == 0
