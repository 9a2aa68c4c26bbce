"""Rank trends against all pairs laid out."""

import time

import numpy as np
import pytest

from corpusloom.operators import trends as R


@pytest.mark.parametrize("n", [0, 1, 2, 31, 32, 33, 100, 401, 402])
def test_pairs_and_slopes_equal_the_plain_ones(n, monkeypatch):
    rng = np.random.default_rng(n)
    for y in (rng.integers(0, 9, n).astype(float), rng.normal(size=n), np.zeros(n), np.arange(n) * -0.5):
        i, j = np.triu_indices(n, 1)
        assert R.ordered_pairs(y) == (int((y[j] > y[i]).sum()), int((y[j] < y[i]).sum()))
        want = float(np.median((y[j] - y[i]) / (j - i))) if n > 1 else 0.0
        monkeypatch.setattr(R, "PAIRS", 0)
        assert abs(R.median_slope(y) - want) < 1e-9
        monkeypatch.setattr(R, "PAIRS", 1 << 16)
        assert abs(R.median_slope(y) - want) < 1e-9


def test_a_million_values_count_quickly():
    began = time.process_time()
    n = 1_000_000
    assert R.ordered_pairs(np.arange(n)[::-1]) == (0, n * (n - 1) // 2)
    assert time.process_time() - began < 30


def test_groups_of_a_table(spark):
    rows = [("a", t, float(t)) for t in range(8)] + [("b", 1, 2.0)] + [("c", t, 5.0) for t in range(4)] + [("d", None, 1.0), ("a", 9, None)]
    got = {r.g: r for r in R.mann_kendall(spark.createDataFrame(rows, "g string, t int, y double"), "g", "t", "y").collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].s, got["a"].tau, got["a"].sen) == (28.0, 1.0, 1.0) and got["a"].p < 0.001
    assert (got["b"].n, got["b"].s, got["b"].p) == (1, 0.0, 1.0) and (got["c"].tau, got["c"].sen, got["c"].p) == (0.0, 0.0, 1.0)
