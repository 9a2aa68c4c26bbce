"""Mixed fits over patterns of groups: as many rows as patterns, and the same fit on the driver and by jobs."""

import random

import numpy as np
import pytest

from corpusloom.operators import regression as R


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(4)
    rows = [(f"g{g}", float(t), rng.choice("ab"), 0.3 * t + rng.gauss(0, 1) + g % 5) for g in range(90) for t in range(1, 3 + g % 3)]
    return spark.createDataFrame([*rows, (None, 1.0, "a", 2.0), ("g0", None, "a", 2.0)], "g string, t double, b string, y double")


def test_groups_of_one_pattern_are_one_row(frame):
    rows = frame.dropna()
    patterns, _, n = R._group_products(rows, R.design(rows, [], ["t"]), "y", "g", "t")
    got = {tuple(r.zz): (r.n, r.m) for r in patterns.collect()}
    assert n == 270 and {k: v[0] for k, v in got.items()} == {(2.0, 3.0, 3.0, 5.0): 30, (3.0, 6.0, 6.0, 14.0): 30, (4.0, 10.0, 10.0, 30.0): 30}
    pdf = rows.toPandas()
    for g, of in pdf.groupby("g"):
        of = np.stack([np.ones(len(of)), of["t"], of["y"]])
        zx = (of[:2] @ of.T).ravel()
        got[tuple((of[:2] @ of[:2].T).ravel())][1][:] -= np.outer(zx, zx).ravel()
    assert all(np.allclose(m, 0, atol=1e-6) for _, m in got.values())


@pytest.mark.parametrize("slope", [None, "t"])
def test_fit_by_jobs_is_that_on_the_driver(frame, monkeypatch, slope):
    fit = R.fit_mixed(frame, "y", "g", [("b",)], ["t"], slope, tolerance=0.05)
    monkeypatch.setattr(R, "HELD_SUMS", 0)
    again = R.fit_mixed(frame, "y", "g", [("b",)], ["t"], slope, tolerance=0.05)
    assert fit["groups"] == again["groups"] == 90 and fit["n"] == 270
    assert np.allclose(fit["estimate"], again["estimate"]) and np.allclose(fit["se"], again["se"]) and np.isclose(fit["criterion"], again["criterion"])
