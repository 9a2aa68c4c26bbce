"""Ordinal and mixed models against dense versions on small tables."""

import itertools
import math
import random

import numpy as np
import pytest

from corpusloom.operators import regression as R


def blocks(seed, n=300, groups=12):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, g = rng.randrange(3), rng.choice("xyz"), rng.randrange(groups)
        y = min(4, max(0, round(a + (b == "y") + rng.gauss(0, 1.2) + (g % 3 - 1) * 0.6)))
        rows.append((a, b, y, f"p{g}", float(y - a), rng.random()))
    return rows + [(None, "x", 1, "p0", 0.0, 0.1), (1, None, 2, "p1", 1.0, 0.1), (1, "x", None, "p1", None, 0.1)]


SCHEMA = "a int, b string, y int, g string, d double, t double"


def ordinal_likelihood(theta, x, y, cuts):
    bounds = np.concatenate(([-np.inf], theta[:cuts], [np.inf]))
    eta = x @ theta[cuts:]
    cdf = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
    return np.log(cdf(bounds[y + 1] - eta) - cdf(bounds[y] - eta)).sum()


def climb(f, theta, sweeps=4000):
    """Maximum of a concave function by coordinate steps that shrink."""
    step, best = np.full(len(theta), 0.5), f(theta)
    for _ in range(sweeps):
        moved = False
        for i, s in itertools.product(range(len(theta)), (1, -1)):
            trial = theta.copy()
            trial[i] += s * step[i]
            with np.errstate(all="ignore"):
                v = f(trial)
            if v > best:
                theta, best, moved = trial, v, True
                step[i] *= 1.3
        if not moved:
            step /= 2
            if step.max() < 1e-9:
                break
    return theta, best


def test_ordinal_fit_is_the_maximum(spark):
    rows = blocks(1)
    fit = R.fit_ordinal(spark.createDataFrame(rows, SCHEMA), "y", [("a",), ("b",)])
    known = [r for r in rows if None not in r]
    x = np.array([[a == 1, a == 2, b == "y", b == "z"] for a, b, *_ in known], float)
    y = np.array([r[2] for r in known])
    theta, best = climb(lambda t: ordinal_likelihood(t, x, y, 4), np.array([-2.0, -0.5, 0.5, 2, 0, 0, 0, 0]))
    assert fit["converged"] and fit["n"] == len(known) and fit["params"] == 4
    assert abs(fit["log_likelihood"] - best) < 1e-6 and np.abs(fit["estimate"] - theta).max() < 1e-4
    # Standard errors: the inverse of the numeric Hessian at the maximum.
    h, k = 1e-4, len(theta)
    eye = np.eye(k) * h
    f = lambda t: ordinal_likelihood(t, x, y, 4)
    hess = np.array([[(f(theta + eye[i] + eye[j]) - f(theta + eye[i] - eye[j]) - f(theta - eye[i] + eye[j]) + f(theta - eye[i] - eye[j])) / (4 * h * h) for j in range(k)] for i in range(k)])
    assert np.allclose(fit["se"], np.sqrt(np.diag(np.linalg.inv(-hess))), rtol=1e-3)


def test_interaction_test_and_its_edges(spark):
    frame = spark.createDataFrame(blocks(2), SCHEMA)
    r = R.ordinal_interaction_test(frame, "y", "a", "b").first()
    assert r.df == 4 and r.k_additive == 4 and r.ll_interaction >= r.ll_additive and 0 < r.p <= 1 and r.converged
    # A pair of categories that no row has takes no degree of freedom.
    r = R.ordinal_interaction_test(frame.where("not (a = 2 and b = 'z')"), "y", "a", "b").first()
    assert r.df == 3 and r.k_interaction == 7
    empty = R.ordinal_interaction_test(frame.limit(0), "y", "a", "b").first()
    assert empty.n is None and empty.p is None and not empty.converged
    assert R.ordered_logit(frame.where("y = 1"), "y", [("a",)]).count() == 0


def test_separated_outcomes_end_unconverged(spark):
    rows = [(i % 2, "x", 3 * (i % 2), "p", 0.0, 0.0) for i in range(40)]
    fit = R.fit_ordinal(spark.createDataFrame(rows, SCHEMA), "y", [("a",)])
    assert not fit["converged"] and fit["log_likelihood"] > -1e-3


def reml(x, y, groups, cov):
    """Restricted likelihood and fit with dense matrices; ``cov(mask)`` is a group's relative covariance."""
    v = np.eye(len(y))
    for g in set(groups):
        m = np.flatnonzero(groups == g)
        v[np.ix_(m, m)] += cov(m)
    vi = np.linalg.inv(v)
    xx = x.T @ vi @ x
    beta = np.linalg.solve(xx, x.T @ vi @ y)
    r = y - x @ beta
    free = len(y) - x.shape[1]
    s2 = r @ vi @ r / free
    return -0.5 * (free * math.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xx)[1]), beta, np.sqrt(np.diag(np.linalg.inv(xx)) * s2)


def test_random_intercepts_equal_dense_gls(spark):
    rows = blocks(3, 80, 9) + [(0, "y", 1, "alone", 2.0, 0.5)]
    fit = R.fit_mixed(spark.createDataFrame(rows, SCHEMA), "d", "g", [("b",)])
    known = [r for r in rows if r[1] is not None and r[4] is not None]
    x = np.array([[1, b == "y", b == "z"] for _, b, *_ in known], float)
    y, g = np.array([r[4] for r in known]), np.array([r[3] for r in known])
    grid = np.exp(np.linspace(-12, 6, 2000))
    best = max(grid, key=lambda s: reml(x, y, g, lambda m: np.full((len(m), len(m)), s))[0])
    value, beta, se = reml(x, y, g, lambda m: np.full((len(m), len(m)), best))
    assert fit["criterion"] >= value - 1e-9 and fit["n"] == len(known) and fit["groups"] == 10
    exact = fit["random"][0, 0] / fit["residual"]
    value, beta, se = reml(x, y, g, lambda m: np.full((len(m), len(m)), exact))
    assert abs(fit["criterion"] - value) < 1e-6 and np.allclose(fit["estimate"], beta, atol=1e-8) and np.allclose(fit["se"], se, atol=1e-8)


def test_random_slopes_equal_dense_gls(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(14):
        a, b = rng.normal(0, 1), rng.normal(0.5, 0.4)
        rows += [(f"p{g}", int(t), float(a + b * t + rng.normal(0, 0.5))) for t in range(rng.integers(1, 8))]
    frame = spark.createDataFrame(rows, "g string, t int, y double")
    fit = R.fit_mixed(frame, "y", "g", [], ["t"], "t")
    x = np.array([[1, t] for _, t, _ in rows], float)
    y, g = np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    d = fit["random"] / fit["residual"]
    value, beta, se = reml(x, y, g, lambda m: x[m] @ d @ x[m].T)
    assert abs(fit["criterion"] - value) < 1e-6 and np.allclose(fit["estimate"], beta, atol=1e-8) and np.allclose(fit["se"], se, atol=1e-8)
    low = np.linalg.cholesky(d + 1e-12 * np.eye(2))
    for i, j in ((0, 0), (1, 0), (1, 1)):
        for h in (-1e-3, 1e-3):
            other = low.copy()
            other[i, j] += h
            assert reml(x, y, g, lambda m, o=other: x[m] @ o @ o.T @ x[m].T)[0] < value + 1e-7
    r = R.mixed_trend(frame, "y", "t", "g").first()
    assert r.method == "mixed" and abs(r.slope - beta[1]) < 1e-6 and r.low < r.slope < r.high


@pytest.mark.parametrize("rows, method, slope", [([("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 5.0)], "ols", 2.0), ([("a", 1, 1.0), ("b", 1, 3.0), ("c", 1, 5.0)], "none", None), ([], "none", None), ([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0), ("b", 1, 2.0)], "mixed", 1.0)])
def test_trend_edges(spark, rows, method, slope):
    r = R.mixed_trend(spark.createDataFrame(rows, "g string, t int, y double"), "y", "t", "g").first()
    assert (r.method, r.slope) == (method, slope)


def test_interaction_counts(spark):
    frame = spark.createDataFrame(blocks(5), SCHEMA)
    r = R.mixed_interaction(frame, "d", "a", "b", "g").first()
    assert r.n_interaction_terms == 4 and 0 <= r.n_ci_excludes_0 <= 4 and not r.singular
    assert R.mixed_interaction(frame.where("not (a = 2 and b = 'z')"), "d", "a", "b", "g").first().singular
    assert R.mixed_interaction(frame.where("g = 'p1'"), "d", "a", "b", "g").first().n == 0
    assert R.mixed_terms(frame.limit(0), "d", "g", [("b",)]).count() == 0


def test_too_many_levels_is_an_error(spark):
    frame = spark.range(300).selectExpr("cast(id as int) as a", "cast(id % 3 as int) as y")
    with pytest.raises(ValueError):
        R.fit_ordinal(frame, "y", [("a",)])
