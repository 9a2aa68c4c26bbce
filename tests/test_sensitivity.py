"""Bias factors and standardised differences against direct computations."""

import math
import random

import numpy as np

from corpusloom.operators import sensitivity as X


def plain_gamma(pos, neg, alpha=0.05):
    n, k = pos + neg, max(pos, neg)
    if n < 3:
        return None
    if pos == neg:
        return 1.0
    for i in range(101):
        g = 1 + 0.05 * i
        p = g / (1 + g)
        if sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1)) >= alpha:
            return round(g, 2)
    return 6.0


def test_bias_factor_in_both_directions(spark):
    pairs = [(a, b) for a in range(0, 40, 3) for b in range(0, 9)] + [(0, 30), (200, 3), (3, 200), (5, 5), (1, 1)]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", X.critical_bias(F.col("a"), F.col("b")).alias("g")).collect()
    assert [(r.a, r.b, r.g) for r in rows] == [(a, b, plain_gamma(a, b)) for a, b in pairs]


def test_differences_and_edges(spark):
    rng = random.Random(2)
    rows = [(f"p{rng.randrange(6)}", rng.randrange(2), rng.randrange(3), float(rng.randrange(-3, 4))) for _ in range(120)]
    rows += [(None, 0, 1, 1.0), ("p1", 0, None, 1.0), ("p1", 1, 1, None)] + [("p1", 7, m, 2.0) for m in (0, 0, 0, 0, 1, 1, 1, 1)] + [("p2", 8, 0, 1.0)] * 5
    got = {(r.from_stage, r.move): r for r in X.sensitivity_bounds(spark.createDataFrame(rows, "participant_id string, from_stage int, move int, delta double"), draws=50).collect()}
    assert not any(k[0] == 8 for k in got)
    # Neither side varies and one participant is all there is: no difference, no interval.
    assert got[7, 0].smd == 0 and got[7, 0].smd_ci_lo is None and got[7, 0].e_value == 1.0 and got[7, 0].gamma is None
    for stage, move in ((0, 0), (0, 1), (1, 2)):
        own = np.array([d for _, f, m, d in rows if f == stage and m == move and d is not None])
        rest = np.array([d for _, f, m, d in rows if f == stage and m is not None and m != move and d is not None])
        sd = math.sqrt((own.var(ddof=1) * (len(own) - 1) + rest.var(ddof=1) * (len(rest) - 1)) / (len(own) + len(rest) - 2))
        r = got[stage, move]
        assert abs(r.smd - (own.mean() - rest.mean()) / sd) < 1e-5 and r.n == len(own) and r.smd_ci_lo <= r.smd_ci_hi
        centred = own - rest.mean()
        assert r.gamma == plain_gamma(int((centred > 1e-9).sum()), int((centred < -1e-9).sum()))


def test_empty(spark):
    assert X.sensitivity_bounds(spark.createDataFrame([], "participant_id string, from_stage int, move int, delta double"), draws=5).count() == 0
