"""Small operators that no query carries: folds, test sets, numbering, tails."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.operators import models as O
from corpusloom.operators.lineage import numbered
from corpusloom.sources import frameworks as W


def test_nodes_without_a_fold_get_one_of_their_own(spark):
    nodes = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("c", None), ("d", "p9")], "id string, who string")
    folds = spark.createDataFrame([("p1", 0), ("p2", 2)], "who string, fold int")
    got = {r.id: r.fold for r in O.resolved_folds(nodes, folds, "who", "id", 3).collect()}
    assert got["a"] == 0 and got["b"] == 2 and got["c"] in range(3) and got["d"] in range(3)


def test_test_sets_are_counted(spark):
    items = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1")], "name string, item_id string")
    assert {r.name: r.n_items for r in W.test_sets(items).collect()} == {"x": 2, "y": 1}


def test_numbers_follow_the_order_over_all_ranges(spark):
    rows = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5003).alias("x"))
    got = sorted((r.x, r.n) for r in numbered(rows, [F.col("x")], "n").collect())
    assert [n for _, n in got] == list(range(1, 5001))
    assert numbered(rows.limit(0), [F.col("x")], "n").count() == 0


def test_tails_of_distributions(spark):
    for n, k, p in ((10, 7, 0.5), (200, 130, 0.6), (30, 1, 0.01), (100, 50, 0.9)):
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1))
        assert abs(S.binomial_upper(k, n, p) - want) < 1e-9
    assert S.binomial_upper(0, 5, 0.5) == 1.0 and S.binomial_upper(6, 5, 0.5) == 0.0
    assert S.sign_test(3, 3) == 1.0 and S.sign_test(0, 0) == 1.0 and abs(S.sign_test(8, 0) - 2 / 256) < 1e-12
    assert abs(S.chi2_tail(7.814728, 3) - 0.05) < 1e-6
    with pytest.raises(Exception, match="even number"):
        spark.range(1).select(S.chi2_tail_even(F.lit(7.8), F.lit(3))).collect()
    assert abs(spark.range(1).select(S.chi2_tail_even(F.lit(9.487729), F.lit(4))).first()[0] - 0.05) < 1e-6
