"""Sums by draw, taken without repeating rows, against sums over repeated rows."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import inference as I


def test_sums_by_draw_are_those_of_repeated_rows(spark):
    rows = spark.createDataFrame([(k, None if c == 7 else f"c{c}", float((k or 3) * c % 5), c % 3) for k in (None, 1, 2) for c in range(40)], "k int, c string, x double, n int")
    want = I.with_draws(rows, "c", 60, 7).groupBy("k", "draw").agg(F.sum(F.col("x") * F.col("times")).alias("x"), F.sum(F.col("n") * F.col("times")).cast("double").alias("n"), F.count("*").alias("clusters"))
    got = I.drawn_sums(rows, ["k"], "c", ["x", "n"], 60, 7)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("draw < 0").count() == 3
    assert I.drawn_sums(rows.limit(0), ["k"], "c", ["x"], 60, 7).count() == 0


@pytest.mark.parametrize("by", [["k"], []])
def test_bootstrap_repeats_no_rows_by_draw(spark, by):
    rows = spark.range(30).select((F.col("id") % 2).alias("k"), F.concat(F.lit("c"), F.col("id") % 9).alias("c"), F.col("id").cast("double").alias("x"))
    out = I.cluster_bootstrap(rows, by, "c", "x", 50)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == max(1, 2 * len(by))
