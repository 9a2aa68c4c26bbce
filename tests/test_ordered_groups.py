"""Whole keys out of a stream of batches."""

from pyspark.sql import functions as F

from corpusloom.operators import trends as R
from corpusloom.operators.ordered import ordered_groups


def test_keys_over_batches_and_null_keys(spark):
    rows = spark.createDataFrame([(None if k == 3 else f"k{k}", t) for k in range(9) for t in range(k + 1)], "k string, t int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = ordered_groups(rows, "k", ["t"], lambda key, c: [(key, len(c["t"]), ",".join(map(str, c["t"])))], "k string, n long, ts string")
        assert {(r.k, r.n, r.ts) for r in got.collect()} == {(None if k == 3 else f"k{k}", k + 1, ",".join(map(str, range(k + 1)))) for k in range(9)} and got.count() == 9
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trends_make_no_frame_a_series(spark):
    rows = spark.range(40).select((F.col("id") % 8).cast("string").alias("g"), "id", (F.col("id") * 7 % 5).cast("double").alias("y"))
    plan = R.mann_kendall(rows, "g", "id", "y")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsIn" not in plan
