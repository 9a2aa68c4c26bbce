"""Spellings of labels and flags, worksheet slices and injected judges."""

from pyspark.sql import functions as F

from corpusloom.functions import labels as L
from corpusloom.operators import refine as R
from corpusloom.operators import testsets as W


def test_spellings(spark):
    rows = spark.createDataFrame([("3",), (" 4.0 ",), ("5",), ("2.5",), ("NaN",), ("no code",), ("-1",), ("",), ("odd",), (None,)], "v string")
    assert [r.b for r in rows.select(L.ballot(F.col("v"), 5).alias("b")).collect()] == [3, 4, None, None, None, -1, -1, None, None, None]
    flags = spark.createDataFrame([("1",), ("0.0",), ("True",), (None,), ("?",)], "v string")
    assert [r.f for r in flags.select(L.known_flag(F.col("v")).alias("f")).collect()] == [True, False, True, None, None]
    sources = spark.createDataFrame([("adjudicated",), ("other",), (None,)], "v string")
    assert [r.s for r in sources.select(L.source_of(F.col("v")).alias("s")).collect()] == ["adjudicated", "llm_zero_shot", None]


def test_slices_cover_a_stratum_once(spark):
    rows = spark.range(23).select(F.format_string("t%d", "id").alias("segment_id"), F.lit("a").alias("kind"))
    parts = [[r.segment_id for r in W.slice_of(rows, "kind", 0.25, k).collect()] for k in range(4)]
    assert sorted(sum(parts, [])) == sorted(r.segment_id for r in rows.collect()) and max(map(len, parts)) == 6


def test_failing_judge_has_a_default(spark):
    def judge(a, b):
        if not b:
            raise ValueError("nothing to compare")
        return "merge" if a == b else "split"

    rows = spark.createDataFrame([("x", "x"), ("x", "y"), ("x", None)], "a string, b string")
    assert [r.decision for r in R.asked(rows, judge, "a", "b", "keep").collect()] == ["merge", "split", "keep"]
