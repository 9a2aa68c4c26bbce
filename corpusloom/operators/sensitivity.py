"""How strong hidden bias must be to explain a cell's effect away: intervals, E-values, bias factors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusloom.functions import stats as S
from corpusloom.operators.inference import drawn_sums

#: An interval needs as many draws with a defined difference.
LEAST_DRAWS = 20


def pooled_difference(n: Column, s: Column, q: Column, rn: Column, rs: Column, rq: Column) -> Column:
    """Standardised difference of a cell's mean from the rest's, from counts, sums and sums of squares.

    Null without rows on a side or degrees of freedom; 0 where neither side varies.
    """
    within = (q - s * s / n) + (rq - rs * rs / rn)
    sd = F.sqrt(F.greatest(within, F.lit(0.0)) / (n + rn - 2))
    defined = (n >= 1) & (rn >= 1) & (n + rn > 2)
    return F.when(defined, F.when(F.round(sd, 9) > 0, (s / n - rs / rn) / sd).otherwise(0.0))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])


def _against_rest(moments: DataFrame, within: list[str]) -> DataFrame:
    """``moments`` by cell with ``smd``, the cell against the other moves of the same stratum."""
    whole = moments.groupBy(*within).agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    rest = lambda c: F.col(f"t{c}") - F.col(c)
    return moments.join(whole, within).withColumn("smd", pooled_difference(F.col("n"), F.col("s"), F.col("q"), rest("n"), rest("s"), rest("q")))


@F.pandas_udf(DoubleType())
def critical_bias(above: pd.Series, below: pd.Series) -> pd.Series:
    """Least bias factor that undoes the sign test of each cell; one cell is one row."""
    return pd.Series([S.rosenbaum(int(a), int(b)) for a, b in zip(above, below)], dtype="float64")


def sensitivity_bounds(blocks: DataFrame, least: int = 4, draws: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """One row per stage and move with ``least`` blocks: difference from the stage's other moves and how robust it is.

    ``blocks`` has participant_id, from_stage, move and delta. Counts, sums and sums of
    squares by participant and cell carry everything; the interval comes from draws of
    whole participants within a stage, weighted by a digest. ``e_value_ci_limit`` is that of
    the interval's end nearer to none. ``gamma`` counts the cell's changes above and below
    the mean of the stage's other moves, in both directions. Rows with a null move or
    change, and stages with fewer than two blocks of other moves, are left out; with one
    participant in the stage, or under LEAST_DRAWS draws that have both sides, the interval is null.
    """
    rows = blocks.where("move is not null and delta is not null and from_stage is not null")
    d = F.col("delta").cast("double")
    by_value = rows.groupBy("participant_id", "from_stage", "move", d.alias("delta")).agg(F.count("*").alias("c"))
    value = F.col("delta")
    cells = by_value.groupBy("participant_id", "from_stage", "move").agg(F.sum("c").alias("n"), F.sum(F.col("c") * value).alias("s"), F.sum(F.col("c") * value * value).alias("q"))
    real = _against_rest(_moments(cells, ["from_stage", "move"]), ["from_stage"]).where((F.col("n") >= least) & (F.col("tn") - F.col("n") >= 2))
    people = cells.where("participant_id is not null").groupBy("from_stage").agg(F.countDistinct("participant_id").alias("people"))
    drawn = drawn_sums(cells.where("participant_id is not null"), ["from_stage", "move"], "participant_id", ["n", "s", "q"], draws, seed).where("draw >= 0")
    tried = _against_rest(drawn, ["from_stage", "draw"]).where("smd is not null")
    ends = tried.groupBy("from_stage", "move").agg(F.count("*").alias("valid"), F.percentile("smd", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("ends"))
    centred = by_value.groupBy("from_stage", "move", "delta").agg(F.sum("c").alias("c")).join(real.select("from_stage", "move", F.round((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n")), 9).alias("centre")), ["from_stage", "move"])
    side = lambda test: F.sum(F.when(test, F.col("c")).otherwise(0))
    signs = centred.groupBy("from_stage", "move").agg(side(value > F.col("centre")).alias("above"), side(value < F.col("centre")).alias("below"))
    out = real.join(people, "from_stage", "left").join(ends, ["from_stage", "move"], "left").join(signs, ["from_stage", "move"])
    known = (F.col("people") >= 2) & (F.col("valid") >= LEAST_DRAWS)
    out = out.withColumn("low", F.when(known, F.get("ends", F.lit(0)))).withColumn("high", F.when(known, F.get("ends", F.lit(1))))
    return out.select(
        "from_stage", "move", "n", F.round(F.col("s") / F.col("n"), 6).alias("mean_delta"), F.round("smd", 6).alias("smd"), F.round("low", 6).alias("smd_ci_lo"), F.round("high", 6).alias("smd_ci_hi"),
        F.round(S.smd_to_ratio(F.col("smd")), 6).alias("approx_rr"), F.round(S.e_value(S.smd_to_ratio(F.col("smd"))), 6).alias("e_value"), F.round(S.e_value_limit(F.col("low"), F.col("high")), 6).alias("e_value_ci_limit"),
        critical_bias(F.col("above"), F.col("below")).alias("gamma"),
    )
