"""Second looks at segments: context around them and boundaries to be asked about."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.segmentation import sketch

ATTACH, SKIP = 0.30, 0.22


def walk(segments: DataFrame, backwards: bool = True, max_gap_ms: int = 5000, words: int = 40, steps: int = 4) -> DataFrame:
    """The run of neighbours before (or after) each participant segment: segment_id, n, text.

    The run ends at another participant's turn, a longer gap than ``max_gap_ms``,
    or where the words exceed the budget; it has at most ``steps`` turns.
    """
    sign = -1 if backwards else 1
    w = Window.partitionBy("session_id").orderBy(F.col("segment_index") * (1 if not backwards else -1)).rowsBetween(1, steps)
    near = F.collect_list(F.struct("speaker", "participant_id", "start_ms", "end_ms", "word_count", "text")).over(w)
    r = segments.withColumn("_near", near).where("speaker = 'participant'")
    start = F.struct(F.lit(True).alias("go"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.lit(0).cast("int").alias("used"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        gap = acc["s"] - x["end_ms"] if sign < 0 else x["start_ms"] - acc["e"]
        other = (x["speaker"] == "participant") & (x["participant_id"] != F.col("participant_id"))
        ok = acc["go"] & ~other & (gap <= max_gap_ms) & (acc["used"] + x["word_count"] <= words)
        longer = F.concat(F.array(x["text"]), acc["out"]) if sign < 0 else F.concat(acc["out"], F.array(x["text"]))
        return F.struct(ok.alias("go"), F.when(ok, x["start_ms"]).otherwise(acc["s"]).alias("s"), F.when(ok, x["end_ms"]).otherwise(acc["e"]).alias("e"), F.when(ok, acc["used"] + x["word_count"]).otherwise(acc["used"]).alias("used"), F.when(ok, longer).otherwise(acc["out"]).alias("out"))

    found = F.aggregate("_near", start, step, lambda acc: acc["out"])
    return r.withColumn("_found", found).select("segment_id", F.size("_found").alias("n"), F.array_join("_found", "\n").alias("context"))


def attachment(segments: DataFrame, contexts: DataFrame, attach: float = ATTACH, skip: float = SKIP) -> DataFrame:
    """attach, skip or ask by the similarity of a segment and its context; without a context skip."""
    j = segments.select("segment_id", "text").join(contexts.where("n > 0"), "segment_id", "left")
    dot = F.aggregate(F.zip_with(sketch(F.lower("text")), sketch(F.lower(F.coalesce("context", F.lit("")))), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    s = j.withColumn("similarity", F.round(dot, 6))
    verdict = F.when(F.col("context").isNull() | (F.col("similarity") < skip), "skip").when(F.col("similarity") >= attach, "attach").otherwise("ask")
    return s.select("segment_id", "similarity", verdict.alias("verdict"))


def asked(rows: DataFrame, decide: Callable[[str, str], str], left: str, right: str, default: str) -> DataFrame:
    """``rows`` with ``decision`` by an injected judge of two texts; a judge that raises gives ``default``."""
    @F.pandas_udf(T.StringType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            try:
                out.append(decide(x or "", y or "") or default)
            except Exception:  # the plug-in's failure has a defined result
                out.append(default)
        return pd.Series(out, dtype="object")

    return rows.withColumn("decision", run(F.col(left), F.col(right)))
