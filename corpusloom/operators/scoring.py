"""Raters as plug-ins: every row is scored by injected functions, and their ballots are merged."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BALLOT = "segment_id string, rater int, kind string, stage int, confidence double, secondary_stage int, justification string"
#: A rater: text to (kind, stage, confidence, secondary stage, justification); kind is CODED, ABSTAIN or ERROR.
Rater = Callable[[str], tuple]


def ballots(rows: DataFrame, raters: list[Rater]) -> DataFrame:
    """One ballot per row and rater. A rater that raises gives an ERROR ballot, so a row never gets lost."""

    def run(batches: Iterable[pd.DataFrame]):
        for batch in batches:
            out = []
            for sid, text in zip(batch["segment_id"], batch["text"]):
                for i, rate in enumerate(raters):
                    try:
                        out.append((sid, i, *rate(text or "")))
                    except Exception as e:  # the plug-in's failure is a result
                        out.append((sid, i, "ERROR", None, None, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["segment_id", "rater", "kind", "stage", "confidence", "secondary_stage", "justification"]).astype({"stage": "Int32", "secondary_stage": "Int32"})

    return rows.select("segment_id", "text").mapInPandas(run, BALLOT)


def merged_votes(cast: DataFrame, raters: int) -> DataFrame:
    """Strict majority of all raters, failed ones counting against it: winner (-1 abstention), agreeing, level, confidence, justification.

    The confidence is the mean of the agreeing ballots' known ones, the
    justification the first of them that is not empty.
    """
    v = cast.withColumn("v", F.when(F.col("kind") == "CODED", F.col("stage")).when(F.col("kind") == "ABSTAIN", -1)).where("v is not null")
    by = v.groupBy("segment_id", "v").agg(F.count("*").alias("c"), F.avg("confidence").alias("conf"), F.min_by("justification", F.when(F.length("justification") > 0, F.col("rater"))).alias("why"))
    best = by.groupBy("segment_id").agg(F.min_by(F.struct("v", "c", "conf", "why"), F.struct(-F.col("c"), "v")).alias("b"), F.sum("c").alias("n"))
    all_ = cast.select("segment_id").distinct().join(best, "segment_id", "left")
    won = F.coalesce(F.col("b.c") * 2 > raters, F.lit(False))
    level = F.when(F.col("n").isNull(), "none").when(~won, "split").when(F.col("b.c") == raters, "unanimous").otherwise("majority")
    return all_.select("segment_id", F.when(won, F.col("b.v")).alias("winner"), F.coalesce(F.col("b.c"), F.lit(0)).alias("n_agree"), level.alias("level"), F.when(won, F.round("b.conf", 4)).alias("confidence"), F.when(won, F.col("b.why")).alias("justification"))


def secondary_evidence(cast: DataFrame, winners: DataFrame, weight: float = 0.6, least: float = 0.5) -> DataFrame:
    """Second label of each segment: dissenting first labels and all second ones by confidence, the best from ``least`` on.

    Abstentions and errors add nothing; of equal evidence the smaller label wins.
    """
    w = winners.select("segment_id", "winner")
    c = cast.where("kind = 'CODED'").join(w, "segment_id")
    first = c.where("stage <> winner").select("segment_id", "stage", (F.coalesce("confidence", F.lit(1.0)) * weight).alias("e"))
    second = c.where("secondary_stage is not null and secondary_stage <> winner").select("segment_id", F.col("secondary_stage").alias("stage"), (F.coalesce("confidence", F.lit(1.0)) * weight).alias("e"))
    by = first.union(second).groupBy("segment_id", "stage").agg(F.round(F.sum("e"), 6).alias("e")).where(F.col("e") >= least)
    return by.groupBy("segment_id").agg(F.min_by("stage", F.struct(-F.col("e"), "stage")).alias("secondary"), F.max("e").alias("evidence"))


def code_votes(codes: DataFrame, raters: int) -> DataFrame:
    """Codes (segment_id, rater, code, confidence) that more than half of the raters applied, with their mean confidence."""
    return codes.groupBy("segment_id", "code").agg(F.countDistinct("rater").alias("votes"), F.round(F.avg("confidence"), 4).alias("confidence")).where(F.col("votes") * 2 > raters)


def unjudged(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows that no rater has judged yet."""
    return rows.join(known.select("segment_id").distinct(), "segment_id", "left_anti")


def cue_units(blocks: DataFrame, budget: int = 300, skip: int = 400) -> DataFrame:
    """Cues as units to rate: those over ``skip`` words are lessons and marked; others get the number of parts they need."""
    words = F.size(F.filter(F.split("cue_text", r"\s+"), lambda w: w != ""))
    b = blocks.where("not is_empty").withColumn("words", words)
    return b.select("from_id", "to_id", "words", (F.col("words") > skip).alias("lesson"), F.ceil(F.col("words") / budget).cast("int").alias("parts"))


def exchange(segments: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Each therapist turn with the turns around it, itself marked by >>."""
    w = Window.partitionBy("session_id").orderBy("segment_index")
    line = F.concat_ws(": ", "speaker", "text")
    r = segments.withColumn("_b", F.collect_list(line).over(w.rowsBetween(-before, -1))).withColumn("_a", F.collect_list(line).over(w.rowsBetween(1, after)))
    return r.where("speaker = 'therapist'").select("segment_id", F.array_join(F.concat("_b", F.array(F.concat(F.lit(">> "), line)), "_a"), "\n").alias("exchange"))


def sweep(settings: dict[str, list]) -> list[dict]:
    """The first value of every setting, then each other value with the rest unchanged."""
    base = {k: v[0] for k, v in settings.items()}
    out = [base]
    for k, values in settings.items():
        for v in values[1:]:
            if base | {k: v} not in out:
                out.append(base | {k: v})
    return out
