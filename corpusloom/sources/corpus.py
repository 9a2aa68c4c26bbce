"""Logical tables of a labelled conversation corpus over the supplied parquet tables.

The supplied tables hold conversations, not labels, so labels, ballots, moves and
codes are derived from a digest of the text; SQL_VIEWS states the same derivation
for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES, MOVES, CODES = 5, 5, 12
STAGE_NAMES = ("Vigilance", "Avoidance", "Attention-Regulation", "Metacognition", "Reappraisal")
SESSIONS_PER_PARTICIPANT = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digit(place: int) -> Column:
    return F.ascii(F.substring("digest", place, 1))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per turn: keys, times, speaker, text, label, confidence, codes and ballots."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    c = c.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    participant = F.floor(F.col("conv_id") / SESSIONS_PER_PARTICIPANT)
    cohort = (participant % 3 + 1).cast("int")
    speaker = F.when(F.col("role") == "user", "participant").when(F.col("role") == "assistant", "therapist").otherwise("other")
    start = F.col("turn") * 1000
    stage, second = _digit(1) % 6, _digit(4) % 7
    ballot = lambda r: F.when(_digit(4 + r) % 8 < STAGES, (_digit(4 + r) % 8)).when(_digit(4 + r) % 8 == 7, _digit(1) % 6)
    return c.select(
        F.format_string("c%d_t%d", "conv_id", "turn").alias("segment_id"),
        F.format_string("c%ds%d", cohort, F.col("conv_id")).alias("session_id"),
        F.format_string("p%d", participant).alias("participant_id"),
        cohort.alias("cohort_id"),
        (F.col("conv_id") % SESSIONS_PER_PARTICIPANT + 1).cast("int").alias("session_number"),
        F.col("turn").cast("int").alias("segment_index"),
        start.cast("long").alias("start_ms"),
        (start + 800).cast("long").alias("end_ms"),
        speaker.alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).alias("word_count"),
        F.when((speaker == "participant") & (stage < STAGES), stage).cast("int").alias("label"),
        F.when((speaker == "participant") & (stage < STAGES) & (second < STAGES), second).cast("int").alias("second_label"),
        F.when(speaker == "therapist", _digit(2) % MOVES).cast("int").alias("move"),
        (_digit(3) % 10 / 10.0).alias("confidence"),
        F.array(*[F.format_string("k%d", _digit(10 + i) % CODES) for i in range(3)]).alias("codes"),
        F.array(*[F.when(speaker == "participant", ballot(r)).cast("int") for r in (1, 2, 3)]).alias("ballots"),
        F.array(*[F.when(speaker == "participant", (_digit(4 + r) % 8 == 5)) for r in (1, 2, 3)]).alias("abstains"),
        F.when(_digit(14) % 2 == 0, F.when(speaker == "participant", _digit(15) % STAGES)).cast("int").alias("human_label"),
    )


SQL_VIEWS = """
turns AS (
  SELECT *, md5(coalesce(text, '')) AS digest,
    CASE role WHEN 'user' THEN 'participant' WHEN 'assistant' THEN 'therapist' ELSE 'other' END AS speaker,
    conv_id // 4 AS pid
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
),
digits AS (
  SELECT *, ascii(substr(digest, 1, 1)) % 6 AS d1, ascii(substr(digest, 2, 1)) % 5 AS d2, ascii(substr(digest, 3, 1)) % 10 AS d3, ascii(substr(digest, 4, 1)) % 7 AS d4,
    ascii(substr(digest, 5, 1)) % 8 AS b1, ascii(substr(digest, 6, 1)) % 8 AS b2, ascii(substr(digest, 7, 1)) % 8 AS b3,
    ascii(substr(digest, 10, 1)) % 12 AS k1, ascii(substr(digest, 11, 1)) % 12 AS k2, ascii(substr(digest, 12, 1)) % 12 AS k3,
    ascii(substr(digest, 14, 1)) % 2 AS h1, ascii(substr(digest, 15, 1)) % 5 AS h2
  FROM turns
),
segments AS (
  SELECT 'c' || conv_id || '_t' || turn AS segment_id, 'c' || (pid % 3 + 1) || 's' || conv_id AS session_id, 'p' || pid AS participant_id,
    (pid % 3 + 1)::INTEGER AS cohort_id, (conv_id % 4 + 1)::INTEGER AS session_number, turn::INTEGER AS segment_index,
    turn * 1000 AS start_ms, turn * 1000 + 800 AS end_ms, speaker, coalesce(text, '') AS text,
    len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> ''))::INTEGER AS word_count,
    (CASE WHEN speaker = 'participant' AND d1 < 5 THEN d1 END)::INTEGER AS label,
    (CASE WHEN speaker = 'participant' AND d1 < 5 AND d4 < 5 THEN d4 END)::INTEGER AS second_label,
    (CASE WHEN speaker = 'therapist' THEN d2 END)::INTEGER AS move,
    d3 / 10.0::DOUBLE AS confidence,
    ['k' || k1, 'k' || k2, 'k' || k3] AS codes,
    CASE WHEN speaker = 'participant' THEN [CASE WHEN b1 < 5 THEN b1 WHEN b1 = 7 THEN d1 END, CASE WHEN b2 < 5 THEN b2 WHEN b2 = 7 THEN d1 END, CASE WHEN b3 < 5 THEN b3 WHEN b3 = 7 THEN d1 END]::INTEGER[] ELSE [NULL, NULL, NULL]::INTEGER[] END AS ballots,
    [b1 = 5, b2 = 5, b3 = 5] AS abstains,
    (CASE WHEN h1 = 0 AND speaker = 'participant' THEN h2 END)::INTEGER AS human_label
  FROM digits
),
labelled AS (SELECT * FROM segments WHERE speaker = 'participant' AND label IS NOT NULL)
"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants' labelled segments, the frame of most analyses."""
    return segments(spark, sf_dir).where("speaker = 'participant' and label is not null")


def oracle(body: str) -> str:
    """SQL of a query over the logical tables. ``body`` starts with SELECT or with more views."""
    body = body.strip()
    return f"WITH {SQL_VIEWS.strip()}{', ' if not body.upper().startswith('SELECT') else ' '}{body}"
