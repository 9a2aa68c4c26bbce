"""Transcripts that keep arriving: new sessions are segmented and stored once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.scrub import params_hash
from corpusloom.operators import segmentation as G
from corpusloom.sources.store import stale_sessions
from corpusloom.sources.transcripts import parse_vtt


def as_sentences(utterances: DataFrame) -> DataFrame:
    """Utterances as the rows that segmentation takes."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return utterances.select("session_id", "speaker", "text", F.col("place").cast("long").alias("place"), "start", "end", words.alias("words"), G.sketch(F.lower("text")).alias("vector"))


def segmented(utterances: DataFrame, settings: dict, encode: Callable[[DataFrame], DataFrame] = as_sentences) -> DataFrame:
    """Segments with the digest of the settings that made them."""
    out = G.segment_sessions(encode(utterances), settings.get("min_words", G.MIN_WORDS), settings.get("max_words", G.MAX_WORDS))
    return out.withColumn("params_hash", F.lit(params_hash(settings)))


def watch_transcripts(spark: SparkSession, folder: str, store: str, checkpoint: str, settings: dict):
    """Process the WebVTT files that have arrived since the last call; returns the running query.

    A session is a partition of ``store`` and is replaced as a whole, so a batch
    that runs twice changes nothing. Files already seen are known to the checkpoint.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.vtt").option("recursiveFileLookup", True).load(folder).select(F.input_file_name().alias("path"), "value")

    def write(batch: DataFrame, number: int) -> None:
        rows = segmented(parse_vtt(batch), settings)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(store)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outdated(sessions: DataFrame, stored: DataFrame, settings: dict) -> DataFrame:
    """Sessions (session_id) that the store lacks or holds from other settings."""
    wanted = sessions.select("session_id").distinct().withColumn("params_hash", F.lit(params_hash(settings)))
    return stale_sessions(wanted, stored).select("session_id")
