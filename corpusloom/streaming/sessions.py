"""Incremental and event-time forms of the batch analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Stream of event files in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user that end after a gap; late rows count within the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events", F.round("total", 6).alias("total"))


def type_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events of each type in every window."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("started"), "event_type", "n", "total")


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "event_id"):
    """Process what has arrived once, keeping one row for each key in ``path``.

    Batches are written to folders of their own by batch number, so a repeated
    batch replaces itself; ``read_latest`` resolves keys by the newest batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}_")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, key: str = "event_id") -> DataFrame:
    """The newest row of each key of an upserted folder."""
    rows = spark.read.parquet(*[f"{path}/batch=*"])
    columns = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select(key, "r.*")
