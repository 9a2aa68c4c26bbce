"""Frozen tables and refreshable overlays in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_frozen(rows: DataFrame, path: str, key: str = "session_id", force: bool = False) -> None:
    """Append sessions once. A session already there is an error, or is replaced with ``force``."""
    spark = rows.sparkSession
    if _exists(spark, path):
        known = spark.read.parquet(path).select(key).distinct()
        if not force and not rows.join(known, key, "left_semi").isEmpty():
            raise ValueError(f"{path} holds some of these {key} values already")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_session(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """One session's rows in order; other partitions aren't read."""
    return spark.read.parquet(path).where(F.col("session_id") == session_id).orderBy("segment_index")


def merged(old: DataFrame, new: DataFrame, key: str = "segment_id") -> DataFrame:
    """Upsert: ``new`` and the rows of ``old`` whose key it lacks."""
    return old.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def apply_overlays(segments: DataFrame, *overlays: DataFrame, key: str = "segment_id") -> DataFrame:
    """Left-join every overlay; overlay rows without a segment are ignored."""
    for o in overlays:
        segments = segments.join(o, key, "left")
    return segments


def remapped(overlay: DataFrame, names: DataFrame, key: str = "segment_id") -> DataFrame:
    """Keys renamed through ``names`` (old_id, new_id) in one pass, so cycles are safe."""
    new = F.coalesce("new_id", F.col(key))
    joined = overlay.join(names.withColumnRenamed("old_id", key), key, "left")
    return joined.select(*[new.alias(c) if c == key else F.col(c) for c in overlay.columns])


def stale_sessions(sources: DataFrame, frozen: DataFrame, on: tuple[str, ...] = ("session_id", "params_hash")) -> DataFrame:
    """Sessions that are missing or were made with other parameters."""
    return sources.join(frozen.select(*on).distinct(), list(on), "left_anti")


def drift(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """Frozen items (segment_id, sha) whose text is gone (unresolved) or differs (drift)."""
    joined = frozen.join(now.select("segment_id", "text"), "segment_id", "left")
    state = F.when(F.col("text").isNull() | F.col("sha").isNull(), "unresolved").when(F.sha2("text", 256) != F.col("sha"), "drift")
    return joined.select("segment_id", state.alias("state")).where("state is not null")


def replace_turns(segments: DataFrame, new: DataFrame, speaker: str = "therapist") -> DataFrame:
    """Replace one speaker's rows; new ones are numbered on from the session's last index."""
    from pyspark.sql import Window

    rest = segments.where(F.col("speaker") != speaker)
    last = rest.groupBy("session_id").agg(F.max("segment_index").alias("last"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("start_ms"))
    numbered = new.join(last, "session_id", "left").withColumn("segment_index", (F.coalesce("last", F.lit(-1)) + place).cast("int")).drop("last")
    return rest.unionByName(numbered, allowMissingColumns=True)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_overlay(spark: SparkSession, rows: DataFrame, path: str, key: str = "segment_id") -> None:
    """Upsert ``rows`` into the overlay at ``path``; a new version is written beside the old one and then named.

    Versions are folders v0, v1, ... of ``path``, so a failed write leaves the last whole one.
    """
    old = _version(spark, path)
    whole = rows if old is None else merged(spark.read.parquet(f"{path}/v{old}"), rows, key)
    whole.write.parquet(f"{path}/v{0 if old is None else old + 1}")


def read_overlay_at(spark: SparkSession, path: str) -> DataFrame | None:
    """The overlay's last whole version; null where there is none."""
    last = _version(spark, path)
    return None if last is None else spark.read.parquet(f"{path}/v{last}")


def clear_overlay(spark: SparkSession, path: str) -> None:
    """All rows go, the columns stay; nothing happens where there is no overlay."""
    last = _version(spark, path)
    if last is not None:
        spark.read.parquet(f"{path}/v{last}").limit(0).write.parquet(f"{path}/v{last + 1}")


def overlay_exists(spark: SparkSession, path: str) -> bool:
    """Whether the overlay has rows."""
    rows = read_overlay_at(spark, path)
    return rows is not None and not rows.isEmpty()


def _version(spark: SparkSession, path: str) -> int | None:
    """Highest version whose write has ended."""
    n = None
    while _exists(spark, f"{path}/v{0 if n is None else n + 1}/_SUCCESS"):
        n = 0 if n is None else n + 1
    return n
