"""Helpers shared by the operators: materialising, skew-safe joins, sizes."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this many rows of two longs (about 40 MB as a hash table).
BROADCAST_ROWS = 1_000_000
#: Whole texts that go to Python at a time where an operator computes a table of its own.
TEXT_ROWS = 1000


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a
    session on one machine, as in tests, makes a temporary one; a cluster, whose
    executors can't reach such a folder, gives an error.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
            folder = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_ROWS):
    """Eager work inside sends at most ``rows`` rows at a time to Python; the session's own limit stays if lower.

    Batches of whole texts stand outside of the JVM's heap, several times over.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions the session works with."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which adaptive execution may split hot keys.

    An aggregate on one side already has the keys' partitioning, so Spark would
    not shuffle it and could not split the other side. A hash of the keys as one
    more key makes both sides shuffle for the join, and hot keys are split.
    """
    key = F.xxhash64(*[F.col(c) for c in on])
    return left.withColumn("_hash", key).join(right.withColumn("_hash", key), [*on, "_hash"], how).drop("_hash")


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast when its counted ``rows`` are within BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def constants(values: list[int]) -> Column:
    """Array column of fixed numbers, in the plan as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_position(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """``df`` with its 0-based place in the total order, without one task for all rows.

    Rows are range-sorted and numbered within their partition; only the
    partitions' sizes, one row each, go through the driver.
    """
    rows = df.repartitionByRange(parallelism(df.sparkSession), *order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright("_at", 33).alias("part")).count().collect()
    before, total = [0], 0
    for row in sorted(sizes, key=lambda r: r["part"]):
        before.extend([total] * (row["part"] + 1 - len(before)))
        before[row["part"]] = total
        total += row["count"]
    return rows.withColumn(name, F.get(constants(before), F.shiftright("_at", 33).cast("int")) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")
