"""Cutting the lineage of iterative jobs by tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once, as Parquet below the session's ``spark.checkpoint.dir``, and read back.

    A table, and not a checkpoint: the plan of a checkpointed frame carries its old
    constraints along, which double in every round of a loop. Where the folder is unset,
    a session on one machine, as in tests, makes one of its own; a cluster, whose executors
    can't reach such a folder, gives an error.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place (from 1) in a total order, without one task for all rows.

    Rows are range-sorted and numbered within their range; the driver adds up the sizes of the ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = {r["part"]: r["n"] for r in rows.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    before = [sum(n for q, n in sizes.items() if q < p) for p in range(max(sizes, default=0) + 1)]
    starts = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    place = F.get(starts, F.shiftright("_at", 33).cast("int")) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.withColumn(name, place).drop("_at")
