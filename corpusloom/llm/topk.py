"""Exact top-k search by tiled matrix products and tree merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._session import materialize, parallelism

QUERY_TILE, SHARD_TILE, LEAST_TILE, STEP, FAN_IN = 4096, 16384, 1024, 256, 16
SCHEMA = "query_id long, shard long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, code (array of floor(scale * x)) of the rows that can take part."""
    x = F.col("embedding").cast("array<double>")
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    return rows.select("vec_id", F.transform("embedding", lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("code"))


def _matrix(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids ascending and their rows. The last two columns hold them."""
    codes = table.column(4).combine_chunks()
    x = codes.flatten().to_numpy(zero_copy_only=False).reshape(len(codes), dim)
    ids = table.column(3).to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order]


def _tile(k: int):
    def run(key, queries: pa.Table, shard: pa.Table) -> pa.Table:
        dim, number = key[0].as_py(), key[2].as_py()
        out = []
        if queries.num_rows and shard.num_rows:
            (qid, q), (vid, v) = _matrix(queries, dim), _matrix(shard, dim)
            # Sums of products below 2**53 are exact in doubles; beyond, integers are multiplied.
            if float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0)) * max(dim, 1) < 2**53:
                q, v = q.astype(float), v.astype(float)
            for a in range(0, len(qid), STEP):
                scores = q[a : a + STEP] @ v.T
                for i, row in enumerate(scores):
                    own = np.searchsorted(vid, [qid[a + i], qid[a + i] + 1])
                    pick = np.arange(len(vid))
                    if own[1] > own[0]:
                        pick = np.delete(pick, np.s_[own[0] : own[1]])
                        row = row[pick]
                    if len(row) > k:
                        best = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                        pick, row = pick[best], row[best]
                    top = np.argsort(-row, kind="stable")[:k]
                    out.append((np.full(len(top), qid[a + i]), vid[pick[top]], row[top].astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": cols[0], "shard": np.full(len(cols[0]), number, np.int64), "vec_id": cols[1], "score": cols[2]})

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` highest inner products of each query: query_id, rank, vec_id, score.

    Both inputs have vec_id and code. Queries are dealt into tiles of about
    QUERY_TILE rows, vectors into shards of at most about SHARD_TILE; a task gets
    one tile and one shard, multiplies them and keeps k per query, and lists of
    FAN_IN shards are merged at a time. Ties go to the smaller vec_id. A query's
    own vec_id is no candidate; fewer candidates give fewer rows. Vectors of
    another length than the query's are no candidates. Every row of ``vectors`` is a
    candidate, repeated ones too; a query repeated with the same vec_id and code is
    one query. Empty inputs give no rows.
    """
    queries, vectors = (materialize(x.select("vec_id", "code", F.size("code").alias("dim"))) for x in (queries.select("vec_id", "code").distinct(), vectors))
    n_queries, n = queries.count(), vectors.count()
    tiles = max(1, -(-n_queries // QUERY_TILE))
    shards = max(1, -(-n // SHARD_TILE), min(parallelism(vectors.sparkSession), -(-n // LEAST_TILE)))
    span = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c - 1).cast("long")))
    deal = lambda c: F.pmod(F.xxhash64("vec_id"), F.lit(c).cast("long"))
    left = queries.select("dim", deal(tiles).alias("tile"), span(shards).alias("shard"), "vec_id", "code")
    # New names: both sides may come from one frame, whose column ids a cogroup would confuse.
    right = vectors.select(F.col("dim").alias("dim_"), span(tiles).alias("tile_"), deal(shards).alias("shard_"), F.col("vec_id").alias("id_"), F.col("code").alias("code_"))
    by = ["dim", "tile", "shard"]
    lists = left.groupBy(*by).cogroup(right.groupBy(*[f"{c}_" for c in by])).applyInArrow(_tile(k), SCHEMA)
    while True:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN))
        best = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        shards = -(-shards // FAN_IN)
        if shards == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")
