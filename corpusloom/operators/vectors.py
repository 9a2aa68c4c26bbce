"""Vectors, neighbour graphs and simple models on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.lineage import materialize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def centroids(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean vector of each group: key, place, mean, one row for each component."""
    return rows.select(key, F.posexplode(vector).alias("place", "x")).groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centroid_similarity(rows: DataFrame, key: str, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """Cosine of every row with its own group's centroid, whose count of groups bounds the join's small side."""
    means = centroids(rows, key, vector).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "mean"))), lambda x: x["mean"]).alias("centroid"))
    return rows.join(means, key).select(ident, key, F.round(cosine(F.col(vector), F.col("centroid")), 6).alias("similarity"))


def atypical(rows: DataFrame, key: str, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """The row nearest to and the one farthest from each group's centroid."""
    s = centroid_similarity(rows, key, vector, ident)
    return s.groupBy(key).agg(F.min_by(ident, F.struct(-F.col("similarity"), ident)).alias("typical_id"), F.min_by(ident, F.struct("similarity", ident)).alias("atypical_id"))


#: Rows of a block that one task multiplies with the queries.
BLOCK_ROWS = 50_000
#: Queries whose scores against a block are in memory at a time.
SLICE_ROWS = 128


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """List column as a matrix of rows of length one; zero vectors stay zero."""
    x = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def nearest(rows: DataFrame, queries: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` most similar rows of each query by cosine: query_id, rank, vec_id, similarity.

    A stated query set goes against all rows in blocks: queries are dealt to every
    block of rows, each task keeps k per query by a matrix product, and the lists
    are merged. Blocks hold ``block_rows`` rows about, however many rows there are,
    and queries are dealt in tiles of as many, scored SLICE_ROWS at a time. Null
    vectors take no part.
    """
    rows, queries = (df.where(F.col(vector).isNotNull()) for df in (rows, queries))
    blocks, tiles = (max(1, -(-df.count() // block_rows)) for df in (rows, queries))
    blocks = max(blocks, 8)
    q = queries.select(F.col(ident).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64(ident), F.lit(tiles)).cast("int").alias("tile"))
    r = rows.select(F.col(ident).cast("long").alias("row_id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(ident), F.lit(blocks)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("part_tile"))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            a, b = _unit(left.column("q")), _unit(right.column("v"))
            qi, ri = left.column("query_id").to_numpy(), right.column("row_id").to_numpy()
            for at in range(0, len(a), SLICE_ROWS):
                mine, s = qi[at : at + SLICE_ROWS], a[at : at + SLICE_ROWS] @ b.T
                s[~np.isfinite(s) | (mine[:, None] == ri)] = -np.inf
                # All scores from the k-th on, ties with it too, then the order among these few.
                least = np.partition(s, -k, axis=1)[:, -k] if k < len(ri) else np.full(len(s), -np.inf)
                row, col = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                order = np.lexsort((ri[col], -s[row, col], row))
                row, col = row[order], col[order]
                top = np.arange(len(row)) - np.searchsorted(row, row) < k
                found.append((mine[row[top]], ri[col[top]], s[row[top], col[top]]))
        return pa.table(dict(zip(("query_id", "vec_id", "similarity"), map(np.concatenate, zip(*found)))))

    lists = q.groupBy("block", "tile").cogroup(r.groupBy("part", "part_tile")).applyInArrow(run, "query_id long, vec_id long, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


def homophily(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of neighbours with the query's label against the chance of equal labels."""
    a, b = labels.toDF("query_id", "la"), labels.toDF("vec_id", "lb")
    same = neighbours.join(a, "query_id").join(b, "vec_id").agg(F.avg((F.col("la") == F.col("lb")).cast("double")).alias("same"), F.count("*").alias("pairs"))
    share = a.groupBy("la").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("sq"), F.sum("c").alias("n")).select((F.col("sq") / (F.col("n") * F.col("n"))).alias("chance"))
    return same.crossJoin(share).select("pairs", F.round("same", 6).alias("same_share"), F.round("chance", 6).alias("chance"))


def propagate(edges: DataFrame, start: DataFrame, rounds: int, alpha: float = 0.9) -> DataFrame:
    """Label mass spread over weighted edges: alpha of the neighbours' mean, the rest from the start.

    ``start``: id, label, mass. Rows without mass stay out, and every round is one
    join and one aggregation.
    """
    total = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    share = edges.join(total, "dst").select("src", "dst", (F.col("weight") / F.col("total")).alias("w"))
    state = start
    for _ in range(rounds):
        moved = state.join(share, state["id"] == share["src"]).groupBy(F.col("dst").alias("id"), "label").agg((F.sum(F.col("mass") * F.col("w")) * alpha).alias("mass"))
        state = moved.union(start.select("id", "label", (F.col("mass") * (1 - alpha)).alias("mass"))).groupBy("id", "label").agg(F.sum("mass").alias("mass"))
    whole = F.sum("mass").over(Window.partitionBy("id"))
    return state.select("id", "label", F.round(F.col("mass") / whole, 6).alias("share"))


def temporal_edges(segments: DataFrame) -> DataFrame:
    """Both directions of each pair of consecutive segments of a session."""
    nxt = F.lead("segment_id").over(Window.partitionBy("session_id").orderBy("segment_index"))
    pairs = segments.select(F.col("segment_id").alias("src"), nxt.alias("dst")).where("dst is not null").withColumn("weight", F.lit(1.0))
    return pairs.union(pairs.select("dst", "src", "weight"))


def fit_clusters(rows: DataFrame, k: int, seed: int = 42, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """k-means clusters of the vectors: id and cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.select(ident, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=15).fit(data).transform(data).select(ident, F.col("prediction").alias("cluster"))


def fit_factors(rows: DataFrame, k: int, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """Scores on the first ``k`` principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.select(ident, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="scores").fit(data).transform(data).select(ident, vector_to_array("scores").alias("scores"))


def grouped_probe(rows: DataFrame, folds: int = 3, vector: str = "embedding", ident: str = "vec_id", label: str = "label") -> DataFrame:
    """Out-of-fold predictions of a logistic probe; ``rows`` has a fold column."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = materialize(rows.select(ident, "fold", F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features")).where("label is not null"))
    out = None
    for f in range(folds):
        model = LogisticRegression(maxIter=25, regParam=0.05).fit(data.where(F.col("fold") != f))
        part = model.transform(data.where(F.col("fold") == f)).select(ident, "fold", F.col("label").cast("int").alias("truth"), F.col("prediction").cast("int").alias("predicted"))
        out = part if out is None else out.union(part)
    return out
