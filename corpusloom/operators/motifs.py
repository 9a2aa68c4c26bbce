"""Motifs: clusters of cue-block vectors, fitted, kept as a table and joined by block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.graphs import block_vectors
from corpusloom.operators.lineage import materialize


def block_means(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean vector of each block's turns: from_id and vector. Blocks without turns have no row."""
    rows = block_vectors(blocks, vectors).groupBy("from_id").agg(F.array_sort(F.collect_list(F.struct("place", "mean"))).alias("v"))
    return rows.select("from_id", F.transform("v", lambda x: x["mean"]).alias("vector"))


def _assigned(rows: DataFrame, centres: list[tuple[int, list[float]]], ident: str) -> DataFrame:
    """The nearest centre of each row, the smaller number of equal ones."""
    square = lambda c: F.round(F.aggregate(F.zip_with("vector", F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 6)
    near = F.array_min(F.array(*[F.struct(square(c).alias("d"), F.lit(k).alias("motif")) for k, c in centres]))
    return rows.select(ident, "vector", near.alias("near")).select(ident, "vector", F.col("near.motif").alias("motif"), F.col("near.d").alias("distance"))


def clusters(rows: DataFrame, k: int, rounds: int = 3, ident: str = "from_id") -> DataFrame:
    """k-means of the rows' vectors from k rows that a digest of their id picks: ``ident``, motif, distance squared.

    The vectors are written once, since every round goes over them. A round assigns rows by the
    centres as literals and takes the means by cluster; the driver holds k centres. A cluster that no row is nearest to goes. Fewer rows than
    ``k`` give as many clusters; rows with a null vector are left out; no rows give none.
    """
    rows = materialize(rows.where("vector is not null").select(ident, "vector"))
    first = rows.orderBy(F.md5(F.col(ident).cast("string")), ident).limit(k).select("vector").collect()
    centres = [(i, r["vector"]) for i, r in enumerate(first)]
    if not centres:
        return rows.select(ident, F.lit(0).alias("motif"), F.lit(0.0).alias("distance"))
    for _ in range(rounds):
        means = _assigned(rows, centres, ident).select("motif", F.posexplode("vector").alias("place", "x")).groupBy("motif", "place").agg(F.round(F.avg("x"), 6).alias("m"))
        found = means.groupBy("motif").agg(F.array_sort(F.collect_list(F.struct("place", "m"))).alias("c")).orderBy("motif").collect()
        centres = [(r["motif"], [x["m"] for x in r["c"]]) for r in found]
    return _assigned(rows, centres, ident).select(ident, "motif", "distance")
