"""Confidence, abstention and resampled agreement of classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.inference import drawn_sums


def softened(scores: Column, temperature: Column | float) -> Column:
    """Softmax of log probabilities divided by a temperature."""
    logs = F.transform(scores, lambda p: F.log(F.greatest(p.cast("double"), F.lit(1e-12))) / temperature)
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def temperature_losses(rows: DataFrame, scores: str = "scores", truth: str = "truth", grid: tuple[float, ...] = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0)) -> DataFrame:
    """Mean negative log-likelihood at every temperature of a grid, all of them in one pass."""
    r = rows.where(F.col(truth).isNotNull())
    loss = lambda t: F.avg(-F.log(F.greatest(F.get(softened(F.col(scores), t), F.col(truth)), F.lit(1e-12))))
    one = r.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(grid)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("temperature"), F.round(f"t{i}", 6).alias("loss")) for i, t in enumerate(grid)])).alias("x")).select("x.*")


def best_temperature(losses: DataFrame) -> DataFrame:
    """The temperature of the least loss, the one nearest to 1 of equal ones."""
    return losses.agg(F.min_by("temperature", F.struct("loss", F.abs(F.col("temperature") - 1))).alias("temperature"), F.min("loss").alias("loss"))


def abstain_floors(rows: DataFrame, target: float = 0.6, label: str = "predicted", confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """For each label the least confidence at which what is kept is precise enough, else that of the best precision.

    Equal confidences count together; a label's distinct confidences are walked in order.
    """
    c = rows.groupBy(label, confidence).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("hit"))
    w = Window.partitionBy(label).orderBy(F.desc(confidence)).rowsBetween(Window.unboundedPreceding, 0)
    p = c.withColumn("kept", F.sum("n").over(w)).withColumn("precision", F.round(F.sum("hit").over(w) / F.sum("n").over(w), 6))
    out = p.groupBy(label).agg(F.min(F.when(F.col("precision") >= target, F.col(confidence))).alias("_ok"), F.max_by(confidence, F.struct("precision", confidence)).alias("_best"))
    return out.select(label, F.coalesce("_ok", "_best").alias("floor"), F.col("_ok").isNotNull().alias("reached"))


def apply_floors(rows: DataFrame, floors: DataFrame, label: str = "predicted", confidence: str = "confidence", default: float = 0.0) -> DataFrame:
    """``rows`` with ``abstain``: confidence under the label's floor."""
    return rows.join(F.broadcast(floors.select(label, "floor")), label, "left").withColumn("abstain", F.col(confidence) < F.coalesce("floor", F.lit(default))).drop("floor")


def ensemble(probabilities: DataFrame, raters: int) -> DataFrame:
    """Mean probability of each class (segment_id, rater, label, p) over the segments that all raters scored."""
    full = probabilities.groupBy("segment_id").agg(F.countDistinct("rater").alias("r")).where(F.col("r") == raters).select("segment_id")
    return probabilities.join(full, "segment_id").groupBy("segment_id", "label").agg(F.round(F.avg("p"), 6).alias("p"))


def winners(probabilities: DataFrame) -> DataFrame:
    """Most probable class of each segment, the smallest of equal ones, with its probability."""
    return probabilities.groupBy("segment_id").agg(F.min_by("label", F.struct(-F.col("p"), "label")).alias("predicted"), F.max("p").alias("confidence"))


def _kappa_by_draw(cells: DataFrame, a: str, b: str) -> DataFrame:
    """draw, n and kappa from weighted counts (draw, labels, n)."""
    c = cells.groupBy("draw", F.col(a).alias("x"), F.col(b).alias("y")).agg(F.sum("n").alias("n"))
    ends = F.explode(F.array(F.struct(F.col("x").alias("v"), F.col("n").alias("left"), F.lit(0).cast("long").alias("right")), F.struct(F.col("y").alias("v"), F.lit(0).cast("long").alias("left"), F.col("n").alias("right"))))
    chance = c.select("draw", ends.alias("e")).groupBy("draw", "e.v").agg(F.sum("e.left").alias("l"), F.sum("e.right").alias("r")).groupBy("draw").agg(F.sum(F.col("l").cast("double") * F.col("r")).alias("both"))
    own = c.groupBy("draw").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("hit"))
    po, pe = F.col("hit") / F.col("n"), F.col("both") / (F.col("n").cast("double") * F.col("n"))
    return own.join(chance, "draw").select("draw", "n", F.when(pe < 1, (po - pe) / (1 - pe)).when(po >= 1, 1.0).otherwise(0.0).alias("kappa"))


def agreement_interval(rows: DataFrame, a: str, b: str, cluster: str, draws: int = 500, seed: int = 42, other: str | None = None) -> DataFrame:
    """Kappa of two labels with a percentile interval over resampled clusters.

    With ``other``, of the difference kappa(a, b) - kappa(a, other). Rows are
    counted by cluster and label combination; how often a draw takes a cluster
    follows a digest, and counts are summed by draw and labels, so no task holds all
    clusters. Below two clusters the interval is null.
    """
    labels = [a, b, *([other] if other else [])]
    r = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in labels))
    counts = r.groupBy(cluster, *labels).agg(F.count("*").alias("m"))
    cells = drawn_sums(counts, labels, cluster, ["m"], draws, seed).select("draw", *labels, F.col("m").cast("long").alias("n"))
    value = _kappa_by_draw(cells, a, b)
    if other:
        against = _kappa_by_draw(cells, a, other).select("draw", F.col("kappa").alias("against"))
        value = value.join(against, "draw").withColumn("kappa", F.col("kappa") - F.col("against"))
    real = F.col("draw") < 0
    out = value.agg(F.max(F.when(real, F.col("n"))).alias("n"), F.max(F.when(real, F.col("kappa"))).alias("value"), F.percentile(F.when(~real, F.col("kappa")), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    out = out.crossJoin(counts.select(cluster).distinct().agg(F.count("*").alias("clusters"))).where("clusters > 0")
    bound = lambda i: F.when(F.col("clusters") > 1, F.round(F.get("q", F.lit(i)), 6))
    return out.select("n", "clusters", F.round("value", 6).alias("value"), bound(0).alias("low"), bound(1).alias("high"))


def distance_scores(neighbours: DataFrame) -> DataFrame:
    """Mean cosine distance of each query to its neighbours: the larger, the stranger."""
    return neighbours.groupBy("query_id").agg(F.round(F.avg(1 - F.col("similarity")), 6).alias("distance"))


def chance_baselines(rows: DataFrame, label: str = "label") -> DataFrame:
    """Per fold: share of the other folds' most frequent label, and the chance of a stratified guess."""
    own = rows.where(F.col(label).isNotNull()).groupBy("fold", F.col(label).alias("v")).agg(F.count("*").alias("n"))
    all_ = own.groupBy("v").agg(F.sum("n").alias("all"))
    folds = own.select("fold").distinct()
    grid = F.broadcast(folds).crossJoin(all_).join(own, ["fold", "v"], "left").select("fold", "v", F.coalesce("n", F.lit(0)).alias("n"), (F.col("all") - F.coalesce("n", F.lit(0))).alias("rest"))
    return grid.groupBy("fold").agg(F.sum("n").alias("n"), F.max_by("n", F.struct("rest", -F.col("v"))).alias("hit"), F.sum(F.col("n") * F.col("rest")).alias("x"), F.sum("rest").alias("r")).select("fold", "n", F.round(F.col("hit") / F.col("n"), 6).alias("modal"), F.round(F.col("x") / (F.col("n") * F.col("r")), 6).alias("stratified"))


def triangulation(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Agreement of every pair of label columns over rows where both are known."""
    pairs = [(x, y) for i, x in enumerate(labels) for y in labels[i + 1 :]]
    cells = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(x).alias("x"), F.col(y).alias("y")) for x, y in pairs])
    r = rows.select(F.explode(cells).alias("c")).select("c.*").where("x is not null and y is not null")
    return r.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg((F.col("x") == F.col("y")).cast("double")), 6).alias("agreement"))
