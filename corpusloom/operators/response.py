"""What follows a cue: soft-label models of the next mixture, counterfactual cues, and where they part from what is seen.

Rows are blocks: from_id, participant_id, from_stage, move, delta, ``start`` and
``target`` (mixtures of the segments before and after) and ``vector`` of the cue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.inference import drawn_sums
from corpusloom.operators.lineage import materialize

ARMS = ("with_cue", "from_only")


def response_rows(blocks: DataFrame, mixtures: DataFrame, cues: DataFrame, stages: int) -> DataFrame:
    """The rows of this module from blocks, mixtures (segment_id, mixture) and cue vectors (from_id, vector).

    Blocks without a cue vector, or without a mixture on either side, are left out;
    mixtures are scaled to a sum of one.
    """
    scaled = F.transform("mixture", lambda x: x / F.aggregate("mixture", F.lit(0.0), lambda a, y: a + y))
    at = lambda ident, name: mixtures.where("mixture is not null").select(F.col("segment_id").alias(ident), scaled.alias(name))
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(stages - 1)), lambda k: (k == F.col("from_stage")).cast("double"))
    rows = blocks.where("from_stage is not null").join(cues.where("vector is not null"), "from_id").join(at("from_id", "start"), "from_id").join(at("to_id", "target"), "to_id")
    return rows.select("from_id", "participant_id", "from_stage", "move", "delta", F.concat("start", one_hot).alias("start"), "target", "vector")


def _ml(column):
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(column)


def _projection(rows: DataFrame, k: int):
    """A transformer to the ``k`` first components of unit cue vectors of ``rows``: DataFrame to DataFrame with ``cue``."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    unit = lambda df: df.withColumn("_unit", _ml(F.transform("vector", lambda x: F.when(norm > 0, x / norm).otherwise(0.0))))
    model = PCA(k=k, inputCol="_unit", outputCol="_cue").fit(unit(rows))
    return lambda df: model.transform(unit(df)).withColumn("cue", vector_to_array("_cue")).drop("_unit", "_cue")


def _fit(rows: DataFrame, features: Column, ridge: float):
    """A multinomial model of the mixture: each row counts for every stage with its share. DataFrame to DataFrame with ``fitted``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    shares = rows.select(_ml(features).alias("features"), F.posexplode("target").alias("k", "w")).select("features", F.col("k").cast("double").alias("label"), "w").where("w > 0")
    model = LogisticRegression(family="multinomial", weightCol="w", regParam=ridge, maxIter=60).fit(shares)
    stages = model.numClasses
    padded = lambda p: F.concat(p, F.array_repeat(F.lit(0.0), F.size("target") - stages))
    return lambda df: model.transform(df.withColumn("features", _ml(features))).withColumn("fitted", padded(vector_to_array("probability"))).drop("features", "probability", "rawPrediction", "prediction")


def _stage(mix: Column) -> Column:
    return F.aggregate(F.transform(mix, lambda p, k: p * k), F.lit(0.0), lambda a, x: a + x)


def _divergence(target: Column, fitted: Column) -> Column:
    """Kullback-Leibler divergence of the target from the fitted mixture."""
    part = F.zip_with(target, fitted, lambda t, p: F.when(t > 0, t * (F.log(t) - F.log(F.greatest(p, F.lit(1e-9))))).otherwise(0.0))
    return F.aggregate(part, F.lit(0.0), lambda a, x: a + x)


def crossval(rows: DataFrame, k: int = 8, ridge: float = 0.01) -> DataFrame:
    """Held-out quality with and without the cue: arm, n, kl, estage_mae, argmax_acc.

    ``rows`` has a ``fold`` that whole participants share. Components of the cues and both models are fitted
    on the other folds alone. The fits see sums only; nothing but coefficients reaches the
    driver. Folds are those that occur; a single one gives no rows.
    """
    data, out = materialize(rows), None
    top = lambda m: F.array_position(m, F.array_max(m))
    for fold in sorted(r[0] for r in data.select("fold").distinct().where("fold is not null").collect()):
        train, test = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        if train.isEmpty():
            continue
        project = _projection(train, k)
        train, test = project(train), project(test)
        for arm in ARMS:
            features = F.concat("start", "cue") if arm == ARMS[0] else F.col("start")
            scored = _fit(train, features, ridge)(test)
            part = scored.select(F.lit(arm).alias("arm"), _divergence(F.col("target"), F.col("fitted")).alias("kl"), F.abs(_stage(F.col("fitted")) - _stage(F.col("target"))).alias("mae"), (top("fitted") == top("target")).cast("double").alias("acc"))
            out = part if out is None else out.union(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "arm string, n long, kl double, estage_mae double, argmax_acc double")
    return out.groupBy("arm").agg(F.count("*").alias("n"), *[F.round(F.avg(a), 4).alias(b) for a, b in (("kl", "kl"), ("mae", "estage_mae"), ("acc", "argmax_acc"))])


def counterfactual(rows: DataFrame, moves: int, k: int = 8, ridge: float = 0.01, least: int = 2) -> DataFrame:
    """Change of the expected next stage of every block if its cue were a move's mean cue: from_id, participant_id, from_stage, move, influence.

    The model is fitted on all rows; the change is against the mean cue of all. Moves
    with fewer than ``least`` blocks have no mean cue and no rows.
    """
    data = materialize(rows)
    if data.isEmpty():
        return data.select("from_id", "participant_id", "from_stage", "move", F.lit(0.0).alias("influence"))
    projected = _projection(data, k)(data)
    predict = _fit(projected, F.concat("start", "cue"), ridge)
    means = lambda df, *by: df.select(*by, F.posexplode("cue").alias("p", "x")).groupBy(*by, "p").agg(F.avg("x").alias("m"))
    listed = lambda found: [r["m"] for r in sorted(found, key=lambda r: r["p"])]
    none = listed(means(projected).collect())
    sizes = {r["move"]: r["n"] for r in projected.where(F.col("move").between(0, moves - 1)).groupBy("move").agg(F.count("*").alias("n")).collect()}
    own = means(projected.where(F.col("move").between(0, moves - 1)), "move").collect()
    cues = [(-1, none)] + [(m, listed([r for r in own if r["move"] == m])) for m in sorted(sizes) if sizes[m] >= least]
    swapped = projected.drop("cue", "move").withColumn("_s", F.explode(F.array(*[F.struct(F.lit(m).alias("move"), F.array(*[F.lit(float(x)) for x in c]).alias("cue")) for m, c in cues])))
    swapped = predict(swapped.select("*", "_s.move", "_s.cue").drop("_s")).withColumn("e", _stage(F.col("fitted")))
    base = F.max(F.when(F.col("move") < 0, F.col("e"))).over(Window.partitionBy("from_id"))
    return swapped.withColumn("influence", F.col("e") - base).where("move >= 0").select("from_id", "participant_id", "from_stage", "move", "influence")


def linked_difference(a: DataFrame, b: DataFrame, keys: list[str], cluster: str, value: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Mean of ``a`` less mean of ``b`` by key, with an interval under draws of clusters that both share.

    Both are summed by key and cluster first; a draw weighs a cluster's rows of both sides
    alike. Keys that one side lacks are left out. The interval is null below two clusters; draws that miss a
    side don't count. Null values and clusters are left out.
    """
    def sums(df, n, s):
        known = df.where(F.col(value).isNotNull() & F.col(cluster).isNotNull())
        return known.groupBy(*keys, cluster).agg(F.count("*").alias(n), F.sum(F.col(value).cast("double")).alias(s))

    both = sums(a, "an", "as").join(sums(b, "bn", "bs"), [*keys, cluster], "full").na.fill(0, ["an", "as", "bn", "bs"])
    d = drawn_sums(both, keys, cluster, ["an", "as", "bn", "bs"], draws, seed).where("an > 0 and bn > 0")
    mean_a, mean_b, real = F.col("as") / F.col("an"), F.col("bs") / F.col("bn"), F.col("draw") < 0
    own = lambda c: F.max(F.when(real, c))
    out = d.groupBy(*keys).agg(own(F.col("an").cast("long")).alias("n_a"), own(F.col("bn").cast("long")).alias("n_b"), own(F.col("clusters")).alias("clusters"), own(mean_a).alias("mean_a"), own(mean_b).alias("mean_b"), F.percentile(F.when(~real, mean_a - mean_b), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    bound = lambda i: F.when(F.col("clusters") > 1, F.round(F.get("q", F.lit(i)), 6))
    return out.where("n_a is not null").select(*keys, "n_a", "n_b", "clusters", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), F.round(F.col("mean_a") - F.col("mean_b"), 6).alias("difference"), bound(0).alias("low"), bound(1).alias("high"))


def confound_cells(rows: DataFrame, moves: int, k: int = 8, draws: int = 200, least: int = 2) -> DataFrame:
    """Observed change less learned influence by stage and move, with intervals over resampled participants.

    The observed side is the blocks whose cue has the move; the learned one every block of the
    stage under the move's mean cue. Cells with fewer than ``least`` observed blocks are left out.
    """
    rows = materialize(rows)
    learned = materialize(counterfactual(rows, moves, k)).withColumnRenamed("influence", "delta")
    seen = rows.where("move is not null and delta is not null")
    d = linked_difference(seen, learned, ["from_stage", "move"], "participant_id", "delta", draws).where(F.col("n_a") >= least)
    return d.select("from_stage", "move", F.col("n_a").alias("n_observed"), F.col("mean_a").alias("observed_delta"), F.col("mean_b").alias("counterfactual"), F.col("difference").alias("divergence"), F.col("low").alias("div_lo"), F.col("high").alias("div_hi"), ((F.col("mean_a") >= 0) != (F.col("mean_b") >= 0)).alias("sign_disagree"))
