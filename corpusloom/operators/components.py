"""How much of a label the leading components of the vectors carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.consensus import cohen_kappa
from corpusloom.operators.lineage import materialize


def label_by_components(rows: DataFrame, ks: list[int], vector: str = "embedding", label: str = "label", ridge: float = 0.01) -> DataFrame:
    """Out-of-fold kappa of class-balanced probes on the first k components, for each k: k, n, kappa, agreement, cum_var, modal_share.

    ``rows`` has ``fold``. Components are fitted on the other folds alone, once for the
    largest k: the first k of them are those of a smaller fit. The row without k is the
    whole vector's. ``cum_var`` is the mean share of variance over the folds, ``modal_share``
    the agreement that the most frequent label reaches. A k over the vectors' size is left
    out. Rows without label, fold or vector are left out; a single fold gives no rows.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import PCA, VectorSlicer
    from pyspark.ml.functions import array_to_vector

    known = rows.where(F.col(label).isNotNull() & F.col("fold").isNotNull() & F.col(vector).isNotNull())
    data = materialize(known.select("fold", F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("whole")))
    folds = sorted(r[0] for r in data.select("fold").distinct().collect())
    schema = "k int, n long, kappa double, agreement double, cum_var double, modal_share double"
    if len(folds) < 2:
        return rows.sparkSession.createDataFrame([], schema)
    width = data.first()["whole"].size
    ks, shares, out = sorted(k for k in set(ks) if k <= width), {}, None
    for fold in folds:
        train, test = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
        total = sum(counts.values())
        weight = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, total / (len(counts) * n))])
        model = PCA(k=max(ks, default=1), inputCol="whole", outputCol="parts").fit(train)
        for k in ks:
            shares[k] = shares.get(k, 0.0) + float(model.explainedVariance.toArray()[:k].sum()) / len(folds)
        train = model.transform(train).withColumn("weight", F.element_at(weight, F.col("label")))
        test = model.transform(test)
        for k in (*ks, None):
            cut = VectorSlicer(inputCol="parts", outputCol="features", indices=list(range(k))) if k else None
            use = cut.transform if cut else (lambda df: df.withColumn("features", F.col("whole")))
            probe = LogisticRegression(weightCol="weight", regParam=ridge, maxIter=40).fit(use(train))
            part = probe.transform(use(test)).select(F.lit(k).cast("int").alias("k"), "label", "prediction")
            out = part if out is None else out.union(part)
    # A null k is a group of its own; the kappa joins need a value there.
    found = cohen_kappa(out.withColumn("k", F.coalesce("k", F.lit(0))), "label", "prediction", ["k"])
    modal = data.groupBy("label").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("m")).first()["m"]
    var = F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, round(v, 6))]) if shares else F.lit(None)
    return found.select(F.when(F.col("k") > 0, F.col("k")).alias("k"), "n", "kappa", "agreement", (F.try_element_at(var, F.col("k")) if shares else F.lit(None)).cast("double").alias("cum_var"), F.lit(round(modal, 6)).alias("modal_share"))
