"""Linear probes as tables: fitted once, kept by version, applied to new rows in any session."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One row a class: the model's version and the digest of the features it was fitted on.
MODEL = "version string, layout string, size int, label int, intercept double, weights array<double>, temperature double"


def layout_digest(names: list[str]) -> str:
    """Digest of the features' names in order; for unnamed vectors, of what made them and their size."""
    return hashlib.sha256("\n".join(names).encode()).hexdigest()


def fit_probe(rows: DataFrame, version: str, layout: str, vector: str = "embedding", label: str = "label", ridge: float = 0.05, temperature: float = 1.0) -> DataFrame:
    """A multinomial logistic probe as MODEL, fitted by the library's distributed solver; rows without label or vector are left out."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    known = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    data = known.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = LogisticRegression(family="multinomial", regParam=ridge, maxIter=40).fit(data)
    weights, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    found = [(version, layout, int(model.numFeatures), k, float(b), [float(x) for x in w], float(temperature)) for k, (w, b) in enumerate(zip(weights, intercepts))]
    return rows.sparkSession.createDataFrame(found, MODEL)


def save_probe(model: DataFrame, path: str) -> None:
    """Add a version to the table at ``path``; a version that is there already is an error."""
    version = model.first()["version"]
    spark, target = model.sparkSession, f"{path}/version={version}"
    there = spark._jvm.org.apache.hadoop.fs.Path(target)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        raise ValueError(f"version {version} is kept already")
    model.drop("version").coalesce(1).write.parquet(target)


def load_probe(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """MODEL of a kept version, the last in order of name where none is named."""
    every = spark.read.parquet(path).withColumn("version", F.col("version").cast("string"))
    version = version or every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == version).select(*[c.split()[0] for c in MODEL.split(", ")])


def predict(rows: DataFrame, model: DataFrame, layout: str, ident: str = "vec_id", vector: str = "embedding", floors: dict[int, float] | None = None) -> DataFrame:
    """Label of each row by a kept model: ``ident``, predicted, probability, abstained.

    A model that was fitted on another layout is an error. The model's rows, one a class,
    go into the plan as literals; rows are scored where they lie. A null vector, or one
    of another size, has no label. Under its label's floor a row abstains; equal probabilities
    go to the smaller label.
    """
    classes = model.orderBy("label").collect()
    if not classes or any(c["layout"] != layout for c in classes):
        raise ValueError("the model was fitted on another layout of features")
    size = classes[0]["size"]
    dot = lambda w: F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(x) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    raw = F.array(*[(dot(c["weights"]) + F.lit(c["intercept"])) / F.lit(c["temperature"]) for c in classes])
    fits = F.coalesce(F.size(vector) == size, F.lit(False))
    scored = rows.select(ident, F.when(fits, raw).alias("_raw"))
    total = F.aggregate(F.transform("_raw", lambda x: F.exp(x - F.array_max("_raw"))), F.lit(0.0), lambda s, x: s + x)
    labels = F.array(*[F.lit(c["label"]) for c in classes])
    scored = scored.withColumn("predicted", F.get(labels, F.array_position("_raw", F.array_max("_raw")).cast("int") - 1)).withColumn("probability", F.round(1 / total, 6))
    floor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in floors.items() for x in (int(k), float(v))]), F.col("predicted")), F.lit(0.0)) if floors else F.lit(0.0)
    return scored.select(ident, "predicted", "probability", (F.col("probability") < floor).alias("abstained"))


def classify(rows: DataFrame, model: DataFrame, layout: str, ident: str = "vec_id", vector: str = "embedding", floors: dict[int, float] | None = None) -> DataFrame:
    """``rows`` with predicted, probability and abstained; a label that abstains is null."""
    found = predict(rows, model, layout, ident, vector, floors)
    return rows.join(found, ident, "left").withColumn("predicted", F.when(~F.col("abstained"), F.col("predicted")))
