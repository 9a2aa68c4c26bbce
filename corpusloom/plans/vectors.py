"""Registered queries on embeddings and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import consensus as C
from corpusloom.operators import vectors as V
from corpusloom.sources.corpus import labelled, oracle, segments, table

MEANS = """
parts AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS place, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, place, avg(x) AS mean FROM parts GROUP BY ALL),
cents AS (SELECT label, list(mean ORDER BY place) AS centroid FROM means GROUP BY label),
sims AS (SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], centroid) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(centroid, centroid))), 6) AS similarity FROM embeddings JOIN cents USING (label))
"""
NEAR = """
pairs AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))) AS s FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
near AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id))::INTEGER AS rank, vec_id, round(s, 6) AS similarity FROM pairs),
top AS (SELECT * FROM near WHERE rank <= 8)
"""


def _near(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return V.nearest(e, e.where("vec_id % 100 = 0"), 8)


@register("vector_neighbours", f"WITH {NEAR} SELECT * FROM top")
def vector_neighbours(spark, sf_dir):
    return _near(spark, sf_dir)


@register("neighbour_homophily", f"WITH {NEAR} SELECT count(*) AS pairs, round(avg((a.label = b.label)::INTEGER::DOUBLE), 6) AS same_share, round((SELECT sum(c * c) / (sum(c) * sum(c)) FROM (SELECT count(*) AS c FROM embeddings GROUP BY label)), 6) AS chance FROM top JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = top.vec_id")
def neighbour_homophily(spark, sf_dir):
    return V.homophily(_near(spark, sf_dir), table(spark, sf_dir, "embeddings").select("vec_id", "label"))


@register("centroid_similarity", f"WITH {MEANS} SELECT * FROM sims")
def centroid_similarity(spark, sf_dir):
    return V.centroid_similarity(table(spark, sf_dir, "embeddings"), "label")


@register("centroid_extremes", f"WITH {MEANS} SELECT label, arg_min(vec_id, (-similarity, vec_id)) AS typical_id, arg_min(vec_id, (similarity, vec_id)) AS atypical_id FROM sims GROUP BY label")
def centroid_extremes(spark, sf_dir):
    return V.atypical(table(spark, sf_dir, "embeddings"), "label")


@register("temporal_edges", oracle("p AS (SELECT segment_id AS src, lead(segment_id) OVER (PARTITION BY session_id ORDER BY segment_index) AS dst FROM segments) SELECT src, dst, 1.0::DOUBLE AS weight FROM p WHERE dst IS NOT NULL UNION ALL SELECT dst, src, 1.0::DOUBLE FROM p WHERE dst IS NOT NULL"))
def temporal_edges(spark, sf_dir):
    return V.temporal_edges(segments(spark, sf_dir))


@register("propagated_labels", oracle("""p AS (SELECT segment_id AS src, lead(segment_id) OVER (PARTITION BY session_id ORDER BY segment_index) AS dst FROM segments),
e AS (SELECT src, dst FROM p WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM p WHERE dst IS NOT NULL), w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY dst) AS w FROM e),
s0 AS (SELECT segment_id AS id, label, 1.0::DOUBLE AS mass FROM labelled),
s1 AS (SELECT id, label, sum(mass) AS mass FROM (SELECT dst AS id, label, 0.9 * mass * w AS mass FROM s0 JOIN w ON id = src UNION ALL SELECT id, label, mass * (1 - 0.9) FROM s0) GROUP BY ALL),
s2 AS (SELECT id, label, sum(mass) AS mass FROM (SELECT dst AS id, label, 0.9 * mass * w AS mass FROM s1 JOIN w ON id = src UNION ALL SELECT id, label, mass * (1 - 0.9) FROM s0) GROUP BY ALL),
s3 AS (SELECT id, label, sum(mass) AS mass FROM (SELECT dst AS id, label, 0.9 * mass * w AS mass FROM s2 JOIN w ON id = src UNION ALL SELECT id, label, mass * (1 - 0.9) FROM s0) GROUP BY ALL)
SELECT id, label, round(mass / sum(mass) OVER (PARTITION BY id), 6) AS share FROM s3"""))
def propagated_labels(spark, sf_dir):
    start = labelled(spark, sf_dir).select(F.col("segment_id").alias("id"), "label", F.lit(1.0).alias("mass"))
    return V.propagate(V.temporal_edges(segments(spark, sf_dir)), start, 3)


@register("vector_clusters")
def vector_clusters(spark, sf_dir):
    """k-means clusters of the embeddings, seeded."""
    return V.fit_clusters(table(spark, sf_dir, "embeddings"), 12)


@register("latent_factors")
def latent_factors(spark, sf_dir):
    """Scores of the embeddings on five principal components."""
    return V.fit_factors(table(spark, sf_dir, "embeddings"), 5)


@register("probe_out_of_fold")
def probe_out_of_fold(spark, sf_dir):
    """Agreement of a logistic probe's out-of-fold predictions with the labels."""
    e = table(spark, sf_dir, "embeddings").withColumn("fold", F.pmod(F.xxhash64("vec_id"), F.lit(3)).cast("int"))
    return C.cohen_kappa(V.grouped_probe(e), "truth", "predicted", ["fold"])
