"""Registered queries on simple models."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import aggregates as A
from corpusloom.operators import consensus as C
from corpusloom.operators import models as O
from corpusloom.operators import transitions as T
from corpusloom.operators import vectors as V
from corpusloom.plans.transitions import BLOCKS
from corpusloom.plans.vectors import NEAR
from corpusloom.sources.corpus import MOVES, labelled, oracle, segments, table


def _blocks(spark, sf_dir):
    b = T.cue_blocks(segments(spark, sf_dir))
    return b.withColumn("move", T.dominant_move(F.col("moves"), MOVES)).withColumn("delta", (F.col("to_stage") - F.col("from_stage")).cast("double"))


COS = lambda a, b: f"CASE WHEN list_dot_product({a}, {a}) > 0 AND list_dot_product({b}, {b}) > 0 THEN list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) ELSE 0.0 END"


@register("code_scores", f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector FROM embeddings), c AS (SELECT 'v' || (vec_id // 3) AS code, max(vector) FILTER (vec_id % 3 = 0) AS d, max(vector) FILTER (vec_id % 3 = 1) AS k, max(vector) FILTER (vec_id % 3 = 2) AS x FROM (SELECT id AS vec_id, vector FROM v WHERE id < 36) GROUP BY 1),
s AS (SELECT id, code, round({COS('vector', 'd')} + 0.5 * {COS('vector', 'k')} + 0.5 * {COS('vector', 'x')}, 9) AS score FROM v, c), b AS (SELECT code, round(greatest(avg(score), (SELECT avg(score) FROM s)), 6) AS baseline FROM s GROUP BY code)
SELECT id, code, round(score, 6) AS score, round(least(1.0, CASE WHEN baseline > 0 THEN score / (baseline * 1.375) ELSE 1.0 END), 4) AS confidence FROM s JOIN b USING (code) WHERE score > baseline * 1.375""")
def code_scores(spark, sf_dir):
    """Twelve codes, each made of three vectors, assigned to all vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    pick = lambda k: F.max(F.when(F.col("id") % 3 == k, F.col("vector")))
    codes = v.where("id < 36").groupBy(F.concat(F.lit("v"), F.floor(F.col("id") / 3).cast("string")).alias("code")).agg(pick(0).alias("definition"), pick(1).alias("criteria"), pick(2).alias("examples"))
    return O.code_scores(v, codes)


@register("neighbour_votes", f"WITH {NEAR}, j AS (SELECT query_id, label, sum(greatest(similarity, 0.0)) AS w FROM top JOIN embeddings USING (vec_id) WHERE label IS NOT NULL GROUP BY ALL) SELECT query_id, arg_min(label, (-round(w, 6), label)) AS predicted, round(max(w) / sum(w), 6) AS share FROM j GROUP BY query_id")
def neighbour_votes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return O.neighbour_votes(V.nearest(e, e.where("vec_id % 100 = 0"), 8), e.select("vec_id", "label"))


@register("what_if_moves", oracle(f"""{BLOCKS}, b AS (SELECT from_stage, move::INTEGER AS move, to_stage FROM chosen WHERE move IS NOT NULL), o AS (SELECT from_stage, move, count(*) AS n, sum(to_stage) AS s FROM b GROUP BY ALL), a AS (SELECT from_stage, avg(to_stage) AS mean FROM b GROUP BY ALL),
j AS (SELECT a.from_stage, m.move, coalesce(n, 0) AS n, round((coalesce(s, 0) + mean) / (coalesce(n, 0) + 1), 6) AS expected, round(mean, 6) AS mean FROM a CROSS JOIN (SELECT unnest(range(5))::INTEGER AS move) m LEFT JOIN o ON o.from_stage = a.from_stage AND o.move = m.move)
SELECT from_stage, move, n, expected, round(expected - mean, 6) AS gain FROM j"""))
def what_if_moves(spark, sf_dir):
    return O.what_if(_blocks(spark, sf_dir), MOVES)


@register("design_frame", oracle(f"""{BLOCKS}, w AS (SELECT from_id, sum(word_count) AS cue_words FROM joined JOIN segments ON segment_id = turn_id GROUP BY ALL)
SELECT b.from_id, b.participant_id, s.session_number, b.from_stage, b.to_stage, b.n_turns::INTEGER AS n_turns, coalesce(cue_words, 0)::BIGINT AS cue_words, b.to_stage - b.from_stage AS delta FROM blocks b JOIN segments s ON s.segment_id = b.from_id LEFT JOIN w ON w.from_id = b.from_id"""))
def design_frame(spark, sf_dir):
    s = segments(spark, sf_dir)
    return O.design_frame(T.cue_blocks(s), s)


@register("within_participant_slope", oracle("""g AS (SELECT participant_id, count(*)::DOUBLE AS n, sum(session_number)::DOUBLE AS sx, sum(label)::DOUBLE AS sy, sum(session_number * session_number)::DOUBLE AS xx, sum(session_number * label)::DOUBLE AS xy, sum(label * label)::DOUBLE AS yy FROM labelled GROUP BY ALL),
t AS (SELECT sum(n) AS n, count(*) AS groups, sum(xx - sx * sx / n) AS sxx, sum(xy - sx * sy / n) AS sxy, sum(yy - sy * sy / n) AS syy FROM g), s AS (SELECT *, sxy / sxx AS b, sqrt((syy - sxy / sxx * sxy) / (n - groups - 1) / sxx) AS se FROM t)
SELECT n::BIGINT AS n, groups, round(b, 6) AS slope, round(se, 6) AS se, round(b / se, 4) AS z FROM s"""))
def within_participant_slope(spark, sf_dir):
    return O.random_intercept_slope(labelled(spark, sf_dir), "participant_id", "session_number", "label")


@register("move_noise_stability")
def move_noise_stability(spark, sf_dir):
    """Rank agreement of the moves' mean change when a fifth of the moves is replaced."""
    return O.noise_stability(_blocks(spark, sf_dir), 20, 0.2, MOVES)


@register("nested_model_losses")
def nested_model_losses(spark, sf_dir):
    """Held-out log-loss of the next label from the first label, with the move, and with both."""
    b = _blocks(spark, sf_dir).where("move is not null").withColumn("both", F.concat_ws("_", "from_stage", "move"))
    f = A.participant_folds(labelled(spark, sf_dir), 3)
    return O.nested_log_losses(b.join(f, "participant_id"), {"first": ["from_stage"], "additive": ["from_stage", "move"], "interaction": ["both"]}, "to_stage")


@register("factor_label_links")
def factor_label_links(spark, sf_dir):
    """Correlation of five principal components with the label."""
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    return O.factor_links(V.fit_factors(e, 5).join(e.select("vec_id", "label"), "vec_id"), "label", 5)


@register("label_subtypes")
def label_subtypes(spark, sf_dir):
    """Two clusters within each label."""
    e = table(spark, sf_dir, "embeddings")
    return O.subtypes(e, sorted(r.label for r in e.where("label is not null").select("label").distinct().collect()))


@register("attached_fold_kappa")
def attached_fold_kappa(spark, sf_dir):
    """Agreement of labels attached by neighbours with the queries' own, fold by fold."""
    e = table(spark, sf_dir, "embeddings")
    voted = O.neighbour_votes(V.nearest(e, e.where("vec_id % 100 = 0"), 8), e.select("vec_id", "label"))
    own = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth"), F.pmod(F.col("vec_id"), F.lit(2)).cast("int").alias("fold"))
    return C.cohen_kappa(voted.join(own, "query_id"), "truth", "predicted", ["fold"])
