"""Registered queries on confidence, abstention and resampled agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import aggregates as A
from corpusloom.operators import calibration as K
from corpusloom.operators import consensus as C
from corpusloom.operators import vectors as V
from corpusloom.plans.consensus import CAST, MIXED
from corpusloom.plans.inference import drawn_sql
from corpusloom.plans.vectors import NEAR
from corpusloom.sources.corpus import STAGES, labelled, oracle, segments, table

GRID = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0)
LOSSES = f"""{MIXED}, t AS (SELECT unnest([{', '.join(map(str, GRID))}])::DOUBLE AS temperature),
l AS (SELECT t.temperature, human_label AS y, list_transform(mixture, lambda p: exp(ln(greatest(p, 1e-12)) / t.temperature)) AS e FROM mixed, t WHERE human_label IS NOT NULL),
losses AS (SELECT temperature, round(avg(-ln(greatest(e[y + 1] / list_sum(e), 1e-12))), 6) AS loss FROM l GROUP BY temperature)"""


def _scored(spark, sf_dir):
    return C.superposition(labelled(spark, sf_dir), STAGES)


@register("temperature_losses", oracle(f"{LOSSES} SELECT * FROM losses"))
def temperature_losses(spark, sf_dir):
    return K.temperature_losses(_scored(spark, sf_dir), "mixture", "human_label", GRID)


@register("best_temperature", oracle(f"{LOSSES} SELECT arg_min(temperature, (loss, abs(temperature - 1))) AS temperature, min(loss) AS loss FROM losses"))
def best_temperature(spark, sf_dir):
    return K.best_temperature(K.temperature_losses(_scored(spark, sf_dir), "mixture", "human_label", GRID))


FLOORS = """c AS (SELECT label AS predicted, confidence, count(*) AS n, count(*) FILTER (label = human_label) AS hit FROM labelled WHERE human_label IS NOT NULL GROUP BY ALL),
p AS (SELECT *, round(sum(hit) OVER o / sum(n) OVER o, 6) AS prec FROM c WINDOW o AS (PARTITION BY predicted ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING)),
f AS (SELECT predicted, min(confidence) FILTER (prec >= 0.25) AS ok, arg_max(confidence, (prec, confidence)) AS best FROM p GROUP BY predicted), floors AS (SELECT predicted, coalesce(ok, best) AS floor, ok IS NOT NULL AS reached FROM f)"""


def _judged(spark, sf_dir):
    return labelled(spark, sf_dir).where("human_label is not null").select("segment_id", F.col("label").alias("predicted"), "confidence", (F.col("label") == F.col("human_label")).alias("correct"))


@register("abstain_floors", oracle(f"{FLOORS} SELECT * FROM floors"))
def abstain_floors(spark, sf_dir):
    return K.abstain_floors(_judged(spark, sf_dir), 0.25)


@register("abstained_predictions", oracle(f"{FLOORS} SELECT segment_id, label AS predicted, confidence, confidence < coalesce(floor, 0.0) AS abstain FROM labelled LEFT JOIN floors ON label = predicted"))
def abstained_predictions(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("segment_id", F.col("label").alias("predicted"), "confidence")
    return K.apply_floors(rows, K.abstain_floors(_judged(spark, sf_dir), 0.25))


ENSEMBLE = f"""{CAST}, cast_votes AS (SELECT * FROM ballots WHERE v >= 0), f AS (SELECT segment_id FROM cast_votes GROUP BY ALL HAVING count(DISTINCT rater) = 3),
prob AS (SELECT segment_id, s.label, rater, CASE WHEN v = s.label THEN 0.8 ELSE 0.05 END::DOUBLE AS p FROM cast_votes, (SELECT unnest(generate_series(0, 4))::INTEGER AS label) s),
ens AS (SELECT segment_id, label, round(avg(p), 6) AS p FROM prob JOIN f USING (segment_id) GROUP BY ALL)"""


def _ensemble(spark, sf_dir):
    votes = C.rater_labels(segments(spark, sf_dir).where("speaker = 'participant'")).where("label >= 0")
    p = votes.select("segment_id", "rater", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(STAGES - 1)), lambda k: F.when(k == F.col("label"), 0.8).otherwise(0.05))).alias("label", "p"))
    return K.ensemble(p, 3)


@register("ensemble_probabilities", oracle(f"{ENSEMBLE} SELECT * FROM ens"))
def ensemble_probabilities(spark, sf_dir):
    return _ensemble(spark, sf_dir)


@register("ensemble_winners", oracle(f"{ENSEMBLE} SELECT segment_id, arg_min(label, (-p, label)) AS predicted, max(p) AS confidence FROM ens GROUP BY segment_id"))
def ensemble_winners(spark, sf_dir):
    return K.winners(_ensemble(spark, sf_dir))


def _kappa_sql(draws: int = 500, other: str | None = None) -> str:
    times, numbers = drawn_sql("participant_id", draws)
    labels = ["human_label", "label", *([other] if other else [])]
    known = " AND ".join(f"{x} IS NOT NULL" for x in labels)
    kappa = lambda name, b: f"""{name} AS (SELECT draw, n, (CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) WHEN po >= 1 THEN 1 ELSE 0 END) AS kappa FROM (
SELECT draw, sum(n) AS n, coalesce(sum(n) FILTER (human_label = {b}), 0)::DOUBLE / sum(n) AS po, (SELECT coalesce(sum(l.n * r.n), 0) FROM (SELECT human_label AS v, sum(n)::DOUBLE AS n FROM w x WHERE x.draw = w.draw GROUP BY 1) l JOIN (SELECT {b} AS v, sum(n)::DOUBLE AS n FROM w x WHERE x.draw = w.draw GROUP BY 1) r USING (v)) / (sum(n)::DOUBLE * sum(n)) AS pe FROM w GROUP BY draw))"""  # noqa: E731
    value = "k.kappa - o.kappa" if other else "k.kappa"
    return f"""cl AS (SELECT participant_id, {', '.join(labels)}, count(*) AS m FROM labelled WHERE {known} GROUP BY ALL),
dr AS (SELECT *, {times} AS t FROM cl, {numbers}), w AS (SELECT draw, {', '.join(labels)}, sum(m * t) AS n FROM dr WHERE t > 0 GROUP BY ALL),
{kappa("k", "label")}{', ' + kappa("o", other) if other else ''},
v AS (SELECT k.draw, k.n, {value} AS value FROM k {'JOIN o USING (draw)' if other else ''})
SELECT (max(n) FILTER (draw < 0))::BIGINT AS n, (SELECT count(DISTINCT participant_id) FROM cl) AS clusters, round(max(value) FILTER (draw < 0), 6) AS value, round(quantile_cont(value, 0.025) FILTER (draw >= 0), 6) AS low, round(quantile_cont(value, 0.975) FILTER (draw >= 0), 6) AS high FROM v"""


@register("kappa_interval", oracle(_kappa_sql()))
def kappa_interval(spark, sf_dir):
    """Kappa of human and machine label with its interval over participants."""
    return K.agreement_interval(labelled(spark, sf_dir), "human_label", "label", "participant_id")


@register("kappa_contrast", oracle(_kappa_sql(other="second_label")))
def kappa_contrast(spark, sf_dir):
    """How much better the first machine label agrees with the human one than the second does."""
    return K.agreement_interval(labelled(spark, sf_dir), "human_label", "label", "participant_id", other="second_label")


@register("neighbour_distance", f"WITH {NEAR} SELECT query_id, round(avg(1 - similarity), 6) AS distance FROM top GROUP BY query_id")
def neighbour_distance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return K.distance_scores(V.nearest(e, e.where("vec_id % 100 = 0"), 8))


FOLDS = "folds AS (SELECT DISTINCT participant_id, (('0x' || substr(md5('42' || participant_id), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM labelled)"


@register("chance_baselines", oracle(f"""{FOLDS}, own AS (SELECT fold, label AS v, count(*) AS n FROM labelled JOIN folds USING (participant_id) GROUP BY ALL), tot AS (SELECT v, sum(n) AS t FROM own GROUP BY v),
g AS (SELECT f.fold, t.v, coalesce(o.n, 0) AS n, t.t - coalesce(o.n, 0) AS rest FROM (SELECT DISTINCT fold FROM own) f CROSS JOIN tot t LEFT JOIN own o ON o.fold = f.fold AND o.v = t.v)
SELECT fold, sum(n)::BIGINT AS n, round(arg_max(n, (rest, -v)) / sum(n), 6) AS modal, round(sum(n * rest) / (sum(n) * sum(rest)), 6) AS stratified FROM g GROUP BY fold"""))
def chance_baselines(spark, sf_dir):
    r = labelled(spark, sf_dir)
    return K.chance_baselines(r.join(A.participant_folds(r), "participant_id"))


@register("label_triangulation", oracle("""r AS (SELECT 'label' AS a, 'second_label' AS b, label AS x, second_label AS y FROM labelled UNION ALL SELECT 'label', 'human_label', label, human_label FROM labelled UNION ALL SELECT 'second_label', 'human_label', second_label, human_label FROM labelled)
SELECT a, b, count(*) AS n, round(avg((x = y)::INTEGER::DOUBLE), 6) AS agreement FROM r WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL"""))
def label_triangulation(spark, sf_dir):
    return K.triangulation(labelled(spark, sf_dir), ["label", "second_label", "human_label"])
