"""Registered queries on responses to cues, linked differences, components, probes and anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import aggregates as A
from corpusloom.operators import components as K
from corpusloom.operators import consensus as C
from corpusloom.operators import graphs as N
from corpusloom.operators import motifs as Q
from corpusloom.operators import probes as P
from corpusloom.operators import response as R
from corpusloom.operators import segmentation as G
from corpusloom.plans.aggregates import LIFT
from corpusloom.plans.inference import _blocks, drawn_sql
from corpusloom.plans.segmentation import ROUNDED, VECTOR
from corpusloom.sources.corpus import MOVES, STAGES, labelled, oracle, segments, table


def _vectors(spark, sf_dir):
    return segments(spark, sf_dir).select("segment_id", G.sketch(F.lower("text")).alias("vector"))


def _rows(spark, sf_dir):
    blocks, people = _blocks(spark, sf_dir), labelled(spark, sf_dir)
    mixtures = C.superposition(people, STAGES).select("segment_id", "mixture")
    return R.response_rows(blocks, mixtures, Q.block_means(blocks, _vectors(spark, sf_dir)), STAGES)


@register("transition_crossval")
def transition_crossval(spark, sf_dir):
    """Held-out divergence of the next mixture with the cue and without it."""
    folds = A.participant_folds(labelled(spark, sf_dir), 3)
    return R.crossval(_rows(spark, sf_dir).join(folds, "participant_id"))


@register("confound_cells")
def confound_cells(spark, sf_dir):
    """Observed change less learned influence by stage and move."""
    return R.confound_cells(_rows(spark, sf_dir), MOVES)


_TIMES, _NUMBERS = drawn_sql("participant_id", 500)


@register("human_label_difference", oracle(f"""a AS (SELECT cohort_id, participant_id, count(*) AS an, sum(human_label)::DOUBLE AS asum FROM labelled WHERE human_label IS NOT NULL GROUP BY ALL), b AS (SELECT cohort_id, participant_id, count(*) AS bn, sum(label)::DOUBLE AS bsum FROM labelled GROUP BY ALL),
cl AS (SELECT coalesce(a.cohort_id, b.cohort_id) AS cohort_id, coalesce(a.participant_id, b.participant_id) AS participant_id, coalesce(an, 0) AS an, coalesce(asum, 0) AS asum, coalesce(bn, 0) AS bn, coalesce(bsum, 0) AS bsum FROM a FULL JOIN b ON a.cohort_id = b.cohort_id AND a.participant_id = b.participant_id),
dr AS (SELECT cohort_id, draw, sum(an * t) AS an, sum(asum * t) AS asum, sum(bn * t) AS bn, sum(bsum * t) AS bsum, count(*) AS clusters FROM (SELECT *, {_TIMES} AS t FROM cl, {_NUMBERS}) WHERE t > 0 GROUP BY ALL HAVING sum(an * t) > 0 AND sum(bn * t) > 0),
r AS (SELECT * FROM dr WHERE draw < 0), q AS (SELECT cohort_id, quantile_cont(asum / an - bsum / bn, 0.025) AS lo, quantile_cont(asum / an - bsum / bn, 0.975) AS hi FROM dr WHERE draw >= 0 GROUP BY ALL)
SELECT r.cohort_id, an::BIGINT AS n_a, bn::BIGINT AS n_b, clusters, round(asum / an, 6) AS mean_a, round(bsum / bn, 6) AS mean_b, round(asum / an - bsum / bn, 6) AS difference, CASE WHEN clusters > 1 THEN round(lo, 6) END AS low, CASE WHEN clusters > 1 THEN round(hi, 6) END AS high FROM r LEFT JOIN q ON q.cohort_id = r.cohort_id"""))
def human_label_difference(spark, sf_dir):
    """Mean human label less mean machine label by cohort, under shared draws of participants."""
    rows = labelled(spark, sf_dir)
    human = rows.select("cohort_id", "participant_id", F.col("human_label").alias("v"))
    return R.linked_difference(human, rows.select("cohort_id", "participant_id", F.col("label").alias("v")), ["cohort_id"], "participant_id", "v", 500)


@register("label_by_components")
def label_by_components(spark, sf_dir):
    """Kappa of probes on the first components of the vectors, and on whole vectors."""
    e = table(spark, sf_dir, "embeddings").withColumn("fold", F.pmod(F.col("vec_id"), F.lit(3)).cast("int"))
    return K.label_by_components(e, [2, 8, 32])


@register("probe_predictions")
def probe_predictions(spark, sf_dir):
    """Labels of all vectors by a probe fitted on half of them, abstaining under 0.3."""
    e, layout = table(spark, sf_dir, "embeddings"), P.layout_digest(["embedding"])
    return P.predict(e, P.fit_probe(e.where("vec_id % 2 = 0"), "v1", layout), layout, floors={k: 0.3 for k in range(10)})


_UNIT = f"v AS (SELECT segment_id, {VECTOR('lower(text)')} AS r FROM segments), u AS (SELECT segment_id, list_transform(r, lambda x: CASE WHEN list_dot_product(r, r) > 0 THEN x / sqrt(list_dot_product(r, r)) ELSE 0.0 END) AS v FROM v)"


@register("anchor_edges", oracle(f"""{_UNIT}, ce AS (SELECT label, list(m ORDER BY place) AS c FROM (SELECT label, place, {ROUNDED('avg(x)')} AS m FROM (SELECT label, unnest(range({G.SKETCH})) AS place, unnest(v) AS x FROM labelled JOIN u USING (segment_id)) GROUP BY ALL) GROUP BY label),
w AS (SELECT 'stage:' || label AS anchor_id, segment_id, round(greatest(0.0, CASE WHEN list_dot_product(v, v) > 0 THEN list_dot_product(v, c) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(c, c)) ELSE 0.0 END), 6) AS weight FROM u, ce)
SELECT anchor_id, segment_id, weight FROM w QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY weight DESC, segment_id) <= 8"""))
def anchor_edges(spark, sf_dir):
    """The segments most like the mean sketch of each label."""
    vectors = _vectors(spark, sf_dir)
    rows = labelled(spark, sf_dir).select("segment_id", "label").join(vectors, "segment_id").select("label", F.posexplode("vector").alias("place", "x"))
    means = rows.groupBy("label", "place").agg(F.round(F.avg("x"), 6).alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("place", "m"))).alias("c")).collect()
    return N.anchor_edges([(f"stage:{r['label']}", [x["m"] for x in r["c"]]) for r in means], vectors)


@register("cross_anchor_edges", oracle(f"{LIFT} SELECT 'stage:' || label AS src, 'code:' || code AS dst, lift AS weight FROM lifts WHERE lift >= 1.05"))
def cross_anchor_edges(spark, sf_dir):
    """Anchors of labels and codes that go together a twentieth more often than by chance."""
    return N.cross_anchor_edges(A.code_lift(labelled(spark, sf_dir)), 1.05)
