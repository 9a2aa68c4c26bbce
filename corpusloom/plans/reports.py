"""Registered queries behind the session, theme, code and participant reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import aggregates as A
from corpusloom.operators import consensus as C
from corpusloom.operators import reports as R
from corpusloom.plans.aggregates import LIFT
from corpusloom.plans.consensus import CAST, MIXED
from corpusloom.sources.corpus import STAGES, labelled, oracle, segments

PARTS = ", ".join(f"round(avg((label = {k})::INTEGER::DOUBLE), 4) AS s{k}" for k in range(STAGES))


@register("session_mean_of_participants", oracle(f"per AS (SELECT session_id, participant_id, {PARTS} FROM labelled GROUP BY ALL) SELECT session_id, count(*) AS participants, {', '.join(f'round(avg(s{k}), 6) AS share_{k}' for k in range(STAGES))} FROM per GROUP BY session_id"))
def session_mean_of_participants(spark, sf_dir):
    return R.session_shares(labelled(spark, sf_dir), STAGES)


@register("theme_report", oracle("""r AS (SELECT label, 'all' AS "by", '' AS value FROM labelled UNION ALL SELECT label, 'cohort', cohort_id::VARCHAR FROM labelled UNION ALL SELECT label, 'session', session_number::VARCHAR FROM labelled UNION ALL SELECT label, 'participant', participant_id FROM labelled)
SELECT label, "by", value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY "by", value), 6) AS prevalence FROM r GROUP BY label, "by", value"""))
def theme_report(spark, sf_dir):
    return R.theme_report(labelled(spark, sf_dir))


@register("theme_top_codes", oracle(f"{LIFT}, t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, code) AS r FROM lifts), u AS (SELECT label, code, n, lift, row_number() OVER (PARTITION BY label ORDER BY lift DESC, code)::INTEGER AS rank FROM t WHERE r <= 6) SELECT * FROM u WHERE rank <= 3"))
def theme_top_codes(spark, sf_dir):
    return R.theme_codes(labelled(spark, sf_dir))


@register("code_report", oracle("h AS (SELECT session_id, participant_id, confidence, unnest(list_distinct(codes)) AS code FROM segments) SELECT code, count(*) AS n, round(count(*) / (SELECT count(*) FROM segments), 3) AS prevalence, count(DISTINCT session_id) AS sessions, count(DISTINCT participant_id) AS participants, round(avg(confidence), 6) AS mean_confidence FROM h GROUP BY code"))
def code_report(spark, sf_dir):
    return R.code_report(segments(spark, sf_dir))


@register("participant_report", oracle(f"""{MIXED}, t AS (SELECT participant_id, session_number, label, count(*) AS c FROM mixed GROUP BY ALL), m AS (SELECT participant_id, session_number, arg_min(label, (-c, label)) AS modal FROM t GROUP BY ALL)
SELECT participant_id, session_number, count(*) AS n, round(avg(label), 8) AS progression, round(stddev_pop(label), 8) AS volatility, round(avg(coordinate), 8) AS coordinate, round(avg(entropy), 8) AS entropy, round(avg(confidence), 8) AS confidence, any_value(modal) AS modal FROM mixed JOIN m USING (participant_id, session_number) GROUP BY participant_id, session_number"""))
def participant_report(spark, sf_dir):
    return R.participant_report(C.superposition(labelled(spark, sf_dir), STAGES))


@register("secondary_label_map", oracle("SELECT session_id, label, second_label, count(*) AS n FROM labelled WHERE second_label IS NOT NULL GROUP BY ALL"))
def secondary_label_map(spark, sf_dir):
    return R.secondary_map(labelled(spark, sf_dir))


MACHINE = f"""{CAST},
held_by AS (SELECT v.segment_id, v.winner AS label, unnest(list_distinct(p.codes)) AS code FROM votes v JOIN people p USING (segment_id) WHERE v.winner >= 0),
lifts_b AS (SELECT label, code, round((count(*) / (SELECT count(*) FROM votes x WHERE x.winner = h.label)) / ((SELECT count(*) FROM held_by y WHERE y.code = h.code) / (SELECT count(*) FROM votes WHERE winner >= 0)), 6) AS lift FROM held_by h GROUP BY label, code)"""


@register("lift_comparison", oracle(f"{LIFT}, {MACHINE} SELECT label, code, coalesce(a.lift, 0.0) AS lift_a, coalesce(b.lift, 0.0) AS lift_b, coalesce(a.lift, 0.0) >= 1.2 AND coalesce(b.lift, 0.0) >= 1.2 AS \"both\" FROM lifts a FULL JOIN lifts_b b USING (label, code)"))
def lift_comparison(spark, sf_dir):
    """Lifts of the first labels beside those of the consensus labels."""
    voted = C.vote(segments(spark, sf_dir).where("speaker = 'participant'")).where("winner >= 0").withColumn("label", F.col("winner"))
    return R.compare_lifts(A.code_lift(labelled(spark, sf_dir)), A.code_lift(voted))


@register("code_set_reconciliation", oracle("""a AS (SELECT segment_id, unnest(list_distinct(codes[1:2])) AS code, confidence AS ca FROM segments), b AS (SELECT segment_id, unnest(list_distinct(codes[2:3])) AS code, 0.5::DOUBLE AS cb FROM segments)
SELECT segment_id, code, CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN 'agreed' WHEN ca IS NOT NULL THEN 'first' ELSE 'second' END AS state, ca IS NOT NULL AS kept, greatest(ca, cb) AS confidence FROM a FULL JOIN b USING (segment_id, code)"""))
def code_set_reconciliation(spark, sf_dir):
    s = segments(spark, sf_dir)
    part = lambda at, c: s.select("segment_id", F.explode(F.array_distinct(F.slice("codes", at, 2))).alias("code"), c.alias("confidence"))
    return R.reconcile(part(1, F.col("confidence")), part(2, F.lit(0.5)))


EXPECTED = [(k, f"k{c}") for k in range(STAGES) for c in (k, k + 3)]


@register("convergent_pairs", oracle(f"{LIFT}, e(label, code) AS (VALUES {', '.join(f'''({k}, '{c}')''' for k, c in EXPECTED)}) SELECT count(*) AS expected, count(*) FILTER (lift >= 1.0) AS convergent FROM e LEFT JOIN lifts USING (label, code)"))
def convergent_pairs(spark, sf_dir):
    return R.convergent_pairs(A.code_lift(labelled(spark, sf_dir)), EXPECTED)


SCORES = f"""{CAST}, r AS (SELECT human_label AS t, winner AS p, count(*) AS n FROM votes WHERE human_label IS NOT NULL AND winner IS NOT NULL GROUP BY ALL), spine AS (SELECT unnest(generate_series(0, 4))::INTEGER AS label),
s AS (SELECT label, sum(n * (t = label AND p = label)::INTEGER) AS hit, sum(n * (t = label)::INTEGER) AS support, sum(n * (p = label)::INTEGER) AS said, sum(n) AS total FROM spine, r GROUP BY label),
k AS (SELECT *, (total - support - said + 2 * hit) / total AS po, (support * said + (total - support) * (total - said)) / (total * total) AS pe FROM s),
scores AS (SELECT label, support::BIGINT AS support, round(CASE WHEN support > 0 THEN hit / support ELSE 0.0 END, 6) AS recall, round(CASE WHEN said > 0 THEN hit / said ELSE 0.0 END, 6) AS precision, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1.0 END, 6) AS kappa FROM k)"""


def _voted(spark, sf_dir):
    return C.vote(segments(spark, sf_dir).where("speaker = 'participant'"))


@register("class_scores", oracle(f"{SCORES} SELECT * FROM scores"))
def class_scores(spark, sf_dir):
    return R.class_scores(_voted(spark, sf_dir), "human_label", "winner", STAGES)


@register("classifier_readiness", oracle(f"""{SCORES}, x AS (SELECT human_label AS a, winner AS b FROM votes WHERE human_label IS NOT NULL AND winner IS NOT NULL), o AS (SELECT count(*) AS n, avg((a = b)::INTEGER::DOUBLE) AS po FROM x),
e AS (SELECT sum(pa * pb) AS pe FROM (SELECT a AS v, count(*) / sum(count(*)) OVER () AS pa FROM x GROUP BY a) JOIN (SELECT b AS v, count(*) / sum(count(*)) OVER () AS pb FROM x GROUP BY b) USING (v)),
w AS (SELECT count(*) AS weak FROM scores WHERE label IN (3, 4) AND support >= 5 AND recall < 0.5) SELECT n, round((po - pe) / (1 - pe), 6) AS kappa, weak, round((po - pe) / (1 - pe), 6) >= 0.7 AND weak = 0 AS ready FROM o, e, w"""))
def classifier_readiness(spark, sf_dir):
    v = _voted(spark, sf_dir)
    return R.readiness(C.cohen_kappa(v, "human_label", "winner"), R.class_scores(v, "human_label", "winner", STAGES))


@register("zero_shot_pass_rates", oracle("SELECT cohort_id, human_label, count(*) AS n, round(avg(coalesce(label = human_label, false)::INTEGER::DOUBLE + (NOT coalesce(label = human_label, false) AND coalesce(second_label = human_label, false))::INTEGER::DOUBLE), 6) AS passed FROM segments WHERE human_label IS NOT NULL GROUP BY ALL"))
def zero_shot_pass_rates(spark, sf_dir):
    return R.pass_rates(segments(spark, sf_dir).where("human_label is not null"), ["cohort_id", "human_label"], "human_label")


@register("session_change_examples", oracle("""t AS (SELECT participant_id, session_id, cohort_id, session_number, label, count(*) AS c, arg_min(segment_id, (-confidence, segment_index)) AS best FROM labelled GROUP BY ALL),
m AS (SELECT participant_id, session_id, cohort_id, session_number, arg_min(label, (-c, label)) AS stage, arg_min(best, (-c, label)) AS best FROM t GROUP BY ALL),
n AS (SELECT *, lead(stage) OVER o AS ns, lead(best) OVER o AS nb, lead(session_number) OVER o AS nn FROM m WINDOW o AS (PARTITION BY participant_id ORDER BY cohort_id, session_number, session_id))
SELECT participant_id, session_number, stage AS from_stage, ns AS to_stage, best AS from_id, nb AS to_id, nn - session_number AS gap FROM n WHERE ns IS NOT NULL AND ns <> stage"""))
def session_change_examples(spark, sf_dir):
    return R.session_examples(labelled(spark, sf_dir))
