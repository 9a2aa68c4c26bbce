"""Registered queries on ballots, consensus, provenance and reliability."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import aggregates as A
from corpusloom.operators import consensus as C
from corpusloom.sources.corpus import STAGES, labelled, oracle, segments, table

CAST = """
people AS (SELECT * FROM segments WHERE speaker = 'participant'),
slots AS (SELECT *, unnest(generate_series(1, 3)) AS i FROM people),
ballots AS (SELECT segment_id, i - 1 AS rater, CASE WHEN ballots[i] IS NOT NULL THEN ballots[i] WHEN abstains[i] THEN -1 END AS v FROM slots),
counts AS (SELECT segment_id, v, count(*) AS c FROM ballots WHERE v IS NOT NULL GROUP BY ALL),
best AS (SELECT segment_id, v, c, sum(c) OVER (PARTITION BY segment_id) AS n_ballots, row_number() OVER (PARTITION BY segment_id ORDER BY c DESC, v) AS r, lead(c) OVER (PARTITION BY segment_id ORDER BY c DESC, v) AS other FROM counts),
votes AS (
  SELECT p.segment_id, p.human_label, p.confidence, CASE WHEN b.c * 2 > 3 THEN b.v END AS winner, coalesce(b.c, 0)::INTEGER AS n_agree, coalesce(b.n_ballots, 0)::INTEGER AS n_ballots,
    CASE WHEN b.c IS NULL THEN 'none' WHEN b.c * 2 <= 3 THEN 'split' WHEN b.c = 3 THEN 'unanimous' ELSE 'majority' END AS level, coalesce(b.other = b.c, false) AS tied
  FROM people p LEFT JOIN (SELECT * FROM best WHERE r = 1) b USING (segment_id)
)
"""
MIXED = """
masses AS (SELECT *, list_transform(generate_series(0, 4), lambda k: (CASE WHEN label = k THEN greatest(confidence, 0.01) ELSE 0.0 END + CASE WHEN second_label = k THEN 0.5 * greatest(confidence, 0.01) ELSE 0.0 END)::DOUBLE) AS mass FROM labelled),
shares AS (SELECT *, list_transform(mass, lambda m: round(m / list_sum(mass), 4)) AS mixture FROM masses),
parts AS (SELECT *, unnest(generate_series(0, 4)) AS k FROM shares),
ranks AS (SELECT segment_id, k, mixture[k + 1] AS p, row_number() OVER (PARTITION BY segment_id ORDER BY mixture[k + 1] DESC, k DESC) AS r FROM parts),
tops AS (SELECT segment_id, max(CASE WHEN r = 1 THEN k END) AS max_stage, max(CASE WHEN r = 2 THEN k END) AS second_stage, max(CASE WHEN r = 1 THEN p END) AS p1, max(CASE WHEN r = 2 THEN p END) AS p2 FROM ranks GROUP BY ALL),
mixed AS (
  SELECT s.*, t.max_stage::INTEGER AS max_stage, t.second_stage::INTEGER AS second_stage, t.p1, t.p2, round(-list_sum(list_transform(mixture, lambda p: CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0 END)) / ln(5.0), 4) AS entropy,
    round(mixture[2] + 2 * mixture[3] + 3 * mixture[4] + 4 * mixture[5], 4) AS coordinate, len(list_filter(mixture, lambda p: p >= 0.15))::INTEGER AS n_active
  FROM shares s JOIN tops t USING (segment_id)
)
"""


def people(spark, sf_dir):
    return segments(spark, sf_dir).where("speaker = 'participant'")


def _mixed(spark, sf_dir):
    return C.superposition(labelled(spark, sf_dir), STAGES)


@register("single_label_votes", oracle(f"{CAST} SELECT segment_id, winner, n_agree, n_ballots, level, tied FROM votes"))
def single_label_votes(spark, sf_dir):
    return C.vote(people(spark, sf_dir)).select("segment_id", "winner", "n_agree", "n_ballots", "level", "tied")


@register("agreement_levels", oracle(f"{CAST} SELECT level, count(*) AS n, round(avg(n_agree::DOUBLE), 6) AS mean_agree FROM votes GROUP BY level"))
def agreement_levels(spark, sf_dir):
    return C.agreement_levels(people(spark, sf_dir))


@register("label_provenance", oracle(f"""{CAST}, m AS (SELECT *, CASE WHEN winner >= 0 THEN winner END AS machine FROM votes)
SELECT segment_id, machine AS final_label, CASE WHEN human_label = machine THEN 'human_consensus' WHEN machine IS NOT NULL THEN 'machine' END AS source,
  CASE WHEN machine IS NULL THEN NULL WHEN n_agree = 3 AND confidence > 0.8 THEN 'high' WHEN n_agree >= 2 AND confidence > 0.6 THEN 'medium' ELSE 'low' END AS tier FROM m"""))
def label_provenance(spark, sf_dir):
    return C.provenance(people(spark, sf_dir))


@register("percent_agreement", oracle(f"""{CAST}, units AS (SELECT segment_id, sum(c) AS n, sum(c * (c - 1)) AS same, count(*) AS kinds FROM counts GROUP BY ALL HAVING sum(c) >= 2)
SELECT count(*) AS units, round(avg((kinds = 1)::INTEGER::DOUBLE), 6) AS unanimous, round(avg(same / (n * (n - 1))), 6) AS pairwise FROM units"""))
def percent_agreement(spark, sf_dir):
    return C.percent_agreement(people(spark, sf_dir))


def _fleiss_sql(condition: str) -> str:
    return oracle(f"""{CAST}, units AS (SELECT segment_id, sum(c) AS n, sum(c * c) AS sq FROM counts GROUP BY ALL HAVING sum(c) {condition}),
o AS (SELECT count(*) AS units, avg((sq - n) / (n * (n - 1))) AS po FROM units), l AS (SELECT v, sum(c) AS c FROM counts WHERE segment_id IN (SELECT segment_id FROM units) GROUP BY ALL),
e AS (SELECT sum(p * p) AS pe FROM (SELECT c / sum(c) OVER () AS p FROM l))
SELECT units, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM o, e""")


@register("fleiss_kappa", _fleiss_sql(">= 2"))
def fleiss_kappa(spark, sf_dir):
    return C.fleiss_kappa(people(spark, sf_dir))


@register("fleiss_kappa_complete", _fleiss_sql("= 3"))
def fleiss_kappa_complete(spark, sf_dir):
    return C.fleiss_kappa(people(spark, sf_dir), complete=True)


@register("krippendorff_alpha", oracle(f"""{CAST}, u AS (SELECT segment_id, v, c, sum(c) OVER (PARTITION BY segment_id) AS n FROM counts), k AS (SELECT * FROM u WHERE n >= 2),
a AS (SELECT sum(c * (c - 1) / (n - 1)) AS same, sum(c) AS total FROM k), m AS (SELECT sum(m * (m - 1)) AS chance FROM (SELECT v, sum(c) AS m FROM k GROUP BY v))
SELECT total::BIGINT AS ballots, round(1 - (1 - same / total) / (1 - chance / (total * (total - 1))), 6) AS alpha FROM a, m"""))
def krippendorff_alpha(spark, sf_dir):
    return C.krippendorff_alpha(people(spark, sf_dir))


def _scaled_sql(distance: str) -> str:
    """Alpha from all pairs of ballots within a segment, by the squared distance of two labels."""
    return f"""{CAST}, u AS (SELECT segment_id, v, c, sum(c) OVER (PARTITION BY segment_id) AS n FROM counts WHERE v >= 0), k AS (SELECT * FROM u WHERE n >= 2),
m AS (SELECT v, sum(c)::DOUBLE AS m FROM k GROUP BY v),
d AS (SELECT a.v AS va, b.v AS vb, a.m * b.m AS mm, {distance} AS w FROM m a, m b, m g WHERE g.v BETWEEN least(a.v, b.v) AND greatest(a.v, b.v) GROUP BY a.v, b.v, a.m, b.m),
o AS (SELECT sum(x.c * y.c * w / (x.n - 1)) AS o FROM k x JOIN k y ON x.segment_id = y.segment_id JOIN d ON va = x.v AND vb = y.v), e AS (SELECT sum(mm * w) AS e FROM d), t AS (SELECT sum(m) AS t FROM m)
SELECT t::BIGINT AS ballots, round(1 - o * (t - 1) / e, 6) AS alpha FROM o, e, t"""


@register("krippendorff_alpha_ordinal", oracle(_scaled_sql("pow(sum(g.m) - (a.m + b.m) / 2, 2)")))
def krippendorff_alpha_ordinal(spark, sf_dir):
    return C.krippendorff_alpha_scaled(people(spark, sf_dir), "ordinal")


@register("krippendorff_alpha_interval", oracle(_scaled_sql("pow(a.v - b.v, 2)")))
def krippendorff_alpha_interval(spark, sf_dir):
    return C.krippendorff_alpha_scaled(people(spark, sf_dir), "interval")


@register("missing_label_shares", oracle("SELECT kind, count(*) AS n, round(avg((v IS NULL)::INTEGER::DOUBLE), 6) AS share FROM (SELECT unnest([{'kind': 'label', 'v': label}, {'kind': 'second_label', 'v': second_label}, {'kind': 'human_label', 'v': human_label}], recursive := true) FROM segments WHERE speaker = 'participant') GROUP BY kind"))
def missing_label_shares(spark, sf_dir):
    """Share of participants' segments without each kind of label."""
    return C.null_shares(people(spark, sf_dir), ["label", "second_label", "human_label"])


KAPPA = """SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM (SELECT count(*) AS n, avg((a = b)::INTEGER::DOUBLE) AS po FROM r),
(SELECT sum(x.c * y.c) / (SELECT count(*) * count(*) FROM r) AS pe FROM (SELECT a AS v, count(*) AS c FROM r GROUP BY a) x JOIN (SELECT b AS v, count(*) AS c FROM r GROUP BY b) y USING (v))"""


@register("human_machine_kappa", oracle(f"{CAST}, r AS (SELECT human_label AS a, coalesce(winner, -1) AS b FROM votes WHERE human_label IS NOT NULL) {KAPPA}"))
def human_machine_kappa(spark, sf_dir):
    v = C.vote(people(spark, sf_dir)).withColumn("machine", F.coalesce("winner", F.lit(C.ABSTAIN)))
    return C.cohen_kappa(v, "human_label", "machine")


@register("labels_kappa", f"WITH r AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) {KAPPA}")
def labels_kappa(spark, sf_dir):
    return C.cohen_kappa(table(spark, sf_dir, "labels"), "quality", "toxic")


@register("rater_pair_kappa", oracle(f"""{CAST}, j AS (SELECT x.rater::INTEGER AS rater_a, y.rater::INTEGER AS rater_b, x.v AS la, y.v AS lb FROM ballots x JOIN ballots y ON x.segment_id = y.segment_id AND x.rater < y.rater WHERE x.v IS NOT NULL AND y.v IS NOT NULL),
b AS (SELECT rater_a, rater_b, count(*) AS n, avg((la = lb)::INTEGER::DOUBLE) AS po FROM j GROUP BY ALL),
pa AS (SELECT rater_a, rater_b, la AS v, count(*) AS c FROM j GROUP BY ALL), pb AS (SELECT rater_a, rater_b, lb AS v, count(*) AS c FROM j GROUP BY ALL),
e AS (SELECT rater_a, rater_b, sum(pa.c * pb.c) AS s FROM pa JOIN pb USING (rater_a, rater_b, v) GROUP BY ALL)
SELECT rater_a, rater_b, n, round(po, 6) AS agreement, round((po - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM b JOIN e USING (rater_a, rater_b)"""))
def rater_pair_kappa(spark, sf_dir):
    return C.rater_pairs(people(spark, sf_dir))


@register("human_machine_confusion", oracle(f"{CAST} SELECT human_label AS truth, coalesce(winner, -1) AS predicted, count(*) AS n FROM votes WHERE human_label IS NOT NULL GROUP BY ALL"))
def human_machine_confusion(spark, sf_dir):
    v = C.vote(people(spark, sf_dir)).withColumn("machine", F.coalesce("winner", F.lit(C.ABSTAIN)))
    return C.confusion(v, "human_label", "machine")


@register("precision_recall_by_stage", oracle(f"""{CAST}, r AS (SELECT human_label AS t, coalesce(winner, -1) AS p FROM votes WHERE human_label IS NOT NULL),
ls AS (SELECT t AS label FROM r UNION SELECT p FROM r), c AS (SELECT label, (SELECT count(*) FROM r WHERE t = label) AS support, (SELECT count(*) FROM r WHERE p = label) AS said, (SELECT count(*) FROM r WHERE t = label AND p = label) AS hit FROM ls)
SELECT label, support::BIGINT AS support, round(CASE WHEN said > 0 THEN hit / said ELSE 0.0 END, 6) AS precision, round(CASE WHEN support > 0 THEN hit / support ELSE 0.0 END, 6) AS recall FROM c"""))
def precision_recall_by_stage(spark, sf_dir):
    v = C.vote(people(spark, sf_dir)).withColumn("machine", F.coalesce("winner", F.lit(C.ABSTAIN)))
    return C.precision_recall(v, "human_label", "machine")


@register("calibration_error", oracle(f"""{CAST}, r AS (SELECT confidence AS c, human_label = coalesce(winner, -1) AS ok FROM votes WHERE human_label IS NOT NULL),
b AS (SELECT greatest(1, ceil(c * 15)) AS bin, count(*) AS n, avg(c) AS c, avg(ok::INTEGER::DOUBLE) AS a FROM r GROUP BY 1) SELECT sum(n)::BIGINT AS n, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b"""))
def calibration_error(spark, sf_dir):
    v = C.vote(people(spark, sf_dir)).where("human_label is not null").withColumn("ok", F.col("human_label") == F.coalesce("winner", F.lit(C.ABSTAIN)))
    return C.calibration_error(v, "confidence", "ok")


@register("segment_superposition", oracle(f"{MIXED} SELECT segment_id, mixture[1] AS mix_0, mixture[2] AS mix_1, mixture[3] AS mix_2, mixture[4] AS mix_3, mixture[5] AS mix_4, coordinate, entropy, max_stage, second_stage, n_active, entropy >= 0.6 OR round(p1 - p2, 4) < 0.25 AS liminal FROM mixed"))
def segment_superposition(spark, sf_dir):
    m = _mixed(spark, sf_dir)
    return m.select("segment_id", *[F.get("mixture", F.lit(k)).alias(f"mix_{k}") for k in range(STAGES)], "coordinate", "entropy", "max_stage", "second_stage", "n_active", "liminal")


@register("soft_theme_code_lift", oracle(f"""{MIXED}, spread AS (SELECT segment_id, (k)::INTEGER AS label, mixture[k + 1] AS p, list_distinct(codes) AS cs FROM (SELECT *, unnest(generate_series(0, 4)) AS k FROM mixed)),
mass AS (SELECT label, sum(p) AS mass FROM spread GROUP BY ALL), held AS (SELECT label, code, sum(p) AS expected FROM (SELECT label, p, unnest(cs) AS code FROM spread) GROUP BY ALL),
base AS (SELECT code, count(*) AS n FROM (SELECT unnest(list_distinct(codes)) AS code FROM mixed) GROUP BY ALL)
SELECT label, code, round(expected, 6) AS expected, round((expected / mass) / (n / (SELECT count(*) FROM mixed)), 6) AS soft_lift FROM held JOIN mass USING (label) JOIN base USING (code) WHERE mass > 0"""))
def soft_theme_code_lift(spark, sf_dir):
    return A.soft_code_lift(_mixed(spark, sf_dir), STAGES)


@register("participant_session_outcomes", oracle(f"{MIXED} SELECT participant_id, session_id, session_number, cohort_id, round(avg(coordinate), 6) AS mean_coordinate, round(avg((label IN (2, 3, 4))::INTEGER::DOUBLE), 6) AS adaptive, round(avg((label IN (0, 1))::INTEGER::DOUBLE), 6) AS maladaptive, count(*) AS n FROM mixed GROUP BY participant_id, session_id, session_number, cohort_id"))
def participant_session_outcomes(spark, sf_dir):
    return A.session_outcomes(_mixed(spark, sf_dir))


@register("cusp_density_by_session", oracle(f"{MIXED} SELECT session_id, round(avg((least(max_stage, second_stage) = 1 AND greatest(max_stage, second_stage) = 2)::INTEGER::DOUBLE), 6) AS density, count(*) AS n FROM mixed GROUP BY session_id"))
def cusp_density_by_session(spark, sf_dir):
    return A.cusp_density(_mixed(spark, sf_dir))


@register("stage_cooccurrence", oracle(f"""{MIXED}, cells AS (SELECT max_stage AS a, second_stage AS b, p1 * p2 AS x FROM mixed UNION ALL SELECT second_stage, max_stage, p1 * p2 FROM mixed UNION ALL SELECT max_stage, max_stage, p1 * p1 FROM mixed)
SELECT a, b, round(sum(x) / (SELECT count(*) FROM mixed), 4) AS cooccurrence FROM cells GROUP BY a, b"""))
def stage_cooccurrence(spark, sf_dir):
    return A.stage_cooccurrence(_mixed(spark, sf_dir))


@register("participant_rater_labels", oracle(f"{CAST} SELECT segment_id, rater::INTEGER AS rater, v AS label FROM ballots WHERE v IS NOT NULL"))
def participant_rater_labels(spark, sf_dir):
    return C.rater_labels(people(spark, sf_dir))


@register("multi_label_votes", oracle("h AS (SELECT segment_id, unnest(codes) AS code FROM labelled) SELECT segment_id, code, count(*) AS votes FROM h GROUP BY ALL HAVING count(*) * 2 > 3"))
def multi_label_votes(spark, sf_dir):
    return C.multi_label_vote(labelled(spark, sf_dir))


@register("human_machine_discrepancies", oracle(f"{CAST} SELECT segment_id, human_label, coalesce(winner, -1) AS machine FROM votes WHERE human_label IS NOT NULL AND human_label <> coalesce(winner, -1)"))
def human_machine_discrepancies(spark, sf_dir):
    return C.discrepancies(people(spark, sf_dir))
