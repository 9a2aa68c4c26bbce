"""Registered queries on occupancy, trajectories, prevalence and lift."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import aggregates as A
from corpusloom.sources.corpus import STAGES, labelled, oracle, segments

SHARES = ", ".join(f"round(avg((label = {k})::INTEGER::DOUBLE), 6) AS stage_{k}_pct" for k in range(STAGES))
HELD = "held AS (SELECT segment_id, label, unnest(list_distinct(codes)) AS code FROM labelled)"
LIFT = f"""{HELD},
joint AS (SELECT label, code, count(*) AS n FROM held GROUP BY ALL),
lifts AS (SELECT label, code, n, round((n / (SELECT count(*) FROM labelled l WHERE l.label = joint.label)) / ((SELECT count(*) FROM held h WHERE h.code = joint.code) / (SELECT count(*) FROM labelled)), 6) AS lift FROM joint)"""
MEANS = "per AS (SELECT participant_id, session_number, avg(label) AS m, stddev_pop(label) AS sd FROM labelled GROUP BY ALL)"


@register("stage_shares_by_participant_session", oracle(f"SELECT participant_id, session_id, {SHARES}, round(avg(confidence), 6) AS mean_confidence, count(*) AS n FROM labelled GROUP BY ALL"))
def stage_shares_by_participant_session(spark, sf_dir):
    return A.stage_shares(labelled(spark, sf_dir), ["participant_id", "session_id"], STAGES)


def _group_sql(keys: str) -> str:
    own = ", ".join(f"avg((label = {k})::INTEGER::DOUBLE) AS s{k}" for k in range(STAGES))
    mean = ", ".join(f"round(avg(s{k}), 6) AS stage_{k}_pct" for k in range(STAGES))
    return oracle(f"own AS (SELECT participant_id, session_id, session_number, cohort_id, {own} FROM labelled GROUP BY ALL) SELECT {keys}, {mean}, count(*) AS participants FROM own GROUP BY {keys}")


@register("group_stage_trajectories", _group_sql("session_number, cohort_id"))
def group_stage_trajectories(spark, sf_dir):
    return A.group_shares(labelled(spark, sf_dir), ["session_number", "cohort_id"], STAGES)


@register("combined_cohort_trajectories", _group_sql("session_number"))
def combined_cohort_trajectories(spark, sf_dir):
    return A.group_shares(labelled(spark, sf_dir), ["session_number"], STAGES)


@register("session_mean_shares", _group_sql("session_id"))
def session_mean_shares(spark, sf_dir):
    return A.group_shares(labelled(spark, sf_dir), ["session_id"], STAGES)


@register("code_prevalence_by_session", oracle(f"held AS (SELECT session_id, participant_id, unnest(list_distinct(codes)) AS code FROM labelled), sizes AS (SELECT session_id, participant_id, count(*) AS c FROM labelled GROUP BY ALL) SELECT participant_id, session_id, code, count(*) AS n, round(count(*) / any_value(c), 6) AS prevalence FROM held JOIN sizes USING (session_id, participant_id) GROUP BY participant_id, session_id, code"))
def code_prevalence_by_session(spark, sf_dir):
    return A.code_prevalence(labelled(spark, sf_dir), ["participant_id", "session_id"])


@register("code_prevalence_by_cohort", oracle("held AS (SELECT cohort_id, unnest(list_distinct(codes)) AS code FROM labelled), sizes AS (SELECT cohort_id, count(*) AS c FROM labelled GROUP BY ALL) SELECT cohort_id, code, count(*) AS n, round(count(*) / any_value(c), 6) AS prevalence FROM held JOIN sizes USING (cohort_id) GROUP BY cohort_id, code"))
def code_prevalence_by_cohort(spark, sf_dir):
    return A.code_prevalence(labelled(spark, sf_dir), ["cohort_id"])


@register("confidence_tiers_by_stage", oracle("""counts AS (SELECT label, CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence > 0.6 THEN 'medium' ELSE 'low' END AS tier, count(*) AS c FROM labelled GROUP BY ALL),
grid AS (SELECT i::INTEGER AS label, t AS tier FROM range(5) r(i), (VALUES ('high'), ('medium'), ('low')) v(t)), filled AS (SELECT label, tier, coalesce(c, 0) AS n FROM grid LEFT JOIN counts USING (label, tier))
SELECT label, tier, n, round(CASE WHEN sum(n) OVER (PARTITION BY label) > 0 THEN n / sum(n) OVER (PARTITION BY label) ELSE 0.0 END, 6) AS share FROM filled"""))
def confidence_tiers_by_stage(spark, sf_dir):
    return A.tier_by_stage(labelled(spark, sf_dir), STAGES)


@register("theme_code_lift", oracle(f"{LIFT} SELECT * FROM lifts"))
def theme_code_lift(spark, sf_dir):
    return A.code_lift(labelled(spark, sf_dir))


@register("strong_theme_code_associations", oracle(f"{LIFT} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY lift DESC, code)::INTEGER AS rank FROM lifts WHERE lift >= 1.2 AND n >= 3) WHERE rank <= 10"))
def strong_theme_code_associations(spark, sf_dir):
    return A.strong_associations(labelled(spark, sf_dir))


@register("participant_slopes", oracle(f"{MEANS} SELECT participant_id, count(*) AS sessions, round(CASE WHEN count(*) > 1 THEN regr_slope(m, session_number) END, 6) AS slope, round(arg_min(m, session_number), 6) AS baseline, round(arg_max(m, session_number), 6) AS endpoint, round(arg_max(m, session_number) - arg_min(m, session_number), 6) AS change FROM per GROUP BY participant_id"))
def participant_slopes(spark, sf_dir):
    return A.participant_slopes(labelled(spark, sf_dir))


@register("barrier_crossing", oracle("SELECT participant_id, bool_or(label = 1) AS ever_low, min(CASE WHEN label >= 2 THEN session_number END) AS first_high FROM labelled GROUP BY participant_id"))
def barrier_crossing(spark, sf_dir):
    return A.barrier_crossing(labelled(spark, sf_dir))


@register("trend_classes", oracle("""per AS (SELECT participant_id, cohort_id, session_number, avg(label) AS m FROM labelled GROUP BY ALL), placed AS (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY cohort_id, session_number) AS place FROM per),
fits AS (SELECT participant_id, round(coalesce(regr_slope(m, place), 0.0), 6) AS trend FROM placed GROUP BY ALL)
SELECT participant_id, trend, CASE WHEN trend > 0.1 THEN 'advancing' WHEN trend < -0.1 THEN 'regressing' ELSE 'stable' END AS class FROM fits"""))
def trend_classes(spark, sf_dir):
    return A.trend_classes(labelled(spark, sf_dir))


@register("trajectory_typology", oracle(f"""{MEANS}, fits AS (SELECT participant_id, round(coalesce(regr_slope(m, session_number), 0.0), 6) AS s, round(avg(sd), 6) AS v, round(avg(m), 6) AS l FROM per GROUP BY ALL)
SELECT participant_id, s AS slope, v AS volatility, l AS level, CASE WHEN s >= 0.25 THEN 'climber' WHEN l < 1.5 AND s < 0.1 THEN 'stuck' WHEN v > 1.2 THEN 'oscillator' WHEN l >= 2.5 THEN 'advanced' ELSE 'stable' END AS kind FROM fits"""))
def trajectory_typology(spark, sf_dir):
    return A.typology(labelled(spark, sf_dir))


@register("longitudinal_summary", oracle("""out AS (SELECT session_number, avg(label) AS m, stddev_pop(label) AS sd, count(DISTINCT participant_id) AS participants, avg((label >= 2)::INTEGER::DOUBLE) AS a FROM labelled GROUP BY ALL)
SELECT session_number, round(m, 6) AS mean_label, round(sd, 6) AS sd_label, participants, round(a, 6) AS adaptive, CASE WHEN a >= 0.6 THEN 'high' WHEN a >= 0.35 THEN 'moderate' ELSE 'low' END AS feasibility FROM out"""))
def longitudinal_summary(spark, sf_dir):
    return A.longitudinal_summary(labelled(spark, sf_dir))


@register("monotone_participants", oracle(f"{MEANS}, steps AS (SELECT participant_id, coalesce(m - lag(m) OVER (PARTITION BY participant_id ORDER BY session_number), 0.0) >= 0 AS ok FROM per) SELECT participant_id, bool_and(ok) AS non_decreasing, count(*) AS sessions FROM steps GROUP BY participant_id"))
def monotone_participants(spark, sf_dir):
    return A.monotone(labelled(spark, sf_dir))


@register("transcript_stats", oracle("""SELECT session_id, max(end_ms) - min(start_ms) AS duration_ms, count(*) AS turns, sum((speaker = 'participant')::INTEGER)::BIGINT AS participant_turns, sum((speaker = 'therapist')::INTEGER)::BIGINT AS therapist_turns,
sum(word_count)::BIGINT AS words, sum(CASE WHEN speaker = 'participant' THEN word_count ELSE 0 END)::BIGINT AS participant_words, count(label) AS labelled, round(avg(confidence), 6) AS mean_confidence FROM segments GROUP BY session_id"""))
def transcript_stats(spark, sf_dir):
    return A.transcript_stats(segments(spark, sf_dir))


@register("top_codes_by_stage", oracle("counts AS (SELECT label, unnest(codes) AS code FROM labelled), c AS (SELECT label, code, count(*) AS n FROM counts GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, code)::INTEGER AS rank FROM c) WHERE rank <= 8"))
def top_codes_by_stage(spark, sf_dir):
    return A.top_codes(labelled(spark, sf_dir), "label")


@register("top_codes_by_session_number", oracle("counts AS (SELECT session_number, unnest(codes) AS code FROM labelled), c AS (SELECT session_number, code, count(*) AS n FROM counts GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_number ORDER BY n DESC, code)::INTEGER AS rank FROM c) WHERE rank <= 10"))
def top_codes_by_session_number(spark, sf_dir):
    return A.top_codes(labelled(spark, sf_dir), "session_number", 10)


@register("stage_exemplars", oracle("SELECT * FROM (SELECT label, segment_id, confidence, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, segment_id)::INTEGER AS rank FROM labelled WHERE word_count BETWEEN 5 AND 200) WHERE rank <= 3"))
def stage_exemplars(spark, sf_dir):
    return A.exemplars(labelled(spark, sf_dir), ["label"])


@register("session_stage_exemplars", oracle("SELECT * FROM (SELECT session_id, label, segment_id, confidence, row_number() OVER (PARTITION BY session_id, label ORDER BY confidence DESC, segment_id)::INTEGER AS rank FROM labelled WHERE word_count BETWEEN 5 AND 200) WHERE rank <= 2"))
def session_stage_exemplars(spark, sf_dir):
    return A.exemplars(labelled(spark, sf_dir), ["session_id", "label"], top=2)


@register("word_budget_exemplars", oracle("held AS (SELECT segment_id, confidence, word_count, unnest(list_distinct(codes)) AS code FROM labelled), run AS (SELECT code, segment_id, sum(word_count) OVER (PARTITION BY code ORDER BY confidence DESC, segment_id ROWS UNBOUNDED PRECEDING)::BIGINT AS words FROM held) SELECT * FROM run WHERE words <= 60"))
def word_budget_exemplars(spark, sf_dir):
    return A.word_budget_exemplars(labelled(spark, sf_dir))


@register("move_by_session_number", oracle("c AS (SELECT session_number, move, count(*) AS n FROM segments WHERE move IS NOT NULL GROUP BY ALL) SELECT session_number, move FROM (SELECT *, row_number() OVER (PARTITION BY session_number ORDER BY n DESC, move) AS r FROM c) WHERE r = 1"))
def move_by_session_number(spark, sf_dir):
    return A.dominant_by_number(segments(spark, sf_dir))


@register("balanced_evaluation_set", oracle("SELECT * FROM (SELECT label, segment_id, row_number() OVER (PARTITION BY label ORDER BY md5('42' || segment_id), segment_id)::INTEGER AS rank FROM labelled) WHERE rank <= 5"))
def balanced_evaluation_set(spark, sf_dir):
    return A.balanced_sample(labelled(spark, sf_dir))


@register("participant_folds", oracle("SELECT participant_id, (('0x' || substr(md5('42' || participant_id), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM (SELECT DISTINCT participant_id FROM labelled)"))
def participant_folds(spark, sf_dir):
    return A.participant_folds(labelled(spark, sf_dir))


@register("class_weights", oracle("c AS (SELECT label, count(*) AS n FROM labelled GROUP BY ALL), w AS (SELECT label, n, sum(n) OVER () / (count(*) OVER () * n) AS w FROM c) SELECT label, n, round(w / avg(w) OVER (), 6) AS weight FROM w"))
def class_weights(spark, sf_dir):
    return A.class_weights(labelled(spark, sf_dir))


@register("ballot_coverage", oracle("SELECT count(*) AS n, round(avg((len(list_filter(ballots, lambda b: b IS NOT NULL)) + len(list_filter(abstains, lambda a: a)) >= 2)::INTEGER::DOUBLE), 6) AS coverage FROM segments WHERE speaker = 'participant'"))
def ballot_coverage(spark, sf_dir):
    return A.ballot_coverage(segments(spark, sf_dir))


@register("into_avoidance_share", oracle("p AS (SELECT *, lag(label) OVER (PARTITION BY participant_id, session_id ORDER BY segment_index) AS before FROM labelled) SELECT cohort_id, count(*) AS n, round(avg((label = 1 AND before <> 1)::INTEGER::DOUBLE), 6) AS share FROM p WHERE before IS NOT NULL GROUP BY cohort_id"))
def into_avoidance_share(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("participant_id", "session_id").orderBy("segment_index")
    rows = labelled(spark, sf_dir).withColumn("before", F.lag("label").over(w)).where("before is not null")
    return rows.groupBy("cohort_id").agg(F.count("*").alias("n"), F.round(F.avg(((F.col("label") == 1) & (F.col("before") != 1)).cast("double")), 6).alias("share"))
