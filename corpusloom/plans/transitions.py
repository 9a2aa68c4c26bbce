"""Registered queries on label sequences and cue blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import transitions as T
from corpusloom.sources.corpus import MOVES, STAGES, labelled, oracle, segments

PAIRS = "pairs AS (SELECT *, lead(label) OVER w AS next_label, lead(segment_id) OVER w AS next_id FROM labelled WINDOW w AS (PARTITION BY participant_id, session_id ORDER BY segment_index))"
MODAL = """
tally AS (SELECT participant_id, session_id, cohort_id, session_number, label, count(*) AS c FROM labelled GROUP BY ALL),
modal AS (SELECT participant_id, session_id, cohort_id, session_number, label AS stage FROM (SELECT *, row_number() OVER (PARTITION BY participant_id, session_id ORDER BY c DESC, label) AS r FROM tally) WHERE r = 1),
steps AS (SELECT *, lead(stage) OVER w AS next_stage, lead(session_number) OVER w AS next_number, lead(session_id) OVER w AS next_session FROM modal WINDOW w AS (PARTITION BY participant_id ORDER BY cohort_id, session_number, session_id))
"""
BLOCKS = """
who AS (SELECT *, lead(segment_id) OVER w AS to_id, lead(label) OVER w AS to_stage, lead(start_ms) OVER w AS to_start, lead(segment_index) OVER w AS to_index FROM labelled WINDOW w AS (PARTITION BY session_id ORDER BY start_ms, segment_index)),
joined AS (
  SELECT w.session_id, w.participant_id, w.segment_id AS from_id, w.to_id, w.label AS from_stage, w.to_stage, t.segment_id AS turn_id, t.move, t.segment_index AS turn_index
  FROM who w LEFT JOIN (SELECT * FROM segments WHERE speaker = 'therapist') t ON t.session_id = w.session_id AND t.start_ms < w.to_start AND t.end_ms > w.end_ms
  WHERE w.to_id IS NOT NULL
),
blocks AS (SELECT session_id, participant_id, from_id, to_id, from_stage, to_stage, count(turn_id) AS n_turns, count(turn_id) = 0 AS is_empty FROM joined GROUP BY ALL),
moved AS (SELECT from_id, move, count(*) AS c, min(turn_index) AS place FROM joined WHERE move IS NOT NULL GROUP BY ALL),
chosen AS (SELECT b.*, m.move FROM blocks b LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY c DESC, place) AS r FROM moved) WHERE r = 1) m USING (from_id))
"""


@register("transition_matrix", oracle(f"""{PAIRS},
grid AS (SELECT a.i::INTEGER AS from_stage, b.i::INTEGER AS to_stage FROM range(5) a(i), range(5) b(i)),
counts AS (SELECT label AS from_stage, next_label AS to_stage, count(*) AS n FROM pairs WHERE next_label IS NOT NULL GROUP BY ALL),
filled AS (SELECT from_stage, to_stage, coalesce(n, 0) AS n FROM grid LEFT JOIN counts USING (from_stage, to_stage))
SELECT from_stage, to_stage, n, round(CASE WHEN sum(n) OVER (PARTITION BY from_stage) > 0 THEN n / sum(n) OVER (PARTITION BY from_stage) ELSE 0.0 END, 6) AS share FROM filled"""))
def transition_matrix(spark, sf_dir):
    return T.transition_matrix(labelled(spark, sf_dir), STAGES)


@register("session_stage_progression", oracle(f"""{PAIRS},
tally AS (SELECT participant_id, session_id, label, count(*) AS c, min(segment_index) AS place FROM labelled GROUP BY ALL),
dom AS (SELECT participant_id, session_id, label AS dominant_stage FROM (SELECT *, row_number() OVER (PARTITION BY participant_id, session_id ORDER BY c DESC, place) AS r FROM tally) WHERE r = 1)
SELECT participant_id, session_id, session_number, cohort_id, string_agg(label::VARCHAR, ',' ORDER BY segment_index) AS sequence,
  count(*) FILTER (next_label > label) AS forward, count(*) FILTER (next_label < label) AS backward, count(*) FILTER (next_label = label) AS lateral,
  max(label) AS max_stage, any_value(dominant_stage) AS dominant_stage, count(second_label) AS dual_coded, count(*) AS n_segments
FROM pairs JOIN dom USING (participant_id, session_id) GROUP BY participant_id, session_id, session_number, cohort_id"""))
def session_stage_progression(spark, sf_dir):
    return T.session_progression(labelled(spark, sf_dir))


@register("cross_session_transitions", oracle(f"{MODAL} SELECT stage AS from_stage, next_stage AS to_stage, count(*) AS n FROM steps WHERE next_stage IS NOT NULL GROUP BY ALL"))
def cross_session_transitions(spark, sf_dir):
    return T.cross_session_transitions(labelled(spark, sf_dir))


@register("regression_patterns", oracle(f"{MODAL} SELECT next_number AS session_number, stage AS from_stage, next_stage AS to_stage, count(*) AS n, count(DISTINCT participant_id) AS participants FROM steps WHERE next_stage < stage GROUP BY ALL"))
def regression_patterns(spark, sf_dir):
    return T.regressions(labelled(spark, sf_dir))


@register("participant_stage_dominant", oracle(f"{MODAL} SELECT participant_id, session_id, stage AS dominant_stage FROM modal"))
def participant_stage_dominant(spark, sf_dir):
    return T.modal_label(labelled(spark, sf_dir), ["participant_id", "session_id"])


@register("cue_blocks", oracle(f"{BLOCKS} SELECT session_id, participant_id, from_id, to_id, from_stage, to_stage, CASE WHEN to_stage > from_stage THEN 'forward' WHEN to_stage < from_stage THEN 'backward' ELSE 'lateral' END AS direction, n_turns::INTEGER AS n_turns, is_empty, coalesce(move, -1)::INTEGER AS dominant_move FROM chosen"))
def cue_blocks(spark, sf_dir):
    b = T.cue_blocks(segments(spark, sf_dir))
    return b.select("session_id", "participant_id", "from_id", "to_id", "from_stage", "to_stage", "direction", "n_turns", "is_empty", F.coalesce(T.dominant_move(F.col("moves"), MOVES), F.lit(-1)).alias("dominant_move"))


@register("cue_block_influence", oracle(f"{BLOCKS} SELECT from_stage, to_stage, coalesce(move, -1)::INTEGER AS move, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY from_stage, to_stage), 6) AS share FROM chosen GROUP BY from_stage, to_stage, move"))
def cue_block_influence(spark, sf_dir):
    return T.block_influence(T.cue_blocks(segments(spark, sf_dir)), MOVES)


@register("cue_move_lift", oracle(f"{BLOCKS}, counts AS (SELECT move, to_stage, count(*) AS n FROM chosen WHERE move IS NOT NULL GROUP BY ALL) SELECT move, to_stage, n, round((n / sum(n) OVER (PARTITION BY move)) / (sum(n) OVER (PARTITION BY to_stage) / sum(n) OVER ()), 6) AS lift FROM counts"))
def cue_move_lift(spark, sf_dir):
    return T.move_lift(T.cue_blocks(segments(spark, sf_dir)), MOVES)


@register("empty_cue_rate", oracle(f"{BLOCKS} SELECT from_stage, to_stage, count(*) AS blocks, round(avg(is_empty::INTEGER::DOUBLE), 6) AS empty_rate FROM blocks GROUP BY ALL"))
def empty_cue_rate(spark, sf_dir):
    return T.empty_cue_rate(T.cue_blocks(segments(spark, sf_dir)))


@register("delta_by_stage_move", oracle(f"""{BLOCKS} SELECT from_stage, move, count(*) AS n, round(avg((to_stage - from_stage)::DOUBLE), 6) AS mean_delta, round(stddev_pop((to_stage - from_stage)::DOUBLE), 6) AS sd_delta,
  count(*) FILTER (to_stage > from_stage) AS n_forward, count(*) FILTER (to_stage < from_stage) AS n_backward, count(*) FILTER (to_stage = from_stage) AS n_lateral
FROM chosen WHERE move IS NOT NULL GROUP BY from_stage, move HAVING count(*) >= 2"""))
def delta_by_stage_move(spark, sf_dir):
    return T.delta_by_move(T.cue_blocks(segments(spark, sf_dir)), MOVES)


@register("transition_move_profile", oracle(f"{BLOCKS} SELECT from_stage, to_stage, move, count(*) AS n FROM joined WHERE from_stage <> to_stage AND move IS NOT NULL GROUP BY ALL"))
def transition_move_profile(spark, sf_dir):
    return T.transition_move_profile(T.cue_blocks(segments(spark, sf_dir)))


@register("first_transition_examples", oracle(f"{PAIRS} SELECT cohort_id, session_number, label AS from_stage, next_label AS to_stage, arg_min(segment_id, (session_id, participant_id, segment_index)) AS from_id, arg_min(next_id, (session_id, participant_id, segment_index)) AS to_id FROM pairs WHERE next_label IS NOT NULL GROUP BY ALL"))
def first_transition_examples(spark, sf_dir):
    return T.first_examples(labelled(spark, sf_dir))


@register("illustrative_advances", oracle(f"""{MODAL},
best AS (SELECT session_id, participant_id, label, segment_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, participant_id, label ORDER BY confidence DESC, segment_index) AS r FROM labelled) WHERE r = 1)
SELECT s.participant_id, s.next_number AS session_number, s.stage AS from_stage, s.next_stage AS to_stage, b.segment_id AS quote_id
FROM steps s JOIN best b ON b.session_id = s.next_session AND b.participant_id = s.participant_id AND b.label = s.next_stage WHERE s.next_stage > s.stage"""))
def illustrative_advances(spark, sf_dir):
    return T.advances(labelled(spark, sf_dir))


@register("therapist_islands", oracle("""flagged AS (SELECT *, coalesce(lag(speaker) OVER w <> speaker OR start_ms - lag(end_ms) OVER w > 2500, true) AS new FROM segments WINDOW w AS (PARTITION BY session_id ORDER BY segment_index)),
marked AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY session_id ORDER BY segment_index) AS island FROM flagged)
SELECT session_id, island::BIGINT AS island, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS turns, sum(word_count)::BIGINT AS words FROM marked WHERE speaker = 'therapist' GROUP BY session_id, island"""))
def therapist_islands(spark, sf_dir):
    return T.therapist_islands(segments(spark, sf_dir))


@register("speaker_numbers", oracle("firsts AS (SELECT session_id, speaker, min(segment_index) AS first_index FROM segments GROUP BY ALL) SELECT session_id, speaker, first_index, row_number() OVER (PARTITION BY session_id ORDER BY first_index)::INTEGER AS number FROM firsts"))
def speaker_numbers(spark, sf_dir):
    return T.speaker_numbers(segments(spark, sf_dir))


@register("nearest_therapist_turn", oracle("""p AS (SELECT session_id, segment_id, (start_ms + end_ms) / 2 AS mid FROM segments WHERE speaker = 'participant'),
t AS (SELECT session_id, segment_id AS turn_id, (start_ms + end_ms) / 2 AS turn_mid FROM segments WHERE speaker = 'therapist')
SELECT segment_id, turn_id, distance_ms FROM (SELECT p.segment_id, turn_id, abs(mid - turn_mid)::DOUBLE AS distance_ms, row_number() OVER (PARTITION BY p.segment_id ORDER BY abs(mid - turn_mid), turn_mid) AS r FROM p JOIN t USING (session_id)) WHERE r = 1"""))
def nearest_therapist_turn(spark, sf_dir):
    return T.nearest_turn(segments(spark, sf_dir))
