"""Registered queries on cues and the changes that follow them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import aggregates as A
from corpusloom.operators import consensus as C
from corpusloom.operators import mechanism as M
from corpusloom.operators import transitions as T
from corpusloom.plans.consensus import MIXED
from corpusloom.plans.transitions import BLOCKS
from corpusloom.sources.corpus import MOVES, STAGE_NAMES, STAGES, labelled, oracle, segments

RICH = f"""{BLOCKS}, {MIXED},
texts AS (SELECT from_id, string_agg(t.text, chr(10) ORDER BY turn_index) AS cue_text FROM joined j JOIN segments t ON t.segment_id = j.turn_id GROUP BY from_id),
base AS (SELECT c.*, f.coordinate AS fc, t.coordinate AS tc, f.entropy AS from_entropy, f.confidence AS f_conf, t.confidence AS t_conf, round(t.coordinate - f.coordinate, 4) AS delta, coalesce(x.cue_text, '') AS cue_text
  FROM chosen c JOIN mixed f ON f.segment_id = c.from_id JOIN mixed t ON t.segment_id = c.to_id LEFT JOIN texts x USING (from_id)),
rich AS (SELECT *, CASE WHEN delta > 0.15 THEN 'advanced' WHEN delta < -0.15 THEN 'regressed' ELSE 'stayed' END AS response FROM base)
"""
TIER = "CASE WHEN {c} > 0.8 THEN 0 WHEN {c} > 0.6 THEN 1 ELSE 2 END"


def _rich(spark, sf_dir):
    return M.enriched(T.cue_blocks(segments(spark, sf_dir)), C.superposition(labelled(spark, sf_dir), STAGES), MOVES)


@register("enriched_blocks", oracle(f"{RICH} SELECT from_id, to_id, move::INTEGER AS move, fc AS from_coordinate, tc AS to_coordinate, delta, response FROM rich"))
def enriched_blocks(spark, sf_dir):
    return _rich(spark, sf_dir).select("from_id", "to_id", "move", "from_coordinate", "to_coordinate", "delta", "response")


@register("entropy_leverage", oracle(f"{RICH} SELECT CASE WHEN from_entropy < 0.33 THEN 'low' WHEN from_entropy < 0.66 THEN 'mid' ELSE 'high' END AS entropy, count(*) AS n, round(avg(abs(delta)), 6) AS mean_change FROM rich GROUP BY 1"))
def entropy_leverage(spark, sf_dir):
    return M.leverage(_rich(spark, sf_dir))


@register("moves_into_avoidance", oracle(f"{RICH} SELECT move::INTEGER AS move, count(*) AS n, round(avg(delta), 6) AS mean_delta FROM rich WHERE to_stage = 1 AND from_stage <> 1 AND move IS NOT NULL GROUP BY move HAVING count(*) >= 2"))
def moves_into_avoidance(spark, sf_dir):
    return M.into_stage(_rich(spark, sf_dir))


@register("moves_out_of_avoidance", oracle(f"{RICH} SELECT move::INTEGER AS move, count(*) AS n, count(*) FILTER (to_stage > 1) AS up, count(*) FILTER (to_stage < 1) AS down, count(*) FILTER (to_stage = 1) AS stays, round(avg(delta), 6) AS mean_delta FROM rich WHERE from_stage = 1 AND move IS NOT NULL GROUP BY move"))
def moves_out_of_avoidance(spark, sf_dir):
    return M.out_of_stage(_rich(spark, sf_dir))


@register("response_by_stage_move", oracle(f"""{RICH} SELECT from_stage, move::INTEGER AS move, count(*) AS n, round(avg(delta), 6) AS mean_delta, round(stddev_pop(delta), 6) AS sd_delta, count(*) FILTER (response = 'advanced') AS advanced, count(*) FILTER (response = 'regressed') AS regressed,
count(*) FILTER (response = 'stayed') AS stayed, round(avg(from_entropy), 6) AS mean_entropy FROM rich WHERE move IS NOT NULL GROUP BY from_stage, move HAVING count(*) >= 2"""))
def response_by_stage_move(spark, sf_dir):
    return M.response_table(_rich(spark, sf_dir))


@register("training_examples", oracle(f"""{RICH}, folds AS (SELECT DISTINCT participant_id, (('0x' || substr(md5('42' || participant_id), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM labelled)
SELECT from_id, to_id, participant_id, from_stage, to_stage, move::INTEGER AS move, delta, response, ['high', 'medium', 'low'][greatest({TIER.format(c='f_conf')}, {TIER.format(c='t_conf')}) + 1] AS tier, fold, sha256(cue_text) AS cue_sha, cue_text FROM rich LEFT JOIN folds USING (participant_id) WHERE NOT is_empty"""))
def training_examples(spark, sf_dir):
    return M.examples(_rich(spark, sf_dir), A.participant_folds(labelled(spark, sf_dir)), A.tier)


@register("cue_pool", oracle(f"""{RICH}, by_move AS (SELECT sha256(cue_text) AS cue_sha, move::INTEGER AS move, count(*) AS c, count(*) FILTER (response = 'advanced') AS up FROM rich WHERE NOT is_empty GROUP BY ALL)
SELECT cue_sha, sum(c)::BIGINT AS uses, arg_min(move, (-c, move)) FILTER (move IS NOT NULL) AS move, round(sum(up) / sum(c), 6) AS advanced FROM by_move GROUP BY cue_sha"""))
def cue_pool(spark, sf_dir):
    return M.cue_pool(_rich(spark, sf_dir))


NAMES = "[" + ", ".join(f"'{n}'" for n in STAGE_NAMES) + "]"


@register("tuning_view", oracle(f"{RICH} SELECT from_id, 'Respond to a speaker in ' || {NAMES}[from_stage + 1] || ' so that ' || {NAMES}[to_stage + 1] || ' can follow.' AS instruction, cue_text AS output FROM rich WHERE response = 'advanced' AND NOT is_empty"))
def tuning_view(spark, sf_dir):
    return M.tuning_view(_rich(spark, sf_dir), STAGE_NAMES)


@register("session_moves_by_transition", oracle("""p AS (SELECT session_id, session_number, segment_id, label AS from_stage, end_ms, lead(label) OVER o AS to_stage, lead(start_ms) OVER o AS s FROM labelled WINDOW o AS (PARTITION BY session_id ORDER BY start_ms, segment_index)),
j AS (SELECT p.segment_id, t.move, count(*) AS c FROM p JOIN segments t ON t.session_id = p.session_id AND t.move IS NOT NULL AND t.start_ms < p.s AND t.end_ms > p.end_ms WHERE p.s > p.end_ms GROUP BY ALL),
b AS (SELECT segment_id, arg_min(move, (-c, move)) AS move FROM j GROUP BY ALL) SELECT session_number, from_stage, to_stage, move, count(*) AS n FROM p JOIN b USING (segment_id) GROUP BY ALL"""))
def session_moves_by_transition(spark, sf_dir):
    return M.session_moves(segments(spark, sf_dir))


SLOPES = """per AS (SELECT participant_id, session_number, avg(label) AS m FROM labelled GROUP BY ALL),
slopes AS (SELECT participant_id, CASE WHEN count(*) > 1 THEN round(regr_slope(m, session_number), 6) END AS slope, round(arg_max(m, session_number), 6) AS endpoint, round(arg_max(m, session_number) - arg_min(m, session_number), 6) AS change FROM per GROUP BY ALL)"""


@register("external_outcome_links", oracle(f"""{SLOPES}, o AS (SELECT participant_id, avg(word_count) AS words, avg(confidence) AS sureness FROM segments GROUP BY ALL),
c AS (SELECT unnest([{{'p': 'slope', 'x': slope}}, {{'p': 'change', 'x': change}}, {{'p': 'endpoint', 'x': endpoint}}]) AS a, words, sureness FROM slopes JOIN o USING (participant_id)),
d AS (SELECT a.p AS progress, 'words' AS measure, a.x AS x, words AS y FROM c UNION ALL SELECT a.p, 'sureness', a.x, sureness FROM c)
SELECT progress, measure, count(*) AS n, round(corr(x, y), 6) AS r FROM d WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL HAVING count(*) >= 3"""))
def external_outcome_links(spark, sf_dir):
    o = segments(spark, sf_dir).groupBy("participant_id").agg(F.avg("word_count").alias("words"), F.avg("confidence").alias("sureness"))
    return M.external_links(A.participant_slopes(labelled(spark, sf_dir)), o, ["words", "sureness"])


@register("arm_verdict", oracle("""arms AS (SELECT cohort_id, round(regr_slope(label, session_number), 6) AS slope FROM labelled GROUP BY ALL), a AS (SELECT count(*) AS arms, count(*) FILTER (slope > 0) AS up, count(*) FILTER (slope < 0) AS down, min(slope) AS lowest, max(slope) AS highest FROM arms WHERE slope IS NOT NULL)
SELECT arms, up, lowest, highest, CASE WHEN arms >= 2 AND (up = arms OR down = arms) THEN 'STABLE' ELSE 'MIXED' END AS verdict FROM a"""))
def arm_verdict(spark, sf_dir):
    return M.arm_verdict(labelled(spark, sf_dir).groupBy("cohort_id").agg(F.round(F.regr_slope("label", "session_number"), 6).alias("slope")))


@register("cell_triangulation", oracle(f"""{RICH}, a AS (SELECT from_stage, move, avg(delta) AS x FROM rich WHERE move IS NOT NULL AND participant_id < 'p2' GROUP BY ALL), b AS (SELECT from_stage, move, avg(delta) AS y FROM rich WHERE move IS NOT NULL AND participant_id >= 'p2' GROUP BY ALL),
j AS (SELECT round(x, 6) AS x, round(y, 6) AS y FROM a JOIN b USING (from_stage, move)), r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM j)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho, round(avg((sign(x) = sign(y))::INTEGER::DOUBLE), 6) AS same_sign FROM r"""))
def cell_triangulation(spark, sf_dir):
    """Agreement of the mean changes by label and move between two halves of the participants."""
    r = _rich(spark, sf_dir).where("move is not null")
    part = lambda c, n: r.where(c).groupBy("from_stage", "move").agg(F.round(F.avg("delta"), 6).alias(n))
    return M.spearman(part("participant_id < 'p2'", "x").join(part("participant_id >= 'p2'", "y"), ["from_stage", "move"]), "x", "y")


@register("language_atlas", oracle(f"""{RICH}, r AS (SELECT move::INTEGER AS move, from_id, delta, row_number() OVER (PARTITION BY move ORDER BY delta DESC, from_id) AS u, row_number() OVER (PARTITION BY move ORDER BY delta, from_id) AS d FROM rich WHERE move IS NOT NULL)
SELECT move, 'up' AS side, u::INTEGER AS rank, from_id, delta FROM r WHERE u <= 3 AND delta > 0 UNION ALL SELECT move, 'down', d::INTEGER, from_id, delta FROM r WHERE d <= 3 AND delta < 0"""))
def language_atlas(spark, sf_dir):
    return M.top_blocks(_rich(spark, sf_dir), "move")
