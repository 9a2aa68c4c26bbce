"""Registered queries on exports, caches, raters and renamed keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import scoring as S
from corpusloom.operators import transitions as T
from corpusloom.plans.transitions import BLOCKS
from corpusloom.sources import frameworks as W
from corpusloom.sources import master as M
from corpusloom.sources import store as B
from corpusloom.sources.corpus import STAGE_NAMES, labelled, oracle, segments

NAMES = "[" + ", ".join(f"'{n}'" for n in STAGE_NAMES) + "]"


@register("single_label_export", oracle(f"SELECT segment_id, text, label, {NAMES}[label + 1] AS label_name FROM labelled"))
def single_label_export(spark, sf_dir):
    return M.single_label_export(labelled(spark, sf_dir), STAGE_NAMES)


@register("multi_label_export", oracle("a AS (SELECT list_sort(list_distinct(flatten(list(codes)))) AS names FROM segments) SELECT segment_id, text, list_sort(list_transform(list_distinct(codes), lambda c: (list_position(names, c) - 1)::INTEGER)) AS labels FROM segments, a"))
def multi_label_export(spark, sf_dir):
    return M.multi_label_export(segments(spark, sf_dir))


@register("uncached_texts", oracle("SELECT segment_id, sha256(text) AS sha FROM segments WHERE segment_index % 2 = 0 OR segment_index % 5 = 0"))
def uncached_texts(spark, sf_dir):
    """Texts to encode when odd turns are cached, every fifth of them for an older text."""
    s = segments(spark, sf_dir)
    cache = s.where("segment_index % 2 = 1").select("segment_id", F.when(F.col("segment_index") % 5 == 0, F.lit("old")).otherwise(F.sha2("text", 256)).alias("sha"))
    return M.missing_texts(s.select("segment_id", "text"), cache).select("segment_id", "sha")


@register("worksheet_signatures", oracle("SELECT session_number AS worksheet_n, substr(sha256(string_agg(session_number || ':' || segment_id || ':' || sha256(text), '|' ORDER BY segment_id)), 1, 16) AS signature, count(*) AS n_items FROM segments GROUP BY session_number"))
def worksheet_signatures(spark, sf_dir):
    return W.content_signature(segments(spark, sf_dir).select(F.col("session_number").alias("worksheet_n"), F.col("segment_id").alias("item"), "text"))


@register("unjudged_segments", oracle("SELECT segment_id FROM segments WHERE NOT (speaker = 'participant' AND label IS NOT NULL)"))
def unjudged_segments(spark, sf_dir):
    return S.unjudged(segments(spark, sf_dir), labelled(spark, sf_dir)).select("segment_id")


def _rater(shift: int):
    def rate(text: str):
        n = len(text) + shift
        if n % 11 == 0:
            raise ValueError("no answer")
        return ("ABSTAIN", None, None, None, "") if n % 7 == 0 else ("CODED", n // 3 % 5, n % 10 / 10, n // 4 % 5, f"rater {shift}")

    return rate


RATED = """b AS (SELECT segment_id, r::INTEGER AS rater, length(text) + r AS n FROM segments, (SELECT unnest([0, 1, 2]) AS r)),
c AS (SELECT segment_id, rater, CASE WHEN n % 11 = 0 THEN 'ERROR' WHEN n % 7 = 0 THEN 'ABSTAIN' ELSE 'CODED' END AS kind, (n // 3 % 5)::INTEGER AS stage, (n % 10) / 10.0::DOUBLE AS confidence, (n // 4 % 5)::INTEGER AS second FROM b),
v AS (SELECT segment_id, CASE WHEN kind = 'CODED' THEN stage ELSE -1 END AS v, count(*) AS c, avg(confidence) FILTER (kind = 'CODED') AS conf, min(rater) FILTER (kind = 'CODED') AS why FROM c WHERE kind <> 'ERROR' GROUP BY ALL),
w AS (SELECT segment_id, arg_min(v, (-c, v)) AS v, max(c) AS c, arg_min({'x': conf}, (-c, v)) AS conf, arg_min({'x': why}, (-c, v)) AS why FROM v GROUP BY ALL),
won AS (SELECT s.segment_id, CASE WHEN c * 2 > 3 THEN v END AS winner, coalesce(c, 0) AS n_agree, CASE WHEN c IS NULL THEN 'none' WHEN c * 2 <= 3 THEN 'split' WHEN c = 3 THEN 'unanimous' ELSE 'majority' END AS level, CASE WHEN c * 2 > 3 THEN round(conf.x, 4) END AS confidence, CASE WHEN c * 2 > 3 THEN 'rater ' || why.x END AS justification FROM segments s LEFT JOIN w USING (segment_id))"""


def _cast(spark, sf_dir):
    return S.ballots(segments(spark, sf_dir), [_rater(i) for i in range(3)])


@register("plugin_rater_votes", oracle(f"{RATED} SELECT * FROM won"))
def plugin_rater_votes(spark, sf_dir):
    """Merged ballots of three injected raters that now and then abstain or fail."""
    return S.merged_votes(_cast(spark, sf_dir), 3)


@register("secondary_evidence", oracle(f"""{RATED}, k AS (SELECT c.*, winner FROM c JOIN won USING (segment_id) WHERE kind = 'CODED'),
e AS (SELECT segment_id, stage AS st, confidence * 0.6 AS e FROM k WHERE stage <> winner UNION ALL SELECT segment_id, second, confidence * 0.6 FROM k WHERE second <> winner), g AS (SELECT segment_id, st, round(sum(e), 6) AS e FROM e GROUP BY ALL HAVING round(sum(e), 6) >= 0.5)
SELECT segment_id, arg_min(st, (-e, st)) AS secondary, max(e) AS evidence FROM g GROUP BY segment_id"""))
def secondary_evidence(spark, sf_dir):
    c = _cast(spark, sf_dir)
    return S.secondary_evidence(c, S.merged_votes(c, 3))


@register("rater_code_votes", oracle("h AS (SELECT segment_id, i AS rater, codes[i + 1] AS code, confidence FROM segments, (SELECT unnest([0, 1, 2]) AS i)) SELECT segment_id, code, count(DISTINCT rater) AS votes, round(avg(confidence), 4) AS confidence FROM h GROUP BY ALL HAVING count(DISTINCT rater) * 2 > 3"))
def rater_code_votes(spark, sf_dir):
    held = segments(spark, sf_dir).select("segment_id", "confidence", F.posexplode("codes").alias("rater", "code"))
    return S.code_votes(held, 3)


@register("cue_units", oracle(f"{BLOCKS}, t AS (SELECT from_id, to_id, string_agg(s.text, chr(10) ORDER BY turn_index) AS x FROM joined JOIN segments s ON s.segment_id = turn_id GROUP BY ALL), n AS (SELECT from_id, to_id, len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> ''))::INTEGER AS words FROM t) SELECT from_id, to_id, words, words > 60 AS lesson, ceil(words / 25)::INTEGER AS parts FROM n"))
def cue_units(spark, sf_dir):
    return S.cue_units(T.cue_blocks(segments(spark, sf_dir)), 25, 60)


@register("exchange_context", oracle("""n AS (SELECT *, speaker || ': ' || text AS line, lag(speaker || ': ' || text) OVER o AS b, lead(speaker || ': ' || text) OVER o AS a FROM segments WINDOW o AS (PARTITION BY session_id ORDER BY segment_index))
SELECT segment_id, concat_ws(chr(10), b, '>> ' || line, a) AS exchange FROM n WHERE speaker = 'therapist'"""))
def exchange_context(spark, sf_dir):
    return S.exchange(segments(spark, sf_dir))


@register("renamed_segment_ids", oracle("SELECT segment_id AS old_id, 'd1_' || substr(segment_id, 4) AS new_id FROM segments WHERE starts_with(segment_id, 'c1_')"))
def renamed_segment_ids(spark, sf_dir):
    return M.new_segment_ids(segments(spark, sf_dir), "c1", "d1")


@register("name_scrubbing")
def name_scrubbing(spark, sf_dir):
    """Known names masked, and what greeting and address rules take for names."""
    from corpusloom.functions.scrub import scrub_segments

    return scrub_segments(segments(spark, sf_dir).select("segment_id", "text"), ["Ander Thon", "Ontier"])


@register("quote_grounding")
def quote_grounding(spark, sf_dir):
    """Whether a turn's own first words and a made-up phrase are grounded in it."""
    from corpusloom.functions.scrub import grounded_share

    s = segments(spark, sf_dir)
    quotes = F.array(F.substring("text", 1, 24), F.lit("nobody has ever said this here"))
    return s.select("segment_id", F.round(grounded_share(quotes, F.col("text")), 6).alias("grounded"))


@register("overlaid_segments", oracle("SELECT segment_id, speaker, CASE WHEN segment_index % 3 = 0 AND label IS NOT NULL THEN label END AS theme, CASE WHEN segment_index % 2 = 0 AND move IS NOT NULL THEN move END AS purer FROM segments"))
def overlaid_segments(spark, sf_dir):
    """Segments with two overlays that cover some of them, one of which has a row too many."""
    s = segments(spark, sf_dir)
    theme = s.where("segment_index % 3 = 0 and label is not null").select("segment_id", F.col("label").alias("theme"))
    orphan = spark.createDataFrame([("no such segment", 1)], "segment_id string, theme int")
    move = s.where("segment_index % 2 = 0 and move is not null").select("segment_id", F.col("move").alias("purer"))
    return B.apply_overlays(s.select("segment_id", "speaker"), theme.unionByName(orphan), move)


@register("replaced_turns", oracle("""rest AS (SELECT session_id, segment_id, speaker, segment_index FROM segments WHERE speaker <> 'therapist'), l AS (SELECT session_id, max(segment_index) AS last FROM rest GROUP BY ALL),
n AS (SELECT session_id, segment_id || '_r' AS segment_id, speaker, start_ms FROM segments WHERE speaker = 'therapist' AND segment_index % 3 <> 1)
SELECT * FROM rest UNION ALL SELECT n.session_id, n.segment_id, n.speaker, (coalesce(last, -1) + row_number() OVER (PARTITION BY n.session_id ORDER BY start_ms))::INTEGER FROM n LEFT JOIN l USING (session_id)"""))
def replaced_turns(spark, sf_dir):
    """The therapist's turns replaced by two thirds of them under new ids, numbered on from the rest."""
    s = segments(spark, sf_dir).select("session_id", "segment_id", "speaker", "segment_index", "start_ms")
    new = s.where("speaker = 'therapist' and segment_index % 3 <> 1").withColumn("segment_id", F.concat("segment_id", F.lit("_r"))).drop("segment_index")
    return B.replace_turns(s, new).select("session_id", "segment_id", "speaker", "segment_index")
