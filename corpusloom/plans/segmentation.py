"""Registered queries on sentences, boundaries and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import segmentation as G
from corpusloom.operators import topics as W
from corpusloom.sources.corpus import oracle, segments



def VECTOR(c: str) -> str:
    """The sketch's signed counts of a text, before its length is taken off."""
    hashes = f"""list_transform([list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')], lambda ws: list_transform(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT))[1]"""
    return f"""list_transform([{hashes}], lambda hs: list_transform(range({G.SKETCH}), lambda k: coalesce(list_sum(list_transform(list_filter(hs, lambda h: h % {G.SKETCH} = k), lambda h: CASE WHEN h // {G.SKETCH} % 2 = 0 THEN 1.0 ELSE -1.0 END)), 0.0)::DOUBLE))[1]"""


def ROUNDED(x: str) -> str:
    """Six places of a value that may be just under zero, without a negative zero."""
    return f"(round(({x}) * 1e6)::BIGINT / 1e6)"


PLACES = f"range(1, {G.SKETCH + 1})"
DOT = f"list_sum(list_transform({PLACES}, lambda k: list_sum(list_transform(l, lambda v: v[k])) * list_sum(list_transform(r, lambda v: v[k])))) / (len(l) * len(r))"
SENTENCES = f"""
cut AS (SELECT session_id, speaker, segment_index, segment_id, start_ms, end_ms, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS parts FROM segments),
flat AS (SELECT session_id, speaker, segment_index, segment_id, start_ms, end_ms, len(parts) AS n, unnest(range(len(parts))) AS i, unnest(parts) AS raw FROM cut),
sents AS (SELECT session_id, speaker, segment_index * 1000 + i AS place, trim(raw) AS text, start_ms / 1000.0::DOUBLE + i * ((end_ms - start_ms)::DOUBLE / n / 1000) AS "start", start_ms / 1000.0::DOUBLE + (i + 1) * ((end_ms - start_ms)::DOUBLE / n / 1000) AS "end",
  len(string_split_regex(trim(raw), '\\s+'))::INTEGER AS words, {VECTOR("lower(trim(raw))")} AS raw_vector FROM flat),
vecs AS (SELECT *, sqrt(list_dot_product(raw_vector, raw_vector)) AS norm FROM sents),
sentences AS (SELECT * EXCLUDE (raw_vector, norm), list_transform(raw_vector, lambda x: CASE WHEN norm > 0 THEN x / norm ELSE 0.0 END) AS vector FROM vecs)
"""
CURVES = f"""{SENTENCES},
sides AS (SELECT *, lead(speaker) OVER o AS next_speaker, greatest(0.0, lead("start") OVER o - "end") * 1000 AS pause,
  list(vector) OVER (PARTITION BY session_id ORDER BY place ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l, coalesce(list(vector) OVER (PARTITION BY session_id ORDER BY place ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), []) AS r
  FROM sentences WINDOW o AS (PARTITION BY session_id ORDER BY place)),
curve AS (SELECT session_id, speaker, place, text, words, "start", "end", next_speaker, CASE WHEN len(r) > 0 THEN round(pause, 3) END AS pause_ms,
  CASE WHEN len(r) > 0 THEN {ROUNDED(DOT)} END AS similarity FROM sides),
marked AS (SELECT c.*, coalesce(next_speaker <> speaker OR pause_ms > 30000, false) AS forced, coalesce(pause_ms > 2000 OR similarity < lim, false) AS soft FROM curve c JOIN (SELECT session_id, quantile_cont(similarity, 0.25) AS lim FROM curve GROUP BY session_id) USING (session_id))
"""
NUMBERED = f"""{CURVES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY place) AS rn FROM marked),
walk AS (
  SELECT session_id, rn, place, 0::BIGINT AS segment, CASE WHEN forced OR (soft AND words >= 12) THEN 1 ELSE 0 END::BIGINT AS next_segment, CASE WHEN forced OR (soft AND words >= 12) THEN 0 ELSE words END::BIGINT AS since FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.session_id, r.rn, r.place, w.next_segment, CASE WHEN r.forced OR (r.soft AND w.since + r.words >= 12) THEN w.next_segment + 1 ELSE w.next_segment END, CASE WHEN r.forced OR (r.soft AND w.since + r.words >= 12) THEN 0 ELSE w.since + r.words END
  FROM walk w JOIN ranked r ON r.session_id = w.session_id AND r.rn = w.rn + 1
)
"""
RECURSIVE = lambda body: oracle(body).replace("WITH", "WITH RECURSIVE", 1)


def _sentences(spark, sf_dir):
    return G.sentences(segments(spark, sf_dir))


def _marked(spark, sf_dir):
    return G.candidates(G.curves(_sentences(spark, sf_dir)))


@register("sentence_curves", oracle(f"{CURVES} SELECT session_id, place, words, pause_ms, similarity FROM curve"))
def sentence_curves(spark, sf_dir):
    return G.curves(_sentences(spark, sf_dir)).select("session_id", "place", "words", "pause_ms", "similarity")


@register("similarity_minima", oracle(f"{CURVES}, n AS (SELECT *, lag(similarity) OVER o AS a, lead(similarity) OVER o AS b FROM curve WINDOW o AS (PARTITION BY session_id ORDER BY place)) SELECT session_id, place, similarity FROM n WHERE similarity < a AND similarity < b"))
def similarity_minima(spark, sf_dir):
    return G.minima(G.curves(_sentences(spark, sf_dir)))


@register("boundary_candidates", oracle(f"{CURVES} SELECT session_id, place, forced, soft FROM marked WHERE forced OR soft"))
def boundary_candidates(spark, sf_dir):
    return _marked(spark, sf_dir).where("forced or soft").select("session_id", "place", "forced", "soft")


@register("boundary_confidence", oracle(f"""{CURVES},
wide AS (SELECT session_id, place, list(vector) OVER (PARTITION BY session_id ORDER BY place ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS l, coalesce(list(vector) OVER (PARTITION BY session_id ORDER BY place ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), []) AS r FROM sentences),
broad AS (SELECT session_id, place, CASE WHEN len(r) > 0 THEN {ROUNDED(DOT)} END AS broad FROM wide)
SELECT m.session_id, m.place, CASE WHEN forced OR coalesce(broad < lim, false) THEN 'confident' ELSE 'ambiguous' END AS confidence FROM marked m JOIN broad USING (session_id, place) JOIN (SELECT session_id, quantile_cont(broad, 0.25) AS lim FROM broad GROUP BY session_id) USING (session_id) WHERE forced OR soft"""))
def boundary_confidence(spark, sf_dir):
    return G.boundary_confidence(G.curves(_sentences(spark, sf_dir)))


@register("sentence_segments", RECURSIVE(f"{NUMBERED} SELECT session_id, place, segment FROM walk"))
def sentence_segments(spark, sf_dir):
    return G.numbered(_marked(spark, sf_dir)).select("session_id", "place", "segment")


@register("segmented_sessions")
def segmented_sessions(spark, sf_dir):
    """All steps from sentences to merged segments."""
    return G.segment_sessions(_sentences(spark, sf_dir)).select("session_id", "first_place", "speaker", "words", "pieces", F.length("text").alias("n_chars"))


@register("folded_sentences", oracle(f"""{SENTENCES},
near AS (SELECT s.session_id, s.place, s.words, t.place AS other, CASE WHEN t.place < s.place THEN s."start" - t."end" ELSE t."start" - s."end" END AS gap, t.speaker = s.speaker AS own,
    row_number() OVER (PARTITION BY s.session_id, s.place, t.speaker = s.speaker, t.place < s.place ORDER BY abs(t.place - s.place)) AS k, row_number() OVER (PARTITION BY s.session_id, s.place, t.place < s.place ORDER BY abs(t.place - s.place)) AS k_any
  FROM sentences s JOIN sentences t ON t.session_id = s.session_id AND t.place <> s.place AND t.words >= 4 WHERE s.words < 4),
pick AS (SELECT session_id, place, coalesce(arg_min(other, (gap, other)) FILTER (own AND k = 1), arg_min(other, (gap, other)) FILTER (k_any = 1)) AS "into" FROM near GROUP BY ALL)
SELECT s.session_id, s.place, coalesce(p."into", s.place) AS "into" FROM sentences s LEFT JOIN pick p USING (session_id, place)"""))
def folded_sentences(spark, sf_dir):
    return G.fold_short(_sentences(spark, sf_dir)).select("session_id", "place", "into")


@register("coherence_verdicts", oracle(f"""parts AS (SELECT segment_id, unnest(range(len(p))) AS i, unnest(p) AS s FROM (SELECT segment_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS p FROM segments)),
v AS (SELECT segment_id, i, {VECTOR("lower(s)")} AS v FROM parts), u AS (SELECT segment_id, i, v, sqrt(list_dot_product(v, v)) AS n FROM v), w AS (SELECT segment_id, i, list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0.0 END) AS v FROM u),
d AS (SELECT segment_id, i, {ROUNDED('list_dot_product(v, lead(v) OVER (PARTITION BY segment_id ORDER BY i))')} AS sim FROM w),
per AS (SELECT segment_id, count(*) AS parts, min(sim) AS lowest, avg(sim) AS mean, arg_min(i, (sim, i)) FILTER (sim IS NOT NULL) AS gap FROM d GROUP BY ALL HAVING count(*) >= 4)
SELECT segment_id, parts, lowest, CASE WHEN lowest < 0.3 THEN 'split' WHEN lowest > round(mean, 6) - 0.1 THEN 'keep' ELSE 'ask' END AS verdict, (gap + 1)::INTEGER AS "at" FROM per"""))
def coherence_verdicts(spark, sf_dir):
    return G.coherence(segments(spark, sf_dir))


@register("split_segments", oracle("""parts AS (SELECT session_id, segment_id, cohort_id, start_ms, end_ms, text, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS p FROM segments),
h AS (SELECT *, len(p) >= 4 AS cut, len(p) // 2 AS k FROM parts)
SELECT session_id, segment_id, array_to_string(p[1:k], ' ') AS text, start_ms, (start_ms + end_ms) // 2 AS end_ms, cohort_id FROM h WHERE cut
UNION ALL SELECT session_id, segment_id || '_split', array_to_string(p[k + 1:], ' '), (start_ms + end_ms) // 2, end_ms, NULL FROM h WHERE cut
UNION ALL SELECT session_id, segment_id, text, start_ms, end_ms, cohort_id FROM h WHERE NOT cut"""))
def split_segments(spark, sf_dir):
    from corpusloom.functions.text import sentence_list

    s = segments(spark, sf_dir)
    cuts = s.withColumn("n", F.size(sentence_list(F.col("text")))).where("n >= 4").select("segment_id", F.floor(F.col("n") / 2).cast("int").alias("at"))
    return G.split_at(s, cuts)


@register("flag_merged_segments", oracle("""f AS (SELECT session_id, start_ms AS at_ms FROM segments WHERE segment_index % 3 = 0),
e AS (SELECT *, lag(end_ms) OVER o AS pe, lag(speaker) OVER o AS ps FROM segments WINDOW o AS (PARTITION BY session_id ORDER BY segment_index)),
h AS (SELECT DISTINCT e.session_id, e.segment_index FROM e JOIN f ON f.session_id = e.session_id AND e.ps = e.speaker AND (abs(f.at_ms - e.start_ms) <= 500 OR abs(f.at_ms - e.pe) <= 500))
SELECT e.segment_id, (sum(CASE WHEN h.segment_index IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY e.session_id ORDER BY e.segment_index))::BIGINT AS "group" FROM e LEFT JOIN h ON h.session_id = e.session_id AND h.segment_index = e.segment_index"""))
def flag_merged_segments(spark, sf_dir):
    s = segments(spark, sf_dir)
    flags = s.where("segment_index % 3 = 0").select("session_id", F.col("start_ms").alias("at_ms"))
    return G.merge_flagged(s, flags, 500).select("segment_id", "group")


@register("speaker_lines", oracle("""n AS (SELECT *, (coalesce(lag(speaker) OVER o <> speaker, true))::INTEGER AS new FROM segments WINDOW o AS (PARTITION BY session_id ORDER BY segment_index)), l AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY segment_index) AS line FROM n)
SELECT session_id, line::BIGINT AS line, speaker || ': ' || string_agg(text, ' ' ORDER BY segment_index) AS text, count(*) AS turns FROM l GROUP BY session_id, line, speaker"""))
def speaker_lines(spark, sf_dir):
    return G.speaker_lines(segments(spark, sf_dir))


@register("context_windows", oracle("""w AS (SELECT session_id, segment_id, segment_index, string_split_regex(text, '\\s+') AS t FROM segments),
b AS (SELECT segment_id, lag(t, 1) OVER o AS a, lag(t, 2) OVER o AS b, lag(t, 3) OVER o AS c FROM w WINDOW o AS (PARTITION BY session_id ORDER BY segment_index)),
k AS (SELECT segment_id, a[1:30] AS a, b[1:greatest(0, 30 - len(coalesce(a, [])))] AS b, c[1:greatest(0, 30 - len(coalesce(a, [])) - len(coalesce(b, [])))] AS c FROM b)
SELECT segment_id, concat_ws(chr(10), nullif(array_to_string(c, ' '), ''), nullif(array_to_string(b, ' '), ''), nullif(array_to_string(a, ' '), '')) AS context FROM k"""))
def context_windows(spark, sf_dir):
    return G.context_before(segments(spark, sf_dir))


@register("boundary_agreement", RECURSIVE("""b AS (SELECT DISTINCT session_id, end_ms AS at_ms, 0 AS side FROM segments UNION ALL SELECT DISTINCT session_id, end_ms + 300, 1 FROM segments WHERE word_count > 20),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_ms, side) AS i FROM b),
w AS (SELECT session_id, i, [{'a': at_ms, 's': side}] AS q, 0 AS hit FROM r WHERE i = 1
  UNION ALL SELECT session_id, i, CASE WHEN k > 0 THEN list_concat(q[:k - 1], q[k + 1:]) ELSE list_append(q, {'a': at_ms, 's': side}) END, CASE WHEN k > 0 THEN 1 ELSE 0 END
  FROM (SELECT *, coalesce(list_position(list_transform(q, lambda x: x.s <> side), true), 0) AS k FROM (SELECT r.session_id, r.i, r.at_ms, r.side, list_filter(w.q, lambda x: r.at_ms - x.a <= 1000) AS q FROM w JOIN r ON r.session_id = w.session_id AND r.i = w.i + 1)))
SELECT session_id, sum(hit)::BIGINT AS matched, round(sum(hit) / (count(*) - sum(hit)), 6) AS jaccard FROM w GROUP BY session_id"""))
def boundary_agreement(spark, sf_dir):
    """Agreement of the turns' ends with the ends of two sentences or more."""
    s = segments(spark, sf_dir)
    return G.boundary_agreement(s.select("session_id", F.col("end_ms").alias("at_ms")), s.where("word_count > 20").select("session_id", (F.col("end_ms") + 300).alias("at_ms")))


@register("projected_segment_labels", oracle("""new AS (SELECT session_id, segment_id || '_n' AS new_id, start_ms + 400 AS s, end_ms + 700 AS e, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS nt FROM segments),
old AS (SELECT session_id, start_ms AS cs, end_ms AS ce, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS ct, label FROM segments),
w AS (SELECT new_id, label, len(list_intersect(nt, ct))::DOUBLE / greatest(len(list_distinct(list_concat(nt, ct))), 1) + (least(e, ce) - greatest(s, cs)) * 1e-6 AS w FROM new n JOIN old o ON o.session_id = n.session_id AND cs < e AND ce > s WHERE label IS NOT NULL),
g AS (SELECT new_id, label, sum(w) AS w FROM w GROUP BY ALL), best AS (SELECT new_id, arg_min(label, (-round(w, 9), label)) AS projected, round(sum(w * label) / sum(w), 6) AS coordinate FROM g GROUP BY new_id)
SELECT new_id, projected, coordinate FROM new LEFT JOIN best USING (new_id)"""))
def projected_segment_labels(spark, sf_dir):
    s = segments(spark, sf_dir)
    new = s.select("session_id", F.concat("segment_id", F.lit("_n")).alias("new_id"), (F.col("start_ms") + 400).alias("start_ms"), (F.col("end_ms") + 700).alias("end_ms"), "text")
    return G.overlap_labels(new, s)


@register("nearest_segments", oracle("""new AS (SELECT session_id, segment_id || '_n' AS new_id, (start_ms + end_ms) / 2 + 2500 AS middle FROM segments WHERE segment_index % 3 = 0), old AS (SELECT session_id, segment_id, (start_ms + end_ms) / 2 AS mid FROM segments WHERE segment_index % 2 = 1)
SELECT new_id, arg_min(segment_id, (abs(mid - middle), mid, segment_id)) FILTER (segment_id IS NOT NULL) AS nearest_id FROM new LEFT JOIN old USING (session_id) GROUP BY new_id"""))
def nearest_segments(spark, sf_dir):
    """Old segment nearest in time to each of a third of the segments, moved by two and a half seconds."""
    s = segments(spark, sf_dir)
    new = s.where("segment_index % 3 = 0").select("session_id", F.concat("segment_id", F.lit("_n")).alias("new_id"), (F.col("start_ms") + 2500).alias("start_ms"), (F.col("end_ms") + 2500).alias("end_ms"))
    return G.nearest_unit(new, s.where("segment_index % 2 = 1"))


@register("topic_boundaries")
def topic_boundaries(spark, sf_dir):
    """Sentences after which the Ward cluster of the session's sentences changes."""
    return W.topic_boundaries(_sentences(spark, sf_dir))


@register("topic_boundary_candidates")
def topic_boundary_candidates(spark, sf_dir):
    """Boundary candidates where changes of topic count as soft ones."""
    rows = _sentences(spark, sf_dir)
    return G.candidates(G.curves(rows), topics=W.topic_boundaries(rows)).where("forced or soft").select("session_id", "place", "forced", "soft")
