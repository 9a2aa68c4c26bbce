"""Registered queries on worksheets, pools and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.functions import labels as L
from corpusloom.operators import consensus as C
from corpusloom.operators import refine as R
from corpusloom.operators import testsets as W
from corpusloom.plans.consensus import CAST
from corpusloom.plans.segmentation import PLACES, ROUNDED, VECTOR
from corpusloom.sources.corpus import STAGES, oracle, segments

SLICE = """pool AS (SELECT * FROM segments WHERE speaker <> 'therapist'), o AS (SELECT *, row_number() OVER (PARTITION BY session_number ORDER BY md5('42' || segment_id), segment_id) - 1 AS p, greatest(1, floor(count(*) OVER (PARTITION BY session_number) * 0.1 + 0.5)) AS s FROM pool),
{name} AS (SELECT * EXCLUDE (p, s) FROM o WHERE p >= s * {k} AND p < s * ({k} + 1))"""


def _sheet(spark, sf_dir, k):
    return W.slice_of(W.pool(segments(spark, sf_dir), "labels"), "session_number", 0.1, k)


@register("worksheet_slice", oracle(f"{SLICE.format(name='x', k=1)} SELECT session_number, segment_id FROM x"))
def worksheet_slice(spark, sf_dir):
    return _sheet(spark, sf_dir, 1).select("session_number", "segment_id")


@register("unused_pool", oracle(f"{SLICE.format(name='x', k=0)} SELECT segment_id FROM segments WHERE speaker = 'participant' AND len(codes) > 0 AND segment_id NOT IN (SELECT segment_id FROM x)"))
def unused_pool(spark, sf_dir):
    rows = W.pool(segments(spark, sf_dir), "codes").where("speaker = 'participant'")
    return W.without(rows, _sheet(spark, sf_dir, 0)).select("segment_id")


ITEMS = f"{SLICE.format(name='x', k=0)}, items AS (SELECT 1 AS worksheet_n, row_number() OVER (ORDER BY md5('42:1:' || segment_id), segment_id)::INTEGER AS item_num, session_id, segment_index + 1 AS seg_num, sha256(text) AS sha, segment_id, segment_index FROM x)"


@register("worksheet_resolution", oracle(f"{ITEMS} SELECT worksheet_n, item_num, CASE WHEN segment_index % 5 <> 0 THEN segment_id END AS segment_id, CASE WHEN segment_index % 5 = 0 THEN 'unresolved' WHEN segment_index % 2 = 0 THEN 'drift' ELSE 'ok' END AS state FROM items"))
def worksheet_resolution(spark, sf_dir):
    """A worksheet held against segments of which some are gone and some have changed."""
    s = segments(spark, sf_dir)
    now = s.where("segment_index % 5 <> 0").withColumn("text", F.when(F.col("segment_index") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return W.resolved(W.worksheet(_sheet(spark, sf_dir, 0), 1), now)


@register("worksheet_items", oracle(f"{ITEMS} SELECT worksheet_n, count(*) AS n_items, list(session_id || ':' || seg_num ORDER BY item_num) AS items FROM items GROUP BY worksheet_n"))
def worksheet_items(spark, sf_dir):
    return W.nested_items(W.worksheet(_sheet(spark, sf_dir, 0), 1))


@register("sheet_agreement", oracle(f"""{CAST}, v AS (SELECT p.session_number AS worksheet_n, b.segment_id AS item, v AS label, count(*) AS c FROM ballots b JOIN people p USING (segment_id) WHERE v IS NOT NULL GROUP BY ALL),
u AS (SELECT worksheet_n, item, sum(c) AS n, sum(c * (c - 1)) AS same FROM v GROUP BY ALL HAVING sum(c) > 1), s AS (SELECT worksheet_n, count(*) AS units, sum(n) AS total, sum(same / (n - 1)) AS same, avg(same / (n * (n - 1))) AS pairwise FROM u GROUP BY ALL),
m AS (SELECT worksheet_n, sum(m * (m - 1)) AS chance FROM (SELECT worksheet_n, label, sum(c) AS m FROM v JOIN u USING (worksheet_n, item) GROUP BY ALL) GROUP BY ALL)
SELECT worksheet_n, units, round(pairwise, 6) AS pairwise, round(1 - (1 - same / total) / (1 - chance / (total * (total - 1))), 6) AS alpha FROM s JOIN m USING (worksheet_n)"""))
def sheet_agreement(spark, sf_dir):
    people = segments(spark, sf_dir).where("speaker = 'participant'")
    votes = C.rater_labels(people).join(people.select("segment_id", F.col("session_number").alias("worksheet_n")), "segment_id").select("worksheet_n", F.col("segment_id").alias("item"), "label")
    return W.agreement_by_sheet(votes)


@register("rater_vote_maps", oracle(f"{CAST}, b AS (SELECT segment_id AS item, rater, v FROM ballots WHERE v IS NOT NULL) SELECT 1 AS worksheet_n, item, string_agg(rater || '=' || v, ',' ORDER BY rater) AS votes FROM b GROUP BY item"))
def rater_vote_maps(spark, sf_dir):
    votes = C.rater_labels(segments(spark, sf_dir).where("speaker = 'participant'"))
    m = W.grouped_by_rater(votes.select(F.lit(1).alias("worksheet_n"), F.col("segment_id").alias("item"), "rater", "label", F.lit(False).alias("is_consensus")))
    return m.select("worksheet_n", "item", F.array_join(F.transform(F.map_entries("votes"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("votes"))


SPELLED = "CASE segment_index % 6 WHEN 0 THEN ' 3 ' WHEN 1 THEN 'Abstain' WHEN 2 THEN '4.0' WHEN 3 THEN '9' WHEN 4 THEN 'nan' ELSE 'No code' END"


@register("normalized_ballots", oracle(f"SELECT segment_id, CASE segment_index % 6 WHEN 0 THEN 3 WHEN 1 THEN -1 WHEN 2 THEN 4 WHEN 5 THEN -1 END::INTEGER AS vote FROM segments"))
def normalized_ballots(spark, sf_dir):
    return segments(spark, sf_dir).select("segment_id", L.ballot(F.expr(SPELLED), STAGES).alias("vote"))


@register("context_walk", oracle("""n AS (SELECT *, lag(text, 1) OVER o AS t1, lag(word_count, 1) OVER o AS w1, lag(end_ms, 1) OVER o AS e1, lag(start_ms, 1) OVER o AS s1, lag(text, 2) OVER o AS t2, lag(word_count, 2) OVER o AS w2, lag(end_ms, 2) OVER o AS e2 FROM segments WINDOW o AS (PARTITION BY session_id ORDER BY segment_index)),
g AS (SELECT segment_id, speaker, coalesce(start_ms - e1 <= 5000 AND w1 <= 40, false) AS a, coalesce(s1 - e2 <= 5000 AND w1 + w2 <= 40, false) AS b, t1, t2 FROM n)
SELECT segment_id, CASE WHEN a AND b THEN 2 WHEN a THEN 1 ELSE 0 END AS n, CASE WHEN a AND b THEN t2 || chr(10) || t1 WHEN a THEN t1 ELSE '' END AS context FROM g WHERE speaker = 'participant'"""))
def context_walk(spark, sf_dir):
    return R.walk(segments(spark, sf_dir), True, 5000, 40, 2)


@register("context_attachment", oracle(f"""n AS (SELECT segment_id, text, {VECTOR("lower(text)")} AS a, {VECTOR("lower(coalesce(lag(text) OVER (PARTITION BY session_id ORDER BY segment_index), ''))")} AS b, lag(text) OVER (PARTITION BY session_id ORDER BY segment_index) AS ctx, lag(word_count) OVER (PARTITION BY session_id ORDER BY segment_index) AS wc, speaker FROM segments),
p AS (SELECT segment_id, CASE WHEN coalesce(wc <= 30, false) THEN ctx END AS ctx, a, b, list_dot_product(a, a) AS na, list_dot_product(b, b) AS nb FROM n WHERE speaker = 'participant'),
s AS (SELECT segment_id, ctx, CASE WHEN ctx IS NULL OR na = 0 OR nb = 0 THEN 0.0 ELSE {ROUNDED(f'list_sum(list_transform({PLACES}, lambda i: (a[i] / sqrt(na)) * (b[i] / sqrt(nb))))')} END AS similarity FROM p)
SELECT segment_id, similarity, CASE WHEN ctx IS NULL OR similarity < 0.22 THEN 'skip' WHEN similarity >= 0.3 THEN 'attach' ELSE 'ask' END AS verdict FROM s"""))
def context_attachment(spark, sf_dir):
    s = segments(spark, sf_dir)
    return R.attachment(s.where("speaker = 'participant'"), R.walk(s, True, 5000, 30, 1))
