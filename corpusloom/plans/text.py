"""Registered queries on texts, identifiers and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.functions import text as X
from corpusloom.operators import grounding as G
from corpusloom.sources.corpus import labelled, oracle, segments, table

STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9'']+'), lambda t: length(t) >= 3 AND t NOT IN (" + STOP + ")))"
NAMES = ("the", "thon", "ander")


@register("document_digests", "SELECT doc_id, sha256(coalesce(text, '')) AS digest, substr(sha256(coalesce(lang, '') || '|' || coalesce(text, '')), 1, 16) AS signature FROM documents")
def document_digests(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    both = F.concat(F.coalesce("lang", F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.substring(F.sha2(both, 256), 1, 16).alias("signature"))


@register("content_token_counts", f"WITH t AS (SELECT item_id, {TOKENS.format(c='text')} AS ts FROM benchmark) SELECT item_id, len(ts)::INTEGER AS n_tokens, array_to_string(list_sort(ts), ' ') AS token_list FROM t")
def content_token_counts(spark, sf_dir):
    t = X.content_tokens(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(t).alias("n_tokens"), F.array_join(F.array_sort(t), " ").alias("token_list"))


@register("adjacent_lexical_overlap", oracle(f"""n AS (SELECT session_id, segment_index, text, lead(text) OVER (PARTITION BY session_id ORDER BY segment_index) AS next_text FROM segments),
t AS (SELECT session_id, segment_index, {TOKENS.format(c='text')} AS a, {TOKENS.format(c='next_text')} AS b FROM n WHERE next_text IS NOT NULL)
SELECT session_id, segment_index, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS overlap FROM t"""))
def adjacent_lexical_overlap(spark, sf_dir):
    from corpusloom.operators.transitions import with_next

    rows = with_next(segments(spark, sf_dir), ["session_id"], ["segment_index"], ["text"]).where("next_text is not null")
    return rows.select("session_id", "segment_index", F.round(X.overlap(X.content_tokens(F.col("text")), X.content_tokens(F.col("next_text"))), 6).alias("overlap"))


@register("normalized_benchmark", r"SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS normal, regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM benchmark")
def normalized_benchmark(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.normalized(F.col("text")).alias("normal"), X.slug(F.col("text")).alias("slug"))


@register("segment_timecodes", oracle("SELECT segment_id, format('{}:{:02d}:{:02d}', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) AS start_hms, format('{:02d}:{:02d}:{:02d}.{:03d}', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) AS end_code FROM segments"))
def segment_timecodes(spark, sf_dir):
    return segments(spark, sf_dir).select("segment_id", X.hms(F.col("start_ms")).alias("start_hms"), X.timecode(F.col("end_ms")).alias("end_code"))


@register("session_order", oracle(r"""s AS (SELECT DISTINCT session_id FROM segments), p AS (SELECT session_id, regexp_extract(session_id, '^c(\d+)s(\d+)([a-z]?)$', 1)::INTEGER AS cohort, regexp_extract(session_id, '^c(\d+)s(\d+)([a-z]?)$', 2)::INTEGER AS number FROM s)
SELECT session_id, cohort, number, row_number() OVER (PARTITION BY cohort ORDER BY number)::INTEGER AS place FROM p"""))
def session_order(spark, sf_dir):
    from pyspark.sql import Window

    s = segments(spark, sf_dir).select("session_id").distinct().withColumn("p", X.session_parts(F.col("session_id")))
    s = s.select("session_id", "p.cohort", "p.number", "p.variant")
    return s.withColumn("place", F.row_number().over(Window.partitionBy("cohort").orderBy("number", "variant"))).drop("variant")


@register("scrubbed_segments", oracle(r"""SELECT segment_id, regexp_replace(text, '(?i)\b(?:ander|thon|the)\b', '[name]', 'g') AS clean, len(regexp_extract_all(text, '(?i)\b(?:ander|thon|the)\b'))::INTEGER AS n_masked FROM segments"""))
def scrubbed_segments(spark, sf_dir):
    return segments(spark, sf_dir).select("segment_id", X.scrubbed(F.col("text"), NAMES).alias("clean"), F.regexp_count("text", F.lit(r"(?i)\b(?:ander|thon|the)\b")).alias("n_masked"))


@register("word_budget_groups", oracle("SELECT session_id, segment_index, floor((sum(word_count) OVER (PARTITION BY session_id ORDER BY segment_index) - word_count) / 50)::INTEGER AS budget_page FROM segments"))
def word_budget_groups(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("segment_index")
    return segments(spark, sf_dir).select("session_id", "segment_index", F.floor((F.sum("word_count").over(w) - F.col("word_count")) / 50).cast("int").alias("budget_page"))


@register("packed_segments", oracle("""n AS (SELECT session_id, segment_id, word_count::BIGINT AS w, row_number() OVER (PARTITION BY session_id ORDER BY segment_index, segment_id) AS i FROM segments),
p AS (SELECT session_id, segment_id, i, 0 AS g, w AS used FROM n WHERE i = 1
  UNION ALL SELECT n.session_id, n.segment_id, n.i, p.g + CASE WHEN p.used > 0 AND p.used + n.w > 60 THEN 1 ELSE 0 END, CASE WHEN p.used > 0 AND p.used + n.w > 60 THEN n.w ELSE p.used + n.w END FROM p JOIN n ON n.session_id = p.session_id AND n.i = p.i + 1)
SELECT session_id, segment_id, g AS "group" FROM p""").replace("WITH", "WITH RECURSIVE", 1))
def packed_segments(spark, sf_dir):
    """Segments of each session packed in order under a word budget."""
    rows = segments(spark, sf_dir).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("segment_index", "segment_id", "word_count"))).alias("s"))
    packed = X.within_budget(F.transform("s", lambda x: x["segment_id"]), F.transform("s", lambda x: x["word_count"]), 60)
    return rows.select("session_id", F.explode(packed).alias("p")).select("session_id", F.col("p.item").alias("segment_id"), F.col("p.group").alias("group"))


@register("benchmark_grounding", """WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id, lower(text) AS passage FROM benchmark)
SELECT item_id, count(*) AS documents FROM b JOIN d ON contains(t, passage) GROUP BY item_id""")
def benchmark_grounding(spark, sf_dir):
    """Number of documents that hold each benchmark passage whole, as lower-cased text."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return G.passages_in_texts(d.select("text"), b.select("item_id", F.col("text").alias("passage"))).groupBy("item_id").agg(F.count("*").alias("documents"))


@register("drifted_turns", oracle("a AS (SELECT segment_id, sha256(text) AS frozen FROM segments), b AS (SELECT segment_id, sha256(CASE WHEN segment_index % 7 = 0 THEN text || '.' ELSE text END) AS now FROM segments) SELECT a.segment_id, 'drift' AS state FROM a JOIN b USING (segment_id) WHERE frozen <> now"))
def drifted_turns(spark, sf_dir):
    from corpusloom.sources.store import drift

    s = segments(spark, sf_dir)
    frozen = s.select("segment_id", F.sha2("text", 256).alias("sha"))
    now = s.select("segment_id", F.when(F.col("segment_index") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"))
    return drift(frozen, now)


@register("quoted_passages", oracle("q AS (SELECT segment_id, unnest(regexp_extract_all(text, '[\"“]([^\"“”]{3,})[\"”]', 1)) AS quote FROM labelled) SELECT segment_id, quote FROM q"))
def quoted_passages(spark, sf_dir):
    return labelled(spark, sf_dir).select("segment_id", F.explode(X.quotes(F.col("text"))).alias("quote"))
