"""Queries of the numbered operators over their whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import audit, extract, infill, langid, lexpack, mixing, neardup, packing, quality, secrets, topk, urls, vecdup

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-label posterior and hashed linear score of every document."""
    return quality.classify(_table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty best inner products of every twentieth vector id against all vectors."""
    codes = topk.quantized(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(codes.where(F.col("vec_id") % 20 == 0), codes, 20)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.report(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document at Jaccard 0.85 on five-word shingles."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of the vectors at cosine 0.93 within a label."""
    return vecdup.vector_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract.extract(_table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of at most 1024 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, a quarter of them held out of the fit."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urls.judge(_table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each of their orders, by language."""
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, part lengths and digests of every document's fill-in-middle text."""
    return infill.fill_in_middle(_table(spark, sf_dir, "documents"), output=False)


def op13_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in windows filled with lexical neighbours."""
    return lexpack.pack(_table(spark, sf_dir, "documents"), TOKENIZER)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_SCALED = "SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS code FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOPK_SQL = f"""
WITH codes AS ({_SCALED}),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.code, v.code)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM codes WHERE vec_id % 20 = 0) q JOIN codes v ON q.vec_id <> v.vec_id AND len(q.code) = len(v.code)
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored
) WHERE rank <= 20
"""

VECTORS_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93
),
reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
),
parts AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e JOIN parts p USING (vec_id) LEFT JOIN degree d USING (vec_id)
"""


NEARDUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS x FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * x >= 85 * (na + nb - x) UNION ALL SELECT b, a FROM shared WHERE 100 * x >= 85 * (na + nb - x)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
parts AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, p.component_id, s.doc_id = p.component_id AS kept FROM sets s JOIN parts p USING (doc_id)
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _secrets_sql() -> str:
    """The scan by definition: every window's entropy counted anew, windows merged by gaps and islands."""
    base = []
    for k, (kind, pattern) in enumerate(zip(secrets.BASE_KINDS, (secrets.ASSIGN, secrets.ACCESS, secrets.HEX))):
        value = f"regexp_extract_all(t, {_quoted(pattern)}, 1)" if kind == "assign" else f"regexp_extract_all(t, {_quoted(pattern)})"
        least = f"length(x) >= {secrets.LEAST_VALUE}" if kind == "assign" else "true"
        base.append(f"SELECT doc_id, {k} AS k, pos AS s, pos + length(v) AS e FROM ({_places(pattern, value)}) WHERE {least}")
    runs = []
    for i, c in enumerate(secrets.CLASSES):
        tests = [f"regexp_matches(v, {_quoted(p)})" for p in c.needs] + [f"NOT regexp_matches(v, {_quoted(p)})" for p in secrets.ALLOW]
        runs.append(f"SELECT doc_id, {len(secrets.BASE_KINDS) + i} AS k, pos, v, {c.window} AS w, {c.bits}::DOUBLE AS bits FROM ({_places(c.run, 'NULL')}) WHERE {' AND '.join(tests)}")
    kinds = ", ".join(f"'{k}'" for k in (*secrets.BASE_KINDS, *[c.kind for c in secrets.CLASSES]))
    listed = "string_agg(([{}])[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e)".format(kinds)
    count = ", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, kind in enumerate(secrets.BASE_KINDS))
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({' UNION ALL '.join(base)}),
runs AS ({' UNION ALL '.join(runs)}),
windows AS (SELECT doc_id, k, pos + i AS s, w, bits, string_split(substr(v, i::BIGINT + 1, w), '') AS c FROM (SELECT *, unnest(range(length(v) - w + 1)) AS i FROM runs)),
scored AS (SELECT *, w * log2(w) - list_sum(list_transform(list_distinct(c), lambda x: len(list_filter(c, lambda y: y = x)) * log2(len(list_filter(c, lambda y: y = x))))) AS h FROM windows),
hot AS (SELECT *, coalesce(s - lag(s) OVER (PARTITION BY doc_id, k ORDER BY s) > w, true) AS fresh FROM scored WHERE h >= w * bits - 1e-9),
islands AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY doc_id, k ORDER BY s) AS g FROM hot),
extra AS (SELECT doc_id, k, min(s) AS s, max(s) + any_value(w) AS e FROM islands GROUP BY doc_id, k, g),
found AS (SELECT * FROM base UNION ALL SELECT * FROM extra x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s <= x.s AND b.e >= x.e)),
own AS (SELECT doc_id, {count}, {listed} AS joined FROM base GROUP BY doc_id),
every AS (SELECT doc_id, {listed} AS spans FROM found GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(joined, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN own USING (doc_id) LEFT JOIN every USING (doc_id)
"""


def _places(pattern: str, value: str) -> str:
    """Matches of a pattern with their places, from the texts between them."""
    return f"""SELECT doc_id, v[i] AS v, x[i] AS x, (list_sum(list_transform(p[1:i], lambda a: length(a))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda a: length(a))), 0))::BIGINT AS pos
FROM (SELECT doc_id, v, x, p, unnest(range(1, len(v) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {_quoted(pattern)}) AS v, {value if value != 'NULL' else "NULL::VARCHAR[]"} AS x, string_split_regex(t, {_quoted(pattern)}) AS p FROM texts))"""


#: Lengths of the units give the cuts, the cuts give substrings of the text; no list of units is joined again.
INFILL_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
lens AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]'), lambda x: length(x)) AS w, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::UINTEGER::BIGINT) AS k FROM texts),
ends AS (SELECT *, len(w) AS n, coalesce(list_sum(w[:least(k[1] % (len(w) + 1), k[2] % (len(w) + 1))]), 0)::BIGINT AS a, coalesce(list_sum(w[:greatest(k[1] % (len(w) + 1), k[2] % (len(w) + 1))]), 0)::BIGINT AS b FROM lens),
forms AS (SELECT *, CASE WHEN length(t) = 0 OR regexp_matches(t, '<[PSM]>') OR k[3] % 100 > 89 THEN 'plain' WHEN k[4] % 100 > 19 THEN 'psm' ELSE 'spm' END AS form FROM ends)
SELECT doc_id, n::BIGINT AS n, form, CASE form WHEN 'plain' THEN NULL ELSE a END AS prefix_chars, CASE form WHEN 'plain' THEN NULL ELSE b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', left(t, a), '<S>', substr(t, b + 1), '<M>', substr(t, a + 1, b - a)) ELSE concat('<S>', substr(t, b + 1), '<P>', left(t, a), '<M>', substr(t, a + 1, b - a)) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM forms
"""

AUDIT_SQL = r"""
WITH labelled AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END ||
    CASE WHEN coalesce(d.doc_id > least, false) THEN 'E' ELSE '' END AS fails
  FROM docs d LEFT JOIN labelled l ON d.doc_id = l.doc_id
),
counts AS (SELECT part, good, toxic, fails, count(*) AS n FROM failing GROUP BY ALL),
names AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM names a, names b, names c, names d, names e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM orders),
grid AS (SELECT *, filter_order[step] AS f, filter_order[:step - 1] AS before FROM steps),
seen AS (
  SELECT part, filter_order, step, n, good, toxic, fails = f AS alone, contains(fails, f) AS failing, length(fails) AS m,
    length(translate(before, fails, '')) = length(before) AS passed
  FROM counts CROSS JOIN grid
)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (passed AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (passed AND failing), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (NOT passed AND failing), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (passed AND failing AND good = 1), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (passed AND failing AND toxic = 1), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(m, 1)) FILTER (failing), 0)::BIGINT AS shapley
FROM seen GROUP BY ALL
"""


def queries() -> dict:
    found = (op1_quality_classifier, op2_exact_topk, op3_secret_scan, op4_mix_sources, op5_minhash_neardup, op6_embedding_neardup, op7_html_extraction, op8_best_fit_packing, op9_language_id, op10_url_filter, op11_filter_audit, op12_fill_in_middle, op13_lexical_packing, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": TOPK_SQL, "op3_secret_scan": _secrets_sql(), "op5_minhash_neardup": NEARDUP_SQL, "op6_embedding_neardup": VECTORS_SQL, "op11_filter_audit": AUDIT_SQL, "op12_fill_in_middle": INFILL_SQL}
