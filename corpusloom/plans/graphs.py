"""Registered queries on segment graphs, communities and motifs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import register
from corpusloom.operators import graphs as N
from corpusloom.operators import modularity as M
from corpusloom.operators import motifs as Q
from corpusloom.operators import segmentation as G
from corpusloom.operators import transitions as T
from corpusloom.operators.lineage import materialize
from corpusloom.plans.segmentation import ROUNDED, VECTOR
from corpusloom.plans.transitions import BLOCKS
from corpusloom.plans.vectors import MEANS
from corpusloom.sources.corpus import MOVES, labelled, oracle, segments, table

TEMPORAL = "tp AS (SELECT segment_id AS src, lead(segment_id) OVER (PARTITION BY session_id ORDER BY segment_index) AS dst FROM segments), temporal AS (SELECT src, dst, 1.0::DOUBLE AS weight FROM tp WHERE dst IS NOT NULL UNION ALL SELECT dst, src, 1.0 FROM tp WHERE dst IS NOT NULL)"
CHAIN = """held AS (SELECT segment_id, unnest(list_distinct(codes)) AS code FROM labelled), ch AS (SELECT segment_id AS src, lead(segment_id) OVER (PARTITION BY code ORDER BY segment_id) AS dst, 1.0::DOUBLE AS w FROM held),
edges AS (SELECT src, dst, sum(w) AS weight FROM (SELECT src, dst, w FROM ch WHERE dst IS NOT NULL UNION ALL SELECT dst, src, w FROM ch WHERE dst IS NOT NULL) GROUP BY ALL)"""


def _round(i: int) -> str:
    return f"""m{i} AS (SELECT id, community, sum(w) AS w FROM (SELECT dst AS id, community, weight AS w FROM edges JOIN s{i - 1} ON id = src UNION ALL SELECT id, community, 1.0 FROM s{i - 1}) GROUP BY ALL),
s{i} AS (SELECT id, arg_min(community, (-round(w, 6), community)) AS community FROM m{i} GROUP BY id)"""


GROUPS = f"{CHAIN}, s0 AS (SELECT segment_id AS id, segment_id AS community FROM labelled), {', '.join(_round(i) for i in range(1, 4))}, grouped AS (SELECT l.*, community FROM labelled l JOIN s3 ON id = segment_id)"


SETS = """held AS (SELECT DISTINCT segment_id, code FROM (SELECT segment_id, unnest(codes) AS code FROM labelled) WHERE code IS NOT NULL),
sets AS (SELECT segment_id, list(code ORDER BY code) AS codes FROM held GROUP BY segment_id), classes AS (SELECT codes, min(segment_id) AS class_id FROM sets GROUP BY codes), in_class AS (SELECT codes, class_id, unnest(codes) AS code FROM classes)"""
LINKS = f"""{SETS}, inner_links AS (SELECT segment_id, class_id, len(codes)::DOUBLE AS weight FROM sets JOIN classes USING (codes) WHERE segment_id <> class_id),
edges AS (SELECT a.class_id AS src, b.class_id AS dst, count(*)::DOUBLE AS weight, 'class' AS kind FROM in_class a JOIN in_class b ON a.code = b.code WHERE a.class_id <> b.class_id GROUP BY ALL
UNION ALL SELECT segment_id, class_id, weight, 'member' FROM inner_links UNION ALL SELECT class_id, segment_id, weight, 'member' FROM inner_links)"""


def _set_round(i: int) -> str:
    """What each set of codes sees of the labels of round i - 1 over all pairs, and the segments' labels by it: a set's two heaviest, or the own one, whose segment counts once."""
    best = f"(SELECT * FROM t{i} QUALIFY row_number() OVER (PARTITION BY codes ORDER BY w DESC, community) <= 2)"
    return f"""m{i} AS (SELECT code, community, count(*) AS w FROM (SELECT unnest(codes) AS code, community FROM s{i - 1}) GROUP BY ALL), t{i} AS (SELECT codes, community, sum(w) AS w FROM in_class JOIN m{i} USING (code) GROUP BY ALL),
o{i} AS (SELECT id, s.codes, b.community, b.w - CASE WHEN b.community = s.community THEN len(s.codes) - 1 ELSE 0 END AS w FROM s{i - 1} s JOIN {best} b ON b.codes = s.codes
UNION ALL SELECT id, s.codes, s.community, coalesce(t.w - len(s.codes) + 1, 1) FROM s{i - 1} s LEFT JOIN t{i} t ON t.codes = s.codes AND t.community = s.community), s{i} AS (SELECT id, any_value(codes) AS codes, arg_min(community, (-w, community)) AS community FROM o{i} GROUP BY id)"""


SET_GROUPS = f"{SETS}, s0 AS (SELECT DISTINCT segment_id AS id, sets.codes, segment_id AS community FROM labelled LEFT JOIN sets USING (segment_id)), {', '.join(_set_round(i) for i in range(1, 4))}, grouped AS (SELECT l.*, community FROM labelled l JOIN s3 ON id = segment_id)"


def _groups(spark, sf_dir):
    """Labelled segments with their community after three rounds over all pairs that share a code."""
    rows = labelled(spark, sf_dir)
    return rows.join(N.code_communities(rows, 3).withColumnRenamed("id", "segment_id"), "segment_id")


def _chain_groups(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    found = N.communities(N.code_chain(rows), rows.select(F.col("segment_id").alias("id")), 3)
    return rows.join(found.withColumnRenamed("id", "segment_id"), "segment_id")


def _blocks(spark, sf_dir):
    return T.cue_blocks(segments(spark, sf_dir))


@register("typed_edges", oracle(f"{BLOCKS}, {TEMPORAL}, cue AS (SELECT turn_id, to_id FROM joined WHERE turn_id IS NOT NULL) SELECT src, dst, weight, 'temporal' AS kind FROM temporal UNION ALL SELECT turn_id, to_id, 1.0, 'cue' FROM cue UNION ALL SELECT to_id, turn_id, 1.0, 'cue' FROM cue"))
def typed_edges(spark, sf_dir):
    return N.typed_edges(segments(spark, sf_dir), _blocks(spark, sf_dir))


@register("neighbour_confidence", oracle(f"{TEMPORAL} SELECT dst, round(sum(weight * confidence) / sum(weight), 6) AS mean, count(*) AS edges FROM temporal JOIN segments ON segment_id = src GROUP BY dst"))
def neighbour_confidence(spark, sf_dir):
    from corpusloom.operators.vectors import temporal_edges

    s = segments(spark, sf_dir)
    return N.neighbour_mean(temporal_edges(s), s.select(F.col("segment_id").alias("id"), F.col("confidence").alias("value")))


@register("shared_code_edges", oracle(f"{LINKS} SELECT src, dst, weight, kind FROM edges"))
def shared_code_edges(spark, sf_dir):
    return N.shared_code_edges(labelled(spark, sf_dir))


@register("segment_communities", oracle(f"{SET_GROUPS} SELECT segment_id, community FROM grouped"))
def segment_communities(spark, sf_dir):
    return _groups(spark, sf_dir).select("segment_id", "community")


@register("community_transitions", oracle(f"{SET_GROUPS}, n AS (SELECT community, lead(community) OVER (PARTITION BY session_id ORDER BY segment_index) AS nxt FROM grouped) SELECT community AS from_community, nxt AS to_community, count(*) AS n FROM n WHERE nxt <> community GROUP BY ALL"))
def community_transitions(spark, sf_dir):
    return N.community_transitions(_groups(spark, sf_dir))


@register("community_profile", oracle(f"{SET_GROUPS}, b AS (SELECT community, label, count(*) AS c FROM grouped GROUP BY ALL), p AS (SELECT community, arg_min(label, (-c, label)) AS modal, round(max(c) / sum(c), 6) AS purity FROM b GROUP BY ALL) SELECT community, count(*) AS n, count(DISTINCT session_id) AS sessions, round(avg(label), 6) AS mean_label, any_value(modal) AS modal, any_value(purity) AS purity FROM grouped JOIN p USING (community) GROUP BY community"))
def community_profile(spark, sf_dir):
    return N.community_profile(_groups(spark, sf_dir))


@register("stage_top_terms", oracle("""w AS (SELECT label, unnest(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda t: length(t) >= 3)) AS term FROM labelled), tf AS (SELECT label, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT label, term, round(tf * (ln((1 + (SELECT count(DISTINCT label) FROM labelled)) / (1 + df)) + 1), 6) AS score FROM tf JOIN df USING (term)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, term)::INTEGER AS rank FROM s) SELECT * FROM r WHERE rank <= 3"""))
def stage_top_terms(spark, sf_dir):
    return N.top_terms(labelled(spark, sf_dir), "label")


@register("block_vectors", oracle(f"""{BLOCKS}, v AS (SELECT segment_id, {VECTOR("lower(text)")} AS r FROM segments), u AS (SELECT segment_id, list_transform(r, lambda x: CASE WHEN list_dot_product(r, r) > 0 THEN x / sqrt(list_dot_product(r, r)) ELSE 0.0 END) AS v FROM v),
x AS (SELECT from_id, unnest(range({G.SKETCH}))::INTEGER AS place, unnest(v) AS x FROM joined JOIN u ON u.segment_id = turn_id) SELECT from_id, place, {ROUNDED('avg(x)')} AS mean FROM x GROUP BY ALL"""))
def block_vectors(spark, sf_dir):
    return N.block_vectors(_blocks(spark, sf_dir), segments(spark, sf_dir).select("segment_id", G.sketch(F.lower("text")).alias("vector")))


@register("dyadic_routines", oracle(f"""{BLOCKS}, g AS (SELECT segment_id, codes[1] AS community FROM segments), c AS (SELECT from_id, to_id, community, count(*) AS c FROM joined JOIN g ON g.segment_id = turn_id GROUP BY ALL), m AS (SELECT from_id, to_id, arg_min(community, (-c, community)) AS cue FROM c GROUP BY ALL)
SELECT cue, g.community AS response, count(*) AS n FROM m JOIN g ON g.segment_id = m.to_id GROUP BY ALL HAVING count(*) >= 2"""))
def dyadic_routines(spark, sf_dir):
    return N.routines(_blocks(spark, sf_dir), segments(spark, sf_dir).select("segment_id", F.get("codes", F.lit(0)).alias("community")), 2)


MOTIFS = 6


def _motif_round(i: int) -> str:
    """Means of the clusters of round i - 1, and the rows' clusters by them."""
    square = "round(list_sum(list_transform(range(1, len(v) + 1), lambda p: (v[p] - c[p]) * (v[p] - c[p]))), 6)"
    centres = f"c{i} AS (SELECT motif, list(m ORDER BY place) AS c FROM (SELECT motif, place, {ROUNDED('avg(x)')} AS m FROM (SELECT motif, unnest(range(len(v))) AS place, unnest(v) AS x FROM a{i - 1}) GROUP BY ALL) GROUP BY motif), " if i else ""
    return f"{centres}a{i} AS (SELECT from_id, any_value(v) AS v, arg_min(motif, ({square}, motif)) AS motif FROM bv, c{i} GROUP BY from_id)"


FITTED = f"""{BLOCKS}, v AS (SELECT segment_id, {VECTOR("lower(text)")} AS r FROM segments), u AS (SELECT segment_id, list_transform(r, lambda x: CASE WHEN list_dot_product(r, r) > 0 THEN x / sqrt(list_dot_product(r, r)) ELSE 0.0 END) AS v FROM v),
bx AS (SELECT from_id, place, {ROUNDED('avg(x)')} AS mean FROM (SELECT from_id, unnest(range({G.SKETCH})) AS place, unnest(v) AS x FROM joined JOIN u ON u.segment_id = turn_id) GROUP BY ALL), bv AS (SELECT from_id, list(mean ORDER BY place) AS v FROM bx GROUP BY from_id),
c0 AS (SELECT (row_number() OVER (ORDER BY md5(from_id), from_id) - 1)::INTEGER AS motif, v AS c FROM bv QUALIFY row_number() OVER (ORDER BY md5(from_id), from_id) <= {MOTIFS}), {", ".join(_motif_round(i) for i in range(4))},
r AS (SELECT a3.motif, move, (to_stage > from_stage)::INTEGER AS f FROM chosen JOIN a3 USING (from_id) WHERE move IS NOT NULL), b AS (SELECT motif, move, count(*) AS c, sum(f) AS f FROM r GROUP BY ALL),
m AS (SELECT motif, sum(c)::BIGINT AS n, round(max(c) / sum(c), 6) AS purity, round((sum(f) / sum(c)) / (SELECT avg(f) FROM r), 6) AS influence FROM b GROUP BY motif)"""


def _motifs(spark, sf_dir):
    """Blocks with the cluster of their cue's mean sketch."""
    b = _blocks(spark, sf_dir).withColumn("move", T.dominant_move(F.col("moves"), MOVES))
    vectors = segments(spark, sf_dir).select("segment_id", G.sketch(F.lower("text")).alias("vector"))
    return b.join(Q.clusters(Q.block_means(b, vectors), MOTIFS), "from_id")


def _moved_motifs(spark, sf_dir):
    return _motifs(spark, sf_dir).where("move is not null").select("motif", "move", (F.col("to_stage") > F.col("from_stage")).alias("forward"))


@register("block_motifs", oracle(f"{FITTED} SELECT chosen.from_id, to_id, motif FROM chosen JOIN a3 USING (from_id)"))
def block_motifs(spark, sf_dir):
    """The cluster of every block with a cue."""
    return _motifs(spark, sf_dir).select("from_id", "to_id", "motif")


@register("cue_motifs", oracle(f"{FITTED} SELECT motif, n, purity, influence, n >= 3 AND influence >= 1.05 AND purity < 0.5 AS emergent FROM m"))
def cue_motifs(spark, sf_dir):
    """Purity of the moves and influence of each cluster of cues."""
    return N.motifs(_moved_motifs(spark, sf_dir))


@register("community_stage_agreement", oracle(f"""{SET_GROUPS}, c AS (SELECT community AS a, label AS b, count(*) AS n FROM grouped GROUP BY ALL), t AS (SELECT sum(n * (n - 1) / 2) AS both_, sum(n) AS n FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY b)),
e AS (SELECT n, both_, sa * sb / (n * (n - 1) / 2) AS ch, (sa + sb) / 2 AS top FROM t, x, y) SELECT n::BIGINT AS n, round(CASE WHEN top = ch THEN 1.0 ELSE (both_ - ch) / (top - ch) END, 6) AS ari FROM e"""))
def community_stage_agreement(spark, sf_dir):
    return N.rand_index(_groups(spark, sf_dir), "community", "label")


@register("centroid_exemplars", f"""WITH {MEANS}, d AS (SELECT vec_id, e.label, round(sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE - centroid[i]) ** 2))), 5) AS distance FROM embeddings e JOIN cents c ON c.label = e.label),
r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id)::INTEGER AS rank FROM d) SELECT * FROM r WHERE rank <= 3""")
def centroid_exemplars(spark, sf_dir):
    return N.nearest_centroid(table(spark, sf_dir, "embeddings"))


@register("emergent_motifs", oracle(f"{FITTED} SELECT motif, n, purity, influence FROM m WHERE n >= 3 AND influence >= 1.02 AND purity < 0.5"))
def emergent_motifs(spark, sf_dir):
    """Clusters of cues of mixed moves that go forward a fiftieth more often than all; the labels of the supplied tables are digests, so no cluster stands out more."""
    return N.motifs(_moved_motifs(spark, sf_dir), influence=1.02).where("emergent").drop("emergent")


def _parted(df):
    return df.select(F.lit(0).alias("part"), "*")


@register("grouping_modularity", oracle(f"""{GROUPS}, st AS (SELECT e.src, e.dst, e.weight, a.community AS a, b.community AS b FROM edges e JOIN grouped a ON a.segment_id = e.src JOIN grouped b ON b.segment_id = e.dst),
by_a AS (SELECT a, sum(weight) AS tot, coalesce(sum(weight) FILTER (a = b), 0) AS inner_weight FROM st GROUP BY a), whole AS (SELECT sum(weight) AS m2 FROM edges)
SELECT round(sum(inner_weight / m2 - (tot / m2) ** 2), 9) AS modularity, count(*) AS communities FROM by_a, whole"""))
def grouping_modularity(spark, sf_dir):
    """Modularity of the communities of three rounds of label propagation."""
    edges = N.code_chain(labelled(spark, sf_dir))
    groups = _chain_groups(spark, sf_dir).select(F.col("segment_id").alias("id"), "community")
    return M.modularity(_parted(edges), _parted(groups)).drop("part")


@register("community_formation", oracle(f"""{GROUPS}, again AS (SELECT 1 AS draw, id, community AS c FROM s1 UNION ALL SELECT 2, id, community FROM s2),
cells AS (SELECT g.community, draw, c, count(*) AS n FROM again JOIN grouped g ON g.segment_id = id GROUP BY ALL), sums AS (SELECT community, draw, sum(n * (n - 1) // 2) AS together, sum(n) * (sum(n) - 1) // 2 AS seen FROM cells GROUP BY ALL)
SELECT community, sum(seen)::BIGINT AS seen, sum(together)::BIGINT AS together FROM sums GROUP BY community"""))
def community_formation(spark, sf_dir):
    """Pairs of each community of three rounds that were together after the first and the second round already."""
    rows = labelled(spark, sf_dir)
    edges, nodes = N.code_chain(rows), rows.select(F.col("segment_id").alias("id"))
    again = N.communities(edges, nodes, 1).withColumn("draw", F.lit(1)).unionByName(N.communities(edges, nodes, 2).withColumn("draw", F.lit(2)))
    return M.kept_together(N.communities(edges, nodes, 3), again)


@register("modularity_communities")
def modularity_communities(spark, sf_dir):
    """Communities of the segments by modularity, all pairs that share a code linked, levels until no move gains."""
    return M.code_communities(materialize(N.code_classes(labelled(spark, sf_dir))))


@register("community_stability")
def community_stability(spark, sf_dir):
    """Share of each community's pairs that stay together in fifty draws of the participants."""
    rows = labelled(spark, sf_dir)
    members = materialize(N.code_classes(rows).join(rows.select("segment_id", "participant_id").distinct(), "segment_id"))
    return M.code_stability(members, materialize(M.code_communities(members)), draws=50)
