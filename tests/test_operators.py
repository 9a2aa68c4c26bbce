"""Operators on small frames: edges, ties, empty and null rows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import scrub as Z
from corpusloom.functions import stats
from corpusloom.functions import text as X
from corpusloom.operators import calibration as K
from corpusloom.operators import graphs as N
from corpusloom.operators import grounding as P
from corpusloom.operators import inference as I
from corpusloom.operators import reports as R
from corpusloom.operators import scoring as V
from corpusloom.operators import segmentation as G
from corpusloom.operators import transitions as T
from corpusloom.operators import vectors as E
from corpusloom.operators.ordered import ordered_fold

TURNS = "session_id string, cohort_id int, session_number int, participant_id string, segment_id string, segment_index int, speaker string, text string, start_ms long, end_ms long, label int, move int, confidence double"


def turns(spark, rows):
    return spark.createDataFrame([("s", 1, 1, "p", f"t{i}", i, who, f"text {i}", start, end, label, move, 0.5) for i, (who, start, end, label, move) in enumerate(rows)], TURNS)


def test_ordered_fold_restarts_for_every_key(spark):
    rows = spark.range(2000).select((F.col("id") % 7).cast("string").alias("key"), F.col("id").alias("at"))
    got = ordered_fold(rows, "key", ["at"], ["at"], lambda: 0, lambda s, r: (s + 1, s), "n", "long")
    assert got.where(F.floor(F.col("at") / 7) != F.col("n")).count() == 0 and got.count() == 2000


def test_cue_block_edges(spark):
    rows = turns(spark, [("participant", 0, 800, 0, None), ("therapist", 800, 1000, None, 1), ("therapist", 700, 1000, None, 2), ("participant", 1000, 1800, 2, None), ("participant", 2000, 2500, None, None), ("participant", 3000, 3500, 1, None)])
    b = {(r.from_id, r.to_id): r for r in T.cue_blocks(rows).collect()}
    assert set(b) == {("t0", "t3"), ("t3", "t5")}
    assert b["t0", "t3"].moves == [2, 1] and b["t0", "t3"].direction == "forward"
    assert b["t3", "t5"].is_empty and b["t3", "t5"].direction == "backward"


def test_cue_blocks_without_end_time_go_by_place(spark):
    rows = turns(spark, [("participant", 0, 0, 0, None), ("therapist", 5000, 5001, None, 1), ("participant", 100, 200, 0, None)])
    # The first has no end time: the turn between by place counts, whatever its time.
    assert [(r.n_turns, r.direction) for r in T.cue_blocks(rows).collect()] == [(1, "lateral")]


SENT = "session_id string, place long, speaker string, text string, words int, start double, end double, forced boolean, soft boolean"


def test_soft_boundaries_wait_for_words(spark):
    rows = spark.createDataFrame([("s", i, "a", "x", 5, float(i), i + 1.0, i == 4, i in (0, 2)) for i in range(7)], SENT)
    got = [r.segment for r in G.numbered(rows, 12).orderBy("place").collect()]
    assert got == [0, 0, 0, 1, 1, 2, 2]


def test_long_segments_are_halved(spark):
    rows = spark.createDataFrame([("s", i, "a", f"w{i}", 10, float(i), i + 1.0, False, False) for i in range(9)], SENT).withColumn("segment", F.lit(0).cast("long"))
    built = G.built(G.split_long(rows, 30, 300.0)).orderBy("first_place").collect()
    assert [r.words for r in built] == [20, 20, 20, 30] and " ".join(r.text for r in built) == " ".join(f"w{i}" for i in range(9))


def test_short_segments_merge(spark):
    rows = spark.createDataFrame([("s", 0, "a", "x", 2, 0.0, 1.0), ("s", 1, "a", "y", 20, 1.0, 2.0), ("s", 2, "b", "z", 2, 2.0, 3.0), ("s", 3, "a", "u", 20, 3.0, 4.0), ("s", 4, "a", "v", 1, 4.0, 5.0)], "session_id string, first_place long, speaker string, text string, words int, start double, end double")
    assert [(r.text, r.pieces) for r in G.merged(G.merge_short(rows, 12)).orderBy("first_place").collect()] == [("x y", 2), ("z", 1), ("u v", 2)]


def test_boundary_agreement_is_one_to_one(spark):
    a = spark.createDataFrame([("s", 1000), ("s", 1500), ("t", 10)], "session_id string, at_ms long")
    b = spark.createDataFrame([("s", 1200), ("s", 9000)], "session_id string, at_ms long")
    assert {r.session_id: (r.matched, r.jaccard) for r in G.boundary_agreement(a, b).collect()} == {"s": (1, round(1 / 3, 6)), "t": (0, 0.0)}


def test_context_is_cut_at_its_end(spark):
    rows = turns(spark, [("participant", 0, 1, 0, None), ("therapist", 1, 2, None, 1), ("participant", 2, 3, 0, None)])
    got = {r.segment_id: r.context for r in G.context_before(rows, 3, 3).collect()}
    assert got == {"t0": "", "t1": "text 0", "t2": "text\ntext 1"}


def test_votes_with_errors_and_ties(spark):
    def rater(kind, stage=None, conf=None, second=None, why=""):
        return lambda text: (kind, stage, conf, second, why)

    def broken(text):
        raise RuntimeError("down")

    rows = spark.createDataFrame([("a", "x"), ("b", None)], "segment_id string, text string")
    cast = V.ballots(rows, [rater("CODED", 2, 0.8, 1), rater("CODED", 2, 0.6, 1, "because"), broken])
    assert cast.count() == 6
    w = V.merged_votes(cast, 3)
    assert {tuple(r) for r in w.collect()} == {("a", 2, 2, "majority", 0.7, "because"), ("b", 2, 2, "majority", 0.7, "because")}
    assert {tuple(r) for r in V.secondary_evidence(cast, w).collect()} == {("a", 1, 0.84), ("b", 1, 0.84)}
    split = V.merged_votes(V.ballots(rows, [rater("CODED", 0, 0.9), rater("CODED", 1, 0.9), broken]), 3)
    assert {(r.winner, r.level) for r in split.collect()} == {(None, "split")}
    assert {r.level for r in V.merged_votes(V.ballots(rows, [broken]), 1).collect()} == {"none"}


def test_reconciliation_policies(spark):
    a, b = (spark.createDataFrame(x, "segment_id string, code string, confidence double") for x in ([("s", "k1", 0.5), ("s", "k2", 0.4)], [("s", "k2", 0.9), ("s", "k3", 0.1)]))
    kept = lambda p: sorted(r.code for r in R.reconcile(a, b, p).where("kept").collect())
    assert (kept("require_agreement"), kept("prefer_first"), kept("union")) == (["k2"], ["k1", "k2"], ["k1", "k2", "k3"])


def test_abstain_floor_falls_back_to_best_precision(spark):
    rows = spark.createDataFrame([(0, 0.9, True), (0, 0.5, False), (1, 0.8, False), (1, 0.4, True)], "predicted int, confidence double, correct boolean")
    got = {r.predicted: (r.floor, r.reached) for r in K.abstain_floors(rows, 0.9).collect()}
    assert got == {0: (0.9, True), 1: (0.4, False)}


def test_kappa_interval_of_one_cluster_is_open(spark):
    rows = spark.createDataFrame([("p", 1, 1), ("p", 2, 2), ("p", 1, 2)], "c string, a int, b int")
    r = K.agreement_interval(rows, "a", "b", "c").first()
    assert r.clusters == 1 and r.low is None and r.value == pytest.approx(0.4)


def test_names_of_address_by_their_place():
    at = lambda t: [t[a:b] for a, b, _ in Z.addressed(t)]
    assert at("Hello, Maria. We met in Paris, Tom, and you know it, Ann!") == ["Maria", "Tom", "Ann"]
    assert at("Ann, come. thanks Everyone for it. will, Will.") == ["Ann"]


def test_draws_are_poisson_and_repeat(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("c"), F.lit(1).alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    w = I.with_draws(rows, "c", 50, 7).where("draw >= 0").agg(F.sum("times"), F.sum(F.col("times") * F.col("times"))).first()
    assert w[0] / 100_000 == pytest.approx(1, abs=0.02) and w[1] / 100_000 == pytest.approx(2, abs=0.06)
    a, b = (I.cluster_bootstrap(rows, ["k"], "c", "v", 200).first() for _ in range(2))
    assert a == b and a.n == 2000 and a.clusters == 2000
    half = 1.96 * 2 / 2000**0.5  # standard deviation of 0 to 6 is 2
    assert a.low == pytest.approx(a["mean"] - half, abs=0.03) and a.high == pytest.approx(a["mean"] + half, abs=0.03)


def test_passages_match_substrings(spark):
    texts = ["One two three four five six", "xone two", "a b", None, "", "alone two three FOUR fiver", "two three", "o"]
    passages = ["one two three four five", "two", "ne two", "two three four", "b", "", None, "a b c", "o", "two  three"]
    got = P.passages_in_texts(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(list(enumerate(passages)), "item_id int, passage string"))
    want = sorted(i for i, p in enumerate(passages) for t in texts if p is not None and t is not None and p in t.lower())
    assert sorted(r.item_id for r in got.collect()) == want


def test_rand_index(spark):
    rows = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2), ("y", 2)], "a string, b int")
    assert N.rand_index(rows, "a", "b").first().ari == 1.0


def test_community_of_separate_cliques(spark):
    pairs = [(a, b) for g in ("abc", "xyz") for a in g for b in g if a != b]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(c,) for c in "abcxyz"], "id string")
    got = {r.id: r.community for r in N.communities(edges, nodes, 4).collect()}
    assert len({got[c] for c in "abc"}) == 1 and len({got[c] for c in "xyz"}) == 1 and got["a"] != got["x"]


def test_scrubbing(spark):
    rows = spark.createDataFrame([("Hi Maria, ann lee is in Paris.",), ("Thanks everyone.",), (None,), ("",)], "text string")
    got = [tuple(r) for r in Z.scrub_segments(rows, ["Ann Lee"]).collect()]
    assert got == [("Hi [name], [name] is in Paris.", 1, 1), ("Thanks everyone.", 0, 0), (None, 0, 0), ("", 0, 0)]
    swapped = rows.select(Z.renamed({"ann": "lee", "lee": "ann"})(F.col("text")).alias("t")).first().t
    assert swapped == "Hi Maria, lee ann is in Paris."


@settings(max_examples=60, deadline=None)
@given(st.text("ab cd,.XY", max_size=60))
def test_spans_never_overlap(text):
    found = Z.spans(text, Z.name_pattern(["ab cd", "cd"]), frozenset(), 0.6)
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_grounding():
    assert Z.grounded("the cat sat", "on it the cat sat down") and Z.grounded("the cat sat on the mat today", "x the cat sat on the mat todya")
    assert not Z.grounded("cat", "dog") and not Z.grounded("entirely different", "the cat sat on the mat")


def test_audit(spark):
    rows = spark.createDataFrame([("r", "the sun was warm", ["sun was warm"]), ("r", "the sun was warm", ["moon landing today"]), ("warm sunshine", "cold dark night", [])], "why string, text string, q array<string>")
    assert [r.s for r in rows.select(Z.audit(F.col("why"), F.col("text"), F.col("q")).alias("s")).collect()] == ["ok", "ungrounded", "weak"]


def test_settings_sweep_and_hash():
    assert V.sweep({"a": [1, 2], "b": [3, 3, 4]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}, {"a": 1, "b": 4}]
    assert Z.params_hash({"a": 1, "b": 2}) == Z.params_hash({"b": 2, "a": 1})


def test_text_functions_on_null_and_empty(spark):
    rows = spark.createDataFrame([(None,), ("",), ("One. Two!  Three",)], "t string")
    got = rows.select(F.size(X.tokens(F.col("t"))).alias("n"), X.sentence_list(F.coalesce("t", F.lit(""))).alias("s"), Z.first_json(F.lit('so {"a": 1} end')).alias("j")).collect()
    assert [r.n for r in got] == [0, 0, 3] and got[2].s == ["One.", "Two!", "Three"] and got[0].j == '{"a": 1}'


def test_tails_of_distributions():
    assert stats.normal_tail(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert stats.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.sign_test(9, 1) == pytest.approx(22 / 1024)


def test_empty_tables(spark):
    none = turns(spark, []).withColumn("codes", F.array().cast("array<string>"))
    assert T.cue_blocks(none).count() == 0 and N.shared_code_edges(none).count() == 0
    assert G.segment_sessions(G.sentences(none)).count() == 0
    assert V.ballots(none, [lambda t: ("ABSTAIN", None, None, None, "")]).count() == 0


def test_label_subtypes_take_every_label(spark, tmp_path):
    from corpusloom.plans.models import label_subtypes

    rows = [(i, [float(i % 7), float(i)], i % 4 + 1) for i in range(24)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.label for r in label_subtypes(spark, str(tmp_path)).select("label").collect()} == {1, 2, 3, 4}


def test_nearest_equals_brute_force_with_many_ties(spark):
    x = np.random.default_rng(1).integers(-1, 2, (300, 3)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.similarity + 0.0) for r in E.nearest(rows, rows.where("vec_id % 2 = 0"), 5).collect()}
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = {}
    for i in range(0, 300, 2):
        scores = np.round(unit @ unit[i], 6)
        best = sorted((j for j in range(300) if j != i), key=lambda j: (-scores[j], j))[:5]
        want |= {(i, k): (j, scores[j] + 0.0) for k, j in enumerate(best, 1)}
    assert got == want
